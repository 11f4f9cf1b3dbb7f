"""Queries of the problems over tables without rows, and over tables of nulls."""

import pytest
from conftest import DATA

from emberline.plans import training

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
TABLES = ("netflow", "windows_event_logs", "event_types")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for kind in ("empty", "nulls"):
        out[kind] = str(tmp_path_factory.mktemp(kind))
        for t in TABLES:
            schema = spark.read.parquet(str(DATA / "sf0.001" / f"{t}.parquet")).schema
            rows = [] if kind == "empty" else [tuple(None for _ in schema.fields)] * 3
            spark.createDataFrame(rows, schema).write.parquet(f"{out[kind]}/{t}.parquet")
    return out


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", sorted(training.QUERIES))
def test_no_rows(spark, folders, kind, name):
    df = training.QUERIES[name](spark, folders[kind])
    assert df.columns and df.count() == 0
