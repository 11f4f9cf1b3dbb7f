"""Queries of the problems over tables without rows, and over tables of nulls."""

import pytest
from conftest import DATA

from emberline.llm import queries as Q

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
TABLES = ("netflow", "windows_event_logs", "host_aggregates", "documents", "mix_targets", "subjects", "subject_examples")


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
@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_no_crash(spark, folders, kind, name):
    rows = Q.QUERIES[name](spark, folders[kind]).collect()
    if name == "p8_ids":
        assert [list(r.ids) for r in rows] == ([[]] * 3 if kind == "nulls" else [])
    elif name == "p10_shares":
        assert all(r.n_docs == 0 and not r.n_units for r in rows)
    elif name == "p6_rollup":
        assert all(r.n_distinct == 0 for r in rows)
    else:
        assert rows == []
