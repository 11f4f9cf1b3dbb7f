"""The llm queries against their SQL, and the others against properties, on the smallest tables."""

import pytest
from compare import assert_same, views
from conftest import DATA

from emberline.llm import queries as Q

FOLDER = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_as_sql(spark, con, name):
    assert_same(Q.QUERIES[name](spark, str(FOLDER)), con, Q.ORACLE[name])


def test_rollup_is_near_the_exact_counts(spark, con):
    got = {(r.kind, r.per, r.key_value, r.day): r.n_distinct for r in Q.p6_rollup(spark, str(FOLDER)).collect()}
    exact = con.execute("SELECT count(DISTINCT nullif(lower(trim(DstDevice)), '')) FROM netflow WHERE nullif(lower(trim(SrcDevice)), '') IS NOT NULL AND time > 0").fetchone()[0]
    assert abs(got["peers", "total", None, None] - exact) <= max(2, 0.12 * exact)


@pytest.mark.parametrize("name", ["p2_percentiles", "p2_daily", "p7_clusters", "p8_ids", "p9_mix", "p9_shares", "p10_found", "p10_shares"])
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, str(FOLDER)).count() > 0


def test_held_out_examples(spark):
    """Subjects of labelled examples that the lexicon has not seen, read as documents of the corpus."""
    from pyspark.sql import functions as F

    from emberline.llm import subjects as S
    from emberline.sources import tables as T

    big = str(DATA / "sf0.01")
    ex = T.table(spark, big, "subject_examples")
    codes = [r.subject for r in T.table(spark, big, "subjects").collect()]
    held = ex.where((F.col("example_id") % 4 == 0) & F.col("subject").isin(codes) & (F.length("text") > 60))
    docs = T.table(spark, big, "documents").select("doc_id", "text", "lang", "source")
    both = docs.union(held.select((-F.col("example_id")).alias("doc_id"), "text", "lang", F.lit(None).cast("string")))
    labels, codes, _ = S.unit_labels(both, T.table(spark, big, "subjects"), ex.join(held.select("example_id"), "example_id", "left_anti"))
    got = {r.doc_id: r.subject for r in S.document_subjects(labels, codes, 0.4).collect() if r.doc_id < 0}
    want = {-r.example_id: r.subject for r in held.collect()}
    assert sum(got.get(i) == s for i, s in want.items()) >= 0.85 * len(want)  # some labels are wrong on purpose
