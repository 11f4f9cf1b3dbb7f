import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from emberline.operators import entity_features as EF
from emberline.operators import tree_agg
from emberline.sources import tables as T


def test_tree_totals_do_not_depend_on_chunks(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 6 + ["b", "c", None]), rng.choice([None, 1, 2, 3])) for _ in range(2_000)]
    want = Counter(k for k, _ in rows)
    for parts, fan in ((1, 4), (40, 4), (40, 2)):
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "k string, v int")
        out = tree_agg.tree_aggregate(df, ["k"], {"n": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, fan)
        got = {r.k: (r.n, r.s, r.lo, r.hi) for r in out.collect()}
        for k in want:
            v = [x for a, x in rows if a == k and x is not None]
            assert got[k] == (len(v), sum(v), min(v), max(v))
        heavy = {r.key_value: (r.n, r.total) for r in tree_agg.heavy_keys(df, "k", 0.2, fan).collect()}
        assert heavy == {k: (n, 2_000) for k, n in want.items() if k is not None and n >= 400}
    empty = spark.createDataFrame([], "k string, v int")
    assert tree_agg.heavy_keys(empty, "k", 0.02).count() == 0


def test_a_tree_of_three_levels(spark):
    """More chunks than fan_in squared: states merge in three rounds."""
    df = spark.range(0, 20_000, 1, 1_100).select((F.col("id") % 7 % 3).alias("k"), F.lit(1).alias("one"))
    out = tree_agg.tree_aggregate(df, ["k"], {"n": ("count", "one")})
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 3  # before it has run, when the plan is shown once
    assert {r.k: r.n for r in out.collect()} == Counter(i % 7 % 3 for i in range(20_000))


def brute(rows):
    n, latest, users = Counter(), {}, defaultdict(set)
    for h, e, u, t in rows:
        if h is not None and e is not None:
            n[h, e] += 1
            latest[h, e] = max((x for x in (latest.get((h, e)), t) if x is not None), default=None)
            if u is not None:
                users[h, e].add(u)
    return {k: (n[k], latest[k], len(users[k])) for k in n}


def test_runs_and_wide_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["h1", "h1", "h1", "h2", "h3", None]), rng.choice([1, 2, 3, 99, None]), rng.choice(["u", "v", "w", None]), rng.choice([None, *range(50)])) for _ in range(1_500)]
    df = spark.createDataFrame(rows, "host string, ev int, usr string, t bigint").withColumn("n", F.lit("clash")).withColumn("split", F.lit("clash"))
    want = brute(rows)
    pairs = EF.event_pairs(df, "host", "ev", "usr", "t")
    for split_rows in (10**9, 100):
        splits = EF.split_table(df, "host", split_rows)
        assert (splits is None) == (split_rows == 10**9)
        assert {(r.entity, r.type): (r.n, r.latest, r.n_actors) for r in EF.event_runs(pairs, splits).collect()} == want
        wide = {r.entity: r for r in EF.wide_features(pairs, [1, 2, 3, 4], 100, splits).collect()}
        assert set(wide) == {h for h, _ in want}
        for h, r in wide.items():
            for e in (1, 2, 3, 4):
                n, latest, users = want.get((h, e), (0, None, 0))
                assert (r[f"cnt_{e}"], r[f"age_{e}"], r[f"users_{e}"]) == (n, None if latest is None else 100 - latest, users)
    none = EF.event_pairs(spark.createDataFrame([], "host string, ev int, usr string, t bigint"), "host", "ev", "usr", "t")
    assert EF.event_runs(none).count() == 0 and EF.wide_features(none, [1], 0).count() == 0


def test_runs_that_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("h", e, f"u{i}", i) for e in range(3) for i in range(40)] + [("k", 1, None, 5)]
        pairs = EF.event_pairs(spark.createDataFrame(rows, "host string, ev int, usr string, t bigint"), "host", "ev", "usr", "t")
        assert {(r.entity, r.type): (r.n, r.latest, r.n_actors) for r in EF.event_runs(pairs).collect()} == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_copies_count_once(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["h1", "h1", "h2", None]), rng.choice([1, 2, None]), rng.choice(["u", "v", None]), rng.choice([None, 1, 2, 3]), rng.choice([0, 1, None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "host string, ev int, usr string, t bigint, more int").repartition(5)
    want = brute([r[:4] for r in set(rows)])
    for split_rows in (10**9, 50):
        splits = EF.split_table(df, "host", split_rows)
        pairs = EF.event_pairs(df.select("*", *T.row_hash(df)), "host", "ev", "usr", "t", ["h1", "h2"], splits)
        assert {(r.entity, r.type): (r.n, r.latest, r.n_actors) for r in EF.event_runs(pairs, splits).collect()} == want
        assert {r.entity: r.cnt_1 for r in EF.wide_features(pairs, [1], 9, splits).collect()} == {h: want[h, 1][0] for h in ("h1", "h2")}


def test_row_hash_tells_rows_apart(spark):
    rows = [(None, 1, "a", None), (1, None, "a", None), (1, 1, None, "a"), (1, 1, "a", None), (1, 1, None, None), (None, None, None, None), (0, 0, "", None), (0, 0, None, "")]
    df = spark.createDataFrame(rows * 3, "a int, b bigint, c string, d string").repartition(4)
    assert len({tuple(r) for r in df.select(*T.row_hash(df)).collect()}) == len(rows)
    assert T.one_of_each(df, "a", "c").count() == len(rows)
    odd = spark.createDataFrame([(float("nan"), 0.0), (float("nan"), -0.0), (1.0, 0.0)], "a double, b double")
    assert T.one_of_each(odd, "b", "a").count() == 2 == odd.distinct().count()
    assert T.one_of_each(df.limit(0), "a").count() == 0
