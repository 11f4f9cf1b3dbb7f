from pyspark.sql import functions as F

from emberline.llm import bitmaps as B


def test_error_at_every_size(spark):
    sizes = {"a": 1, "b": 24, "c": 300, "d": 5_000, "e": 200_000}
    df = spark.range(0, 1)
    for i, (k, n) in enumerate(sizes.items()):
        part = spark.range(n).select(F.lit(k).alias("k"), F.concat(F.lit(f"{k}-"), F.col("id").cast("string")).alias("who"))
        df = part if i == 0 else df.union(part)
    got = {r.k: r.n_distinct for r in B.estimates(B.cells(df.union(df), ["k"], "who"), ["k"]).collect()}
    assert got["a"] == 1 and abs(got["b"] - 24) <= 1
    for k, n in sizes.items():
        assert abs(got[k] - n) <= max(1, 4 * B.STANDARD_ERROR * n)


def test_merging_days_equals_counting_all(spark):
    df = spark.range(4_000).select(F.lit("k").alias("key"), (F.col("id") % 7).alias("day"), (F.col("id") % 1_500).cast("string").alias("level"))
    daily = B.cells(df.withColumnRenamed("level", "who"), ["key", "day"], "who")
    merged = B.estimates(B.merged(daily, ["key"]), ["key"]).first().n_distinct
    whole = B.estimates(B.cells(df.withColumnRenamed("level", "who"), ["key"], "who"), ["key"]).first().n_distinct
    assert merged == whole and abs(whole - 1_500) < 120
    assert B.estimates(B.merged(daily, []), []).first().n_distinct == whole


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "x"), ("k", None), ("k", "x"), ("k", "x"), ("k", "")], "k string, who string")
    assert [(r.k, r.n_distinct) for r in B.estimates(B.cells(df, ["k"], "who"), ["k"]).collect()] == [("k", 2)]
    assert {(r.k, r.n_distinct) for r in B.estimates(B.cells(df, ["k"], "who", ["k"]), ["k"]).collect()} == {("k", 2), (None, 1)}
    assert B.estimates(B.cells(df.limit(0), ["k"], "who"), ["k"]).count() == 0


def test_the_estimate_is_that_of_its_levels(spark):
    """Against the formula, level by level, also where low levels are saturated."""
    import math

    for n in (3, 900, 40_000, 3_000_000):
        cells = B.cells(spark.range(n).select(F.lit("k").alias("k"), F.col("id").cast("string").alias("who")), ["k"], "who").collect()
        z = [sum(bin(r.bits & (2**64 - 1)).count("1") for r in cells if r.level == i) for i in range(B.LEVELS)]
        base = max([i + 1 for i in range(B.LEVELS - 1) if z[i] > B.FULL], default=0)
        want = round(2**base * sum(-B.B * math.log(1 - min(x, B.B - 1) / B.B) for x in z[base:]))
        got = B.estimates(spark.createDataFrame(cells), ["k"]).first().n_distinct
        assert abs(got - want) <= 1 and (base > 0) == (n > 2_000)
