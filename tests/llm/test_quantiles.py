import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import quantiles as Q


def rank_of(values, v):
    """Ranks (from 1) that the value v may have among sorted values."""
    return np.searchsorted(values, v, "left") + 1, np.searchsorted(values, v, "right")


@pytest.mark.parametrize(("k", "parts", "fan", "rows_a_batch"), [(64, 1, 96, 10_000), (32, 9, 3, 10_000), (64, 3, 2, 50), (4_096, 4, 96, 1_000)])
def test_rank_error_is_within_the_bound(spark, k, parts, fan, rows_a_batch):
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 5 + ["b", "c"]), rng.choice([None, 1, 2, 3, 4, 5]), math.exp(rng.gauss(5, 3)) if rng.random() < 0.7 else float(rng.randrange(3))) for _ in range(6_000)]
    df = spark.createDataFrame(rows, "g string, day int, v double").withColumn("n_v", F.lit("clash")).withColumn("part", F.lit("clash"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        base, _ = Q.base_sketches(df.repartition(parts), ["g", "day"], ["v"], k, fan)
        assert base.groupBy("g", "day", "part").count().where("count > 1").count() == 0
        out = Q.percentiles(Q.merge_sketches(base, ["g"], ["v"], 6 * parts, k, fan), ["g"], ["v"], [1, 25, 50, 75, 99, 100]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert {r.g for r in out} == {"hot", "b", "c"}
    for r in out:
        values = np.sort([v for g, _, v in rows if g == r.g])
        assert r.n == len(values) and r.rank_error <= 0.12 * r.n
        if k == 4_096 and r.g != "hot":
            assert r.rank_error == 0
        for q in (1, 25, 50, 75, 99, 100):
            want, (lo, hi) = math.ceil(q * r.n / 100), rank_of(values, r[f"p{q}"])
            assert lo - r.rank_error <= want <= hi + r.rank_error, (r.g, q)


def test_days_put_together_equal_the_whole_when_exact(spark):
    rows = [("a", d, float(x)) for d in range(3) for x in range(10)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    base, parts = Q.base_sketches(df, ["g", "day"], ["v"])
    r = Q.percentiles(Q.merge_sketches(base, ["g"], ["v"], 3 * parts), ["g"], ["v"], [50]).first()
    assert (r.n, r.p50, r.rank_error) == (30, 4.0, 0)


def test_unusable_values_and_empty(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, float("nan")), ("a", 1, float("inf")), ("a", 1, -1.0), ("a", None, 2.0), (None, 1, 5.0)], "g string, day int, v double")
    base, parts = Q.base_sketches(df, ["g", "day"], ["v"])
    got = {(r.g, r.n, r.p50) for r in Q.percentiles(Q.merge_sketches(base, ["g"], ["v"], 2 * parts), ["g"], ["v"], [50]).collect()}
    assert got == {("a", 1, 2.0), (None, 1, 5.0)}
    empty, parts = Q.base_sketches(df.limit(0), ["g", "day"], ["v"])
    assert Q.percentiles(Q.merge_sketches(empty, ["g"], ["v"], parts), ["g"], ["v"], [50]).count() == 0


def test_same_rows_give_the_same_sketch(spark):
    rng = random.Random(1)
    rows = [("a", 1, rng.random()) for _ in range(3_000)]
    got = set()
    for _ in range(2):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "g string, day int, v double").repartition(4, "v")
        base, m = Q.base_sketches(df, ["g", "day"], ["v"], 50)
        got.add(tuple(Q.merge_sketches(base, ["g"], ["v"], m, 50).first().v_v))
    assert len(got) == 1


def test_a_hot_group_leaves_a_partition_as_one_buffer(spark):
    df = spark.range(200_000).select(F.lit("hot").alias("g"), F.lit(1).alias("day"), (F.col("id") * 7919 % 200_000).cast("double").alias("v")).repartition(3)
    base, m = Q.base_sketches(df, ["g", "day"], ["v"], 256)
    rows = base.collect()
    assert len(rows) == 3 and all(len(r.v_v) == 256 for r in rows) and sum(r.n_v for r in rows) == 200_000
    r = Q.percentiles(Q.merge_sketches(base, ["g"], ["v"], m, 256), ["g"], ["v"], [50]).first()
    assert abs(r.p50 - 100_000) <= r.rank_error <= 200_000 * 0.03
