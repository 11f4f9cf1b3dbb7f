import random

import numpy as np
import pytest

from emberline.llm import clusters as K


def points(seed):
    rng = random.Random(seed)
    out = []
    for c in range(12):
        x, y = 0.08 * (c % 4) + 0.1, 0.1 * (c // 4) + 0.2
        for i in range(rng.choice([3, 5, 40, 200])):
            out.append((f"h{c:02d}-{i:03d}", x + rng.uniform(0, 0.025), y + rng.uniform(0, 0.025)))
    return out + [("dup1", 0.9, 0.9), ("dup1", 0.9, 0.9)] + [(f"same{i}", 0.95, 0.1) for i in range(30)]


def brute(rows):
    rows = {k: (x, y) for k, x, y in rows}
    out = set()
    for k, (x, y) in rows.items():
        near = [j for j, (a, b) in rows.items() if abs(a - x) <= 0.03 and abs(b - y) <= 0.03]
        if len(near) >= 5:
            out.add((min(near), k))
    return out


@pytest.mark.parametrize("parts", [8, 3])
def test_like_brute_force(spark, parts):
    rows = points(3)
    df = spark.createDataFrame(rows, "host string, x double, y double").withColumnRenamed("host", "id2").withColumnRenamed("id2", "leaf")
    got = K.clusters(K.unit_points(df, "leaf", "x", "y"), 0.03, 5, parts).cache()
    first = {}
    for r in got.collect():
        first.setdefault(r.cluster, []).append(r.id)
    assert {(min(v), k) for v in first.values() for k in v} == brute(rows)
    top = K.describe(got, 2).collect()
    assert {r.cluster: r["size"] for r in top} == {min(v): len(v) for v in first.values()} and {r["rank"] for r in top} == {1, 2}
    assert [r.id for r in sorted((r for r in top if r.cluster == "same0"), key=lambda r: r["rank"])] == ["same0", "same1"]


def test_left_out_and_empty(spark):
    bad = [("a", None, 0.5), ("b", float("nan"), 0.5), ("c", -1.0, 0.5), ("d", 1.5, 0.5), (None, 0.5, 0.5)]
    df = spark.createDataFrame(bad, "h string, x double, y double")
    assert K.clusters(K.unit_points(df, "h", "x", "y"), 0.03, 5).count() == 0
    edge = spark.createDataFrame([(f"e{i}", 0.0, 1.0) for i in range(5)], "h string, x double, y double")
    assert K.clusters(K.unit_points(edge, "h", "x", "y"), 0.03, 5).count() == 5


def test_bisecting_ends_with_compact_leaves():
    p = np.random.default_rng(2).random((5_000, 2))
    n, one = np.ones(len(p), np.int64), np.array([[0.5, 0.5]] * 3)
    leaf = K.bisect(n, p, p * p, p, p, 0.1)
    for i in range(leaf.max() + 1):
        q = p[leaf == i]
        assert len(q) and (q.max(0) - q.min(0) <= 0.1).all()
    assert leaf.max() < 1_000
    wide = K.bisect(n[:3], one, one * one, one - 0.09, one + 0.09, 0.1)  # cells with one mean and a wide box end as well
    assert sorted(wide) == [0, 1, 2] and K.bisect(n[:0], p[:0], p[:0], p[:0], p[:0], 0.1).size == 0


def test_a_repeated_key_is_one_of_its_rows(spark):
    df = spark.createDataFrame([("a", 0.2, 0.1), ("a", 0.1, 0.9), ("a", 0.1, 0.8)], "h string, x double, y double")
    assert [tuple(r) for r in K.unit_points(df, "h", "x", "y").collect()] == [("a", 0.1, 0.8)]


def test_what_is_too_fine_raises(spark):
    with pytest.raises(ValueError, match="grid cells"):
        K.cells(spark.createDataFrame([("a", 0.2, 0.1)], "id string, x double, y double"), 1e-5)


def test_dense_and_edge_points(spark):
    rng = random.Random(5)
    rows = [(f"d{i:05d}", 0.5 + rng.uniform(0, 0.0299), 0.5 + rng.uniform(0, 0.0299)) for i in range(3_000)] + [(f"z{i}", 1.0, 1.0) for i in range(6)] + [(f"o{i}", 0.0, 0.0) for i in range(4)]
    got = K.clusters(spark.createDataFrame(rows, "id string, x double, y double"), 0.03, 5).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in got) == [6, 3_000]


def odd(kind):
    """Records that are alike only by way of others, or to a part of a group."""
    rng = random.Random(7)
    if kind == "chain":
        return [(f"c{rng.random():.6f}", 0.1 + 0.01 * i, 0.5 + 0.0002 * i) for i in range(70)]
    if kind == "bridge":  # one record beside a group of its own, within the limit of some of the group
        group = [(f"g{i:02d}", 0.3 + 0.0007 * i, 0.3) for i in range(40)]
        return group + [("a0", 0.3545, 0.3), ("z0", 0.2715, 0.3), ("z1", 0.27, 0.33)] + [(f"p{i}", 0.7 + 0.025 * i, 0.7) for i in range(4)]
    if kind == "edges":  # exactly at the limit, or next to it, at the borders of cells
        return [(f"e{i:02d}{j}", 0.00375 * i, 0.03 * j) for i in range(60) for j in range(9)]
    if kind == "sparse":
        return [(f"s{i:03d}", rng.random(), rng.random()) for i in range(900)]
    by_place = sorted((rng.uniform(0.4, 0.5), rng.uniform(0.4, 0.5)) for _ in range(1_500))
    return [(f"d{i:04d}", x, y) for i, (x, y) in enumerate(by_place)]  # dense, ids from left to right


@pytest.mark.parametrize("kind", ["chain", "bridge", "edges", "sparse", "dense"])
def test_records_that_are_alike_by_way_of_others(spark, kind):
    rows = odd(kind)
    random.Random(1).shuffle(rows)
    want = brute(rows)
    assert want
    got = K.clusters(spark.createDataFrame(rows, "id string, x double, y double"), 0.03, 5).collect()
    assert len(got) == len(want) and {(r.cluster, r.id) for r in got} == want
