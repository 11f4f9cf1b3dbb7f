"""Fitted models, exported networks and evaluation against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import evaluation, isolation, models, networks, statistics


def test_network_file_scores_like_numpy(spark):
    rng = np.random.default_rng(1)
    layers = [(rng.normal(size=(3, 4)), rng.normal(size=4)), (rng.normal(size=(4, 4)), rng.normal(size=4)), (rng.normal(size=(4, 1)), rng.normal(size=1))]
    x = rng.normal(size=(700, 3))
    x[5, 1], x[6, 2] = np.nan, np.nan
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(700, None, 1.0, 2.0)], "id int, a double, b double, c double")
    want = np.nan_to_num(np.vstack([x, [np.nan, 1.0, 2.0]]))
    for w, b in layers[:-1]:
        want = np.maximum(want @ w + b, 0)
    want = 1 / (1 + np.exp(-(want @ layers[-1][0] + layers[-1][1])[:, 0]))
    for kind, off in (("float", 1e-5), ("double", 1e-12)):
        got = {r.id: r.score for r in models.score_onnx(df, networks.dense(layers, kind=kind), {"features": ["a", "b", "c"]}, ["id"], batch=64).collect()}
        assert len(got) == 701 and all(abs(got[i] - w) < off for i, w in enumerate(want))
    arrays = df.na.fill(0.0).select("id", F.array("a", "b", "c").alias("v"))
    assert models.score_onnx(arrays, networks.dense(layers), {"features": ["v"]}, ["id"], sigmoid=False, outputs={"logit": "z"}).columns == ["id", "z"]
    assert models.score_onnx(df.limit(0), networks.dense(layers), {"features": ["a", "b", "c"]}, ["id"]).count() == 0
    for bad in ({"features": ["a", "b"]}, {"other": ["a", "b", "c"]}):
        with pytest.raises(ValueError, match="input"):
            models.score_onnx(df, networks.dense(layers), bad, ["id"])
    with pytest.raises(ValueError, match="outputs"):
        models.score_onnx(df, networks.dense(layers), {"features": ["a", "b", "c"]}, ["id"], outputs={"no": "s"})


def test_exported_regression(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)]
    df = spark.createDataFrame([(*r, float(r[1] - r[2] + rng.gauss(0, 0.5) > 0)) for r in rows], "id int, a double, b double, y double")
    m = models.logistic(df, ["a", "b"], "y")
    own = {r.id: r.score for r in models.probability(m, df, ["a", "b"], ["id"]).collect()}
    got = {r.id: r.score for r in models.score_onnx(df, networks.from_logistic(m), {"features": ["a", "b"]}, ["id"]).collect()}
    assert all(abs(own[i] - got[i]) < 1e-5 for i in own)


def test_exported_perceptron(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, a, b, float(a * b > 0)) for i in range(400) for a, b in [(rng.gauss(0, 1), rng.gauss(0, 1))]], "id int, a double, b double, y double")
    m = models.perceptron(df, ["a", "b"], "y", (6, 5))
    own = {r.id: r.score for r in models.probability(m, df, ["a", "b"], ["id"]).collect()}
    got = {r.id: r.score for r in models.score_onnx(df, networks.from_perceptron(m, "double"), {"features": ["a", "b"]}, ["id"]).collect()}
    assert all(abs(own[i] - got[i]) < 1e-9 for i in own) and max(own.values()) > 0.9


def test_isolation_finds_the_odd_rows(spark):
    rng = random.Random(3)
    rows = [(f"u{i}", rng.gauss(0, 1), rng.gauss(5, 1)) for i in range(2_000)] + [("odd1", 9.0, 5.0), ("odd2", 0.0, -20.0), ("odd3", float("nan"), 40.0), ("gap", None, 5.0)]
    df = spark.createDataFrame(rows, "c0 string, a double, b double").repartition(3)
    model = isolation.fit(df, ["a", "b"], "c0")
    s = {r.c0: r.score for r in isolation.scores(df, ["a", "b"], "c0", model).collect()}
    assert len(s) == 2_004 and {"odd1", "odd2", "odd3"} <= set(sorted(s, key=s.get)[-30:]) and s["gap"] < 0.6 and all(0 < v < 1 for v in s.values())
    assert 0.3 < np.median(list(s.values())) < 0.55
    empty = isolation.fit(df.limit(0), ["a", "b"], "c0")
    assert isolation.scores(df.limit(3), ["a", "b"], "c0", empty).where("score IS NULL").count() == 3
    same = spark.createDataFrame([("x", 1.0, 1.0)] * 9, "c0 string, a double, b double")
    assert isolation.scores(same, ["a", "b"], "c0", isolation.fit(same, ["a", "b"], "c0")).count() == 9


def test_tree_search_learns_and_stops_early(spark):
    rng = random.Random(4)
    rows = [(i, rng.random(), rng.random()) for i in range(1_500)]
    df = spark.createDataFrame([(i, a, b, float((a > 0.5) != (b > 0.3)) if rng.random() < 0.97 else 1.0) for i, a, b in rows], "id int, a double, b double, y double")
    model, got = models.search_trees(df, ["a", "b"], "y", "id", [(1, 0.3, 3, 0.0), (3, 0.3, 25, 0.0)])
    assert [r["depth"] for r in got] == [1, 3] and got[1]["auc"] > 0.9 > got[0]["auc"] and got[1]["trees"] < 25 and model.getNumTrees == got[1]["trees"]
    assert len(models.TREE_GRID) == 24


def test_draws_follow_the_temperature(spark):
    counts = spark.createDataFrame([("a", "x", 80), ("a", "y", 15), ("a", "z", 5), ("a", "never", 0), ("b", "x", 1)], "first string, second string, n int")
    draws = spark.range(20_000).select(F.col("id").alias("key"), F.lit("a").alias("first"))
    for t, k, want in ((1.0, None, {"x": 0.8, "y": 0.15, "z": 0.05}), (0.5, None, {"x": 6400 / 6650, "y": 225 / 6650, "z": 25 / 6650}), (1.0, 2, {"x": 80 / 95, "y": 15 / 95})):
        got = Counter(r.second for r in models.sample_next(counts, draws, t, k).collect())
        assert got.keys() == want.keys() and all(abs(got[x] / 20_000 - p) < 0.01 for x, p in want.items())
    assert models.sample_next(counts, spark.createDataFrame([(1, "none"), (2, "b")], "key int, first string")).orderBy("key").collect() == [(1, "none", None), (2, "b", "x")]


@pytest.mark.parametrize("metric", ["l1", "l2", "cosine"])
def test_silhouette(spark, metric):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(90, 4)) + 1, rng.integers(0, 3, 90)
    c[0] = 7  # alone
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, c))] + [(200, None, 1), (201, [0.0] * 4, None)], "id int, v array<double>, c int").repartition(4)
    d = np.abs(x[:, None] - x).sum(2) if metric == "l1" else np.sqrt(((x[:, None] - x) ** 2).sum(2)) if metric == "l2" else 1 - (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    got = {r.id: r.silhouette for r in evaluation.silhouette(df, "id", "v", "c", F.col("id") % 3 == 0, metric).collect()}
    assert got.keys() == {i for i in range(90) if i % 3 == 0}
    for i, s in got.items():
        a = d[i][(c == c[i]) & (np.arange(90) != i)]
        b = min(d[i][c == k].mean() for k in set(c) - {c[i]})
        assert abs(s - (0 if not len(a) else (b - a.mean()) / max(a.mean(), b))) < 1e-9
    one = evaluation.silhouette(df.where("c = 1"), "id", "v", "c", F.lit(True), metric)
    assert one.where("silhouette IS NOT NULL").count() == 0 < one.count()
    assert evaluation.silhouette(df.limit(0), "id", "v", "c", F.lit(True), metric).count() == 0


def test_too_many_classes_raise(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "MOST_CLASSES", 3)
    with pytest.raises(ValueError, match="more than 3"):
        evaluation.matched_accuracy(spark.range(8).select("id", F.col("id").alias("c")), "id", "c")


def brute_history(rows):
    """(count, sum, min, max) of the earlier values of each row's entity, by id."""
    out, seen = {}, {}
    for i, who, _, v in sorted(rows, key=lambda r: (r[2], r[0])):
        have = [x for x in seen.get(who, []) if x is not None]
        out[i] = (len(have), sum(have) if have else None, min(have, default=None), max(have, default=None))
        seen.setdefault(who, []).append(v)
    return out


def test_history_of_a_busy_entity(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot"] * 8 + ["b", "c", None]), rng.randrange(200), rng.choice([None, *range(-5, 9)])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "id int, who string, t int, v int").repartition(7).withColumn("n", F.lit("kept"))
    v = F.col("v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = statistics.history(df, "who", ["t", "id"], {"cnt": ("count", v), "s": ("sum", v), "lo": ("min", v), "hi": ("max", v)})
        got = {r.id: (r.cnt, r.s, r.lo, r.hi) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute_history(rows) and out.columns == ["id", "who", "t", "v", "n", "cnt", "s", "lo", "hi"]
    assert statistics.history(df.limit(0), "who", ["t", "id"], {"cnt": ("count", v)}).count() == 0


def test_sketches_of_senders(spark):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta"]
    rows = [(i, rng.choice(["s", "s", "t", None]), i // 3, rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(1, 9)))])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, who string, t int, text string").repartition(5)
    got = {r.id: r for r in statistics.sketch_similarity(df, "who", ["t", "id"], "id", F.filter(F.split("text", " "), lambda x: x != "")).collect()}
    bag, sims, n = {}, {}, Counter()
    for i, who, _, text in rows:
        if who is None:
            assert i not in got
            continue
        mine, have = Counter(x for x in (text or "").split(" ") if x), bag.setdefault(who, Counter())
        norm = math.sqrt(sum(c * c for c in have.values())) * math.sqrt(sum(c * c for c in mine.values()))
        sim = None if not n[who] else sum(c * have[w] for w, c in mine.items()) / norm if norm else 0.0
        old = sims.setdefault(who, [])
        drift = (np.mean(old) - sim) / np.var(old, ddof=1) if len(old) > 1 and np.var(old, ddof=1) > 1e-12 else -1.0
        r = got[i]
        assert r.n_before == n[who] and (r.similarity is None) == (sim is None) and (sim is None or abs(r.similarity - sim) < 1e-9)
        assert abs(r.drift - drift) < 1e-6 * max(1, abs(drift))
        have.update(mine)
        n[who] += 1
        if sim is not None:
            old.append(sim)


def test_mean_entropies_are_those_of_the_rows(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["x"] * 6 + ["y", None]), rng.choice([1, 2, None]), rng.choice("pqr")) for _ in range(400)] + [("lone", 77, "z")]
    df = spark.createDataFrame(rows, "a string, b int, c string")
    pairs = [f"ent_{p}_{q}" for p in "abc" for q in "abc" if p != q]
    want = {r.a: r for r in statistics.pairwise_entropies(df, ["a", "b", "c"]).where("a IS NOT NULL").groupBy("a").agg(F.count("*").alias("n"), *[F.avg(p).alias(p) for p in pairs]).collect()}
    got = {r.a: r for r in statistics.mean_entropies(df, ["a", "b", "c"], "a").collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k].n == want[k].n and all(got[k][p] == want[k][p] or abs(got[k][p] - want[k][p]) < 1e-9 for p in pairs)
    assert statistics.mean_entropies(df.limit(0), ["a", "b", "c"], "a").count() == 0


def test_word_vectors_in_several_tasks(spark):
    df = spark.createDataFrame([(["a", "b", "c"],)] * 30, "items array<string>")
    assert models.word2vec(df, "items", rows_a_task=10).count() == 3
    with pytest.raises(ValueError, match="different items"):
        many = spark.range(models.MOST_ITEMS + 1).select(F.array(F.col("id").cast("string")).alias("items"))
        models.vocabulary(many, "items")
