import random

import numpy as np

from emberline.llm import mixing as M


def test_flight_keeps_both_totals():
    rng = random.Random(2)
    size = [float(rng.choice([0, 1, 5, 5, 900, 40])) for _ in range(500)]
    p = [rng.random() for _ in size]
    q = M.flight(p, size, np.random.default_rng(1).random(500))
    assert sum(0 < x < 1 for x in q) <= 2
    assert abs(sum(p) - sum(q)) < 1e-6 and abs(sum(a * s for a, s in zip(p, size)) - sum(a * s for a, s in zip(q, size))) < 1e-3


def test_flight_is_unbiased():
    size, p = [1.0, 2.0, 4.0, 8.0, 3.0, 3.0], [0.5] * 6
    mean = np.mean([M.flight(p, size, np.random.default_rng(i).random(6)) for i in range(4_000)], 0)
    assert np.abs(mean - 0.5).max() < 0.04


def test_long_documents_fly_first():
    rng = np.random.default_rng(3)
    size = np.sort(np.round(np.exp(rng.normal(4, 1.6, 3_000))))[::-1]
    p = rng.random(3_000)
    q = M.long_flight(p, size, rng)
    open_ = (q > M.EPS) & (q < 1 - M.EPS)
    assert abs(p.sum() - q.sum()) < 1e-6 and abs(p @ size - q @ size) < 1e-3
    assert size[open_].max() <= M.LONG * size[open_].mean() < size.max() and 3 < open_.sum() < 3_000
    one = [M.long_flight(np.full(40, 0.4), np.array([900.0] + [float(x) for x in range(39, 0, -1)]), np.random.default_rng(i))[0] for i in range(2_000)]
    assert abs(np.mean(one) - 0.4) < 0.04  # unbiased
    assert (M.long_flight(np.full(5, 0.5), np.full(5, 7.0), rng) == 0.5).all() and M.long_flight(np.zeros(0), np.zeros(0), rng).size == 0


def test_reserve():
    assert M.reserve([5.0, 7.0], [0, 1]) == [0, 1] and M.reserve([], []) == []
    size = [float(x) for x in range(1, 3_000)]
    kept = M.reserve(size, list(range(len(size))))
    lengths = sorted(size[i] for i in kept)
    assert len(set(kept)) == M.LANDING and lengths[: M.SHORTEST] == [1, 2, 3, 4] and all(x <= 1 + sum(lengths[:i]) for i, x in enumerate(lengths)) and lengths[-1] > 1_000
    assert len(M.reserve([0.0] * 40 + [900.0], list(range(41)))) == M.LANDING


def test_landing():
    rng = np.random.default_rng(5)
    assert M.landing([], [], rng) == [] and M.landing([0.5], [9.0], rng) in ([0.0], [1.0])
    assert M.landing([0.5, 0.5], [10.0, 30.0], rng) in ([1.0, 0.0], [0.0, 1.0])
    for _ in range(20):
        p, s = rng.random(18).tolist(), rng.integers(5, 400, 18).astype(float).tolist()
        c = M.landing(p, s, rng)
        assert abs(sum(c) - sum(p)) < 1 and abs(sum(a * b for a, b in zip(c, s)) - sum(a * b for a, b in zip(p, s))) <= min(s)
    mean = np.mean([M.landing([0.3] * 10, [7.0] * 10, rng) for _ in range(3_000)], 0)
    assert np.abs(mean - 0.3).max() < 0.05  # equal documents land alike


def test_sizes_with_caps():
    assert M.mixture_size({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}) == {"a": 20.0, "b": 20.0}
    assert M.mixture_size({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 100) == {"a": 80.0, "b": 20.0}
    assert M.mixture_size({"a": 100}, {"a": 0.5, "gone": 0.5}, {"a": 1, "gone": 1}) == {"a": 100.0, "gone": 0.0}
    assert M.mixture_size({}, {"a": 1.0}, {"a": 1}) == {"a": 0.0}


def test_mixture(spark):
    rng = random.Random(3)
    docs = [(i, "big" if i % 3 else rng.choice(["small", "mid", "other", None]), rng.choice([0, 5, 50, 400, 3_000])) for i in range(6_000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("mid", 0.2, 2), ("gone", 0.1, 5), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = M.mix(df, targets)
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    caps = {"big": 1, "small": 3, "mid": 2}
    assert all(1 <= r.copies <= caps[r.source] for r in rows)
    total = sum(r.copies * r.n_tokens for r in rows)
    for s, share in (("big", 0.5 / 0.9), ("small", 0.2 / 0.9), ("mid", 0.2 / 0.9)):
        got = sum(r.copies * r.n_tokens for r in rows if r.source == s)
        goal = next(x["goal_tokens"] for x in report if x["source"] == s)
        assert abs(got - goal) <= 5 and abs(got / total - share) < 1e-3
        x = next(x for x in report if x["source"] == s)
        assert abs(sum(r.copies for r in rows if r.source == s) - x["each"] * x["n_docs"]) < 1.001  # and its documents
    again = {(r.doc_id, r.copies) for r in M.mix(df.repartition(9), targets)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}


def test_blocks_and_edges(spark):
    docs = [(i, "s", 10 + i % 17) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint").withColumn("prob", __import__("pyspark").sql.functions.lit(0.3))
    got = M.balanced_sample(df, {"s": 900}, block=50).collect()
    assert len(got) == 900 and {r.prob for r in got} == {0.0, 1.0}
    assert abs(sum(r.prob for r in got) - 270) <= 3 and abs(sum(r.prob * r.n_tokens for r in got) - 0.3 * sum(n for _, _, n in docs)) <= 9
    targets = spark.createDataFrame([("s", 1.0, 2)], "source string, target_share double, max_repeats int")
    empty = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint")
    assert M.mix(empty, targets)[0].count() == 0 and M.mix(empty, targets.limit(0))[0].count() == 0
    zero = spark.createDataFrame([(1, "s", 0)], "doc_id bigint, source string, n_tokens bigint")
    assert M.mix(zero, targets)[0].count() == 0
