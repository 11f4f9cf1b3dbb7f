import random

import pytest
from pyspark.sql import functions as F

from emberline.operators import sessions


def brute(rows, gap):
    by = {}
    for e, t in rows:
        if e is not None and t is not None:
            by.setdefault(e, []).append(t)
    out = []
    for e, ts in by.items():
        ts.sort()
        cur = [ts[0], ts[0], 1]
        for t in ts[1:]:
            if t - cur[1] > gap:
                out.append((e, *cur))
                cur = [t, t, 1]
            else:
                cur[1], cur[2] = t, cur[2] + 1
        out.append((e, *cur))
    return sorted(out)


def got(tree, gap):
    return sorted((r.entity, r.start_time, r.end_time, r.n_records) for r in sessions.sessions_at(tree, gap).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_threshold_from_one_tree(frame, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(3)]) if rng.random() < 0.05 else int(rng.choice([5, 40, 300, 2000]) ** 2 * rng.random())) for _ in range(300)]
    rows += [("tie", t) for t in (0, 10, 20, 30, 60, 90, 100)] + [("one", 5)] + [("same", 7)] * 4
    df = frame(rows, "who string, t bigint").withColumn("chunk", F.lit("clash")).withColumn("n", F.lit(0))
    tree = sessions.session_tree(df, "who", "t", shortest=1, longest=10_000_000, chunk_s=500).cache()
    for gap in (1, 9, 10, 29, 30, 99, 500, 5_000, 9_999_999):
        assert got(tree, gap) == brute(rows, gap), gap


def test_thresholds_inside_the_bounds(frame):
    rng = random.Random(9)
    rows = [("a", rng.randrange(200_000)) for _ in range(400)]
    tree = sessions.session_tree(frame(rows, "who string, t bigint"), "who", "t", shortest=60, longest=3_600, chunk_s=3_600)
    for gap in (60, 300, 1_800, 3_600):
        assert got(tree, gap) == brute(rows, gap), gap
    both = sessions.sessions_for(tree, [300, 1_800]).groupBy("gap_s").count().collect()
    assert {r.gap_s: r["count"] for r in both} == {g: len(brute(rows, g)) for g in (300, 1_800)}


def test_exact_gap_belongs_and_empty_is_empty(frame):
    tree = sessions.session_tree(frame([("a", 0), ("a", 1_800), ("a", 3_601)], "who string, t bigint"), "who", "t")
    assert got(tree, 1_800) == [("a", 0, 1_800, 2), ("a", 3_601, 3_601, 1)]
    assert got(sessions.session_tree(frame([], "who string, t bigint"), "who", "t"), 1_800) == []
    assert got(sessions.session_tree(frame([(None, 1), ("x", None)], "who string, t bigint"), "who", "t"), 1_800) == []


def test_thresholds_outside_the_bounds_raise(frame, tmp_path):
    rows = [("a", t) for t in (0, 20, 50, 200, 400, 500_000, 700_000)]
    tree = sessions.session_tree(frame(rows, "who string, t bigint"), "who", "t")
    for gap in (10, 59, 86_401, 300_000):
        with pytest.raises(ValueError, match="outside the tree's bounds 60 to 86400"):
            sessions.sessions_at(tree, gap)
        with pytest.raises(ValueError, match="outside"):
            sessions.sessions_for(tree, [1_800, gap])
    for gap in (60, 86_400):
        assert sum(n for *_, n in got(tree, gap)) == len(rows) and got(tree, gap) == brute(rows, gap)
    tree.write.parquet(f"{tmp_path}/tree")  # a stored tree keeps its bounds
    again = tree.sparkSession.read.parquet(f"{tmp_path}/tree")
    assert got(again, 100) == brute(rows, 100)
    with pytest.raises(ValueError, match="outside"):
        sessions.sessions_at(again, 10)
    with pytest.raises(ValueError, match="no bounds"):
        sessions.sessions_at(frame([("a", 0, 0, 1, 0, sessions.NO_PARENT)], sessions.TREE), 100)
