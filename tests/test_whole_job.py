"""Operators do the whole job: no row, character, coordinate or component is left out."""

import math
import random
from statistics import stdev

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from emberline.functions import text as X
from emberline.functions import vectors as V
from emberline.operators import density, sampling
from emberline.plans import registry


def test_class_split_keeps_every_row(frame):
    rows = [(i, "a") for i in range(50)] + [(100 + i, "b") for i in range(7)] + [(200 + i, None) for i in range(4)] + [(300, "c")]
    random.Random(1).shuffle(rows)
    got = {r.k: r.part for r in sampling.class_split(frame(rows, "k int, c string"), "c", 20, 0.8, "k").collect()}
    assert len(got) == len(rows)
    train = {k for k, p in got.items() if p == "train"}
    assert train == {*range(16), *range(100, 105), *range(200, 203)}


def gauss_grid(values, points=50):
    """Exact densities on the grid, every value by itself."""
    lo, hi, n = min(values), max(values), len(values)
    h = (4 * stdev(values) ** 5 / (3 * n)) ** 0.2
    xs = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    return xs, [sum(math.exp(-(((x - v) / h) ** 2) / 2) for v in values) / (n * h * math.sqrt(2 * math.pi)) for x in xs]


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_kde_covers_documents_of_any_length(spark):
    folder = str(DATA / "sf0.001")
    lengths = {}
    for r in spark.read.parquet(folder + "/documents.parquet").where("lang IS NOT NULL AND n_chars IS NOT NULL").collect():
        lengths.setdefault(r.lang.lower(), []).append(float(r.n_chars))
    assert max(map(max, lengths.values())) > 3000
    grid = {(r.lang, r.i): (r.x, r.density) for r in registry.queries()["kde_grid"](spark, folder).collect()}
    kinds = {(r.lang, r.i): r.kind for r in registry.queries()["kde_extrema"](spark, folder).collect()}
    want, places = {}, {}
    for g, v in lengths.items():
        xs, ys = gauss_grid(v) if min(v) < max(v) else ([v[0]], [1.0])
        want |= {(g, i): (x, y * 1000) for i, (x, y) in enumerate(zip(xs, ys))}
        places |= {(g, i): "min" for i in range(1, len(ys) - 1) if ys[i] <= ys[i - 1] and ys[i] < ys[i + 1]}
        places |= {(g, i): "max" for i in range(1, len(ys) - 1) if ys[i] >= ys[i - 1] and ys[i] > ys[i + 1]} | ({(g, 0): "max"} if len(ys) == 1 else {})
    assert grid.keys() == want.keys()
    assert all(grid[k] == pytest.approx(want[k], rel=1e-6, abs=1e-3) for k in want)
    assert kinds == places


def test_kde_in_bins_is_close_to_brute_force(frame):
    rng = random.Random(2)
    values = [float(int(rng.lognormvariate(7, 1))) + i / 10_000 for i, _ in enumerate(range(6_000))]
    assert len(set(values)) > density.BINS
    got = {r.i: (r.x, r.density) for r in density.kde_grid(frame([("g", v) for v in values], "g string, v double"), "g", "v").collect()}
    xs, ys = gauss_grid(values)
    top = max(ys)
    assert [got[i][0] for i in range(50)] == pytest.approx(xs) and all(abs(got[i][1] - y) < 1e-3 * top for i, y in enumerate(ys))


def snake(rows, wide):
    """Squares of a winding path, neighbours in a row one after the other."""
    out = []
    for r in range(rows):
        line = [(i, 2 * r) for i in range(wide)]
        out += (line if r % 2 == 0 else line[::-1]) + ([((wide - 1) * (r % 2 == 0), 2 * r + 1)] if r < rows - 1 else [])
    return out


@pytest.mark.parametrize("names", ["places", "shuffled"])
def test_components_of_a_winding_path_are_one(frame, names):
    path = snake(12, 30)
    ids = [f"{i},{j}" for i, j in path]
    if names == "shuffled":
        random.Random(3).shuffle(ids)
    far = [f"x{i}" for i in range(3)]  # a triangle, and a node without an edge
    pairs = [*zip(ids, ids[1:]), *zip(far, far[1:] + far[:1])]
    edges = frame([p for a, b in pairs for p in ((a, b), (b, a))], "id string, other string")
    got = {r.id: r.label for r in density.components(frame([(x,) for x in [*ids, *far, "y"]], "id string"), edges, 12).collect()}
    assert got == {x: min(ids) for x in ids} | {x: "x0" for x in far} | {"y": "y"}


def test_components_raise_at_the_bound(frame):
    edges = frame([("a", "b"), ("b", "a")], "id string, other string")
    with pytest.raises(RuntimeError, match="still change"):
        density.components(frame([("a",), ("b",)], "id string"), edges, 0).collect()


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_string_groups_cover_all_documents(spark):
    folder = str(DATA / "sf0.001")
    text = {r.doc_id: r.text for r in spark.read.parquet(folder + "/documents.parquet").where("text <> ''").collect()}
    got = {r.doc_id: r for r in registry.queries()["srg_label"](spark, folder).collect()}
    assert got.keys() == text.keys() and max(map(len, text.values())) > 3000
    reps = {r.group: r.representative for r in got.values()}
    assert len(reps) > 1 and all(r.representative == reps[r.group] and any(text[k] == reps[r.group] for k in got if got[k].group == r.group) for r in got.values())


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_string_groups_of_event_types(spark):
    words = spark.read.parquet(str(DATA / "sf0.001") + "/event_types.parquet").select("EventID", "description")
    got = density.string_groups(words, "EventID", "description").collect()
    assert len(got) == words.where("description <> ''").count() and len({r.group for r in got}) > 1


def test_hashed_shingles_have_the_distances_of_shingles(frame):
    rows = [("a line\nand another one", "a line and one"), ("abc", "abcd"), ("aaaaaa", "aaaaa"), ("x\U0001f600y\U0001f600zz", "\U0001f600y\U0001f600z"), ("\u00fcber alles", "uber alles")]
    d = frame(rows, "a string, b string").select(V.jaccard(X.shingles(F.col("a"), 4), X.shingles(F.col("b"), 4)), density._set_distance(density._shingle_ids(F.col("a"), 4), density._shingle_ids(F.col("b"), 4))).collect()
    assert all(r[0] == r[1] for r in d)


def test_loda_sees_every_coordinate(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(200)]
    rows[77][1][40] = 60.0  # odd in one coordinate far behind the eighth
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    score = {r.vec_id: r.score for r in registry.queries()["loda_score"](spark, str(tmp_path)).collect()}
    assert len(score) == 200 and max(score, key=score.get) == 77
    # brute force
    cuts = density.sparse_cuts(64, 1_000)
    vecs = np.array([v for _, v in rows], dtype="float32").astype(float)
    bins, want = int(200 / math.log(200)), np.zeros(200)
    for p in (vecs @ cuts.T).T:
        at = np.minimum(np.floor((p - p.min()) * bins / (p.max() - p.min())), bins - 1).astype(int)
        want -= np.log(np.bincount(at, minlength=bins)[at] / 200 + 1e-12)
    assert sum(abs(score[i] - w) > 2e-8 for i, w in enumerate(want / 1_000**2)) <= 4  # a value on a bin's edge
    t = {r.feature: r.t for r in registry.queries()["loda_explain"](spark, str(tmp_path)).where("vec_id = 77").collect()}
    assert len(t) == 64 and max(t, key=lambda j: t[j] or 0) == 40
