"""Edge cases of the reference operators on small hand-made rows."""

import math
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from emberline.functions import clean as C
from emberline.functions import text as X
from emberline.functions import url as U
from emberline.functions import vectors as V
from emberline.operators import density, encode, evaluation, graph, hosts, joins, predicates, sampling, sequences, statistics
from emberline.sources import readers, sinks
from emberline.sources import tables as T


def one(df):
    return [tuple(r) for r in df.collect()]


def test_names_and_clocks(frame):
    df = frame([(" A b ", 5), ("", 0), ("   ", None), (None, 99_999_999_999), ("x", 100_000_000_000)], "n string, t bigint")
    got = {(r.n, r.t): (r.a, r.f, r.g) for r in df.select("*", C.name("n").alias("a"), C.flow_ms("t").alias("f"), C.log_s("t").alias("g")).collect()}
    assert got[" A b ", 5] == ("a b", 5_000, 5) and got["", 0] == (None, None, 0) and got["   ", None] == (None, None, None)
    assert got[None, 99_999_999_999] == (None, 99_999_999_999_000, 99_999_999_999) and got["x", 100_000_000_000] == ("x", 100_000_000_000, 100_000_000_000)
    assert one(frame([(20_486,)], "d int").select(C.yyyymmdd("d"))) == [(20260202,)]


def test_flows_merge_repeats(spark):
    base = (1_769_990_431, 1.0, " A", "b", 6, None, 1, 1, 1, 1, 1)
    again = (1_769_990_431_000, 1.0, "a ", "B", 6, None, 1, 1, 1, 1, 1)
    other = (None, float("nan"), None, "", 6, None, 1, 1, 1, 1, -1)
    schema = "time bigint, Duration double, SrcDevice string, DstDevice string, Protocol int, SrcPort int, DstPort int, SrcPackets bigint, DstPackets bigint, SrcBytes bigint, DstBytes bigint"
    df = spark.createDataFrame([base, again, other, other], schema).withColumn("ms", F.lit("clash"))
    assert T.flows(df).count() == 2


def test_null_handling(frame):
    df = frame([(1.0, None), (float("inf"), 2.0), (float("nan"), 4.0), (3.0, None)], "a double, b double")
    assert sorted(one(predicates.impute_median(df, ["a", "b"]))) == [(1.0, 3.0), (2.0, 2.0), (2.0, 4.0), (3.0, 3.0)]
    assert sorted(one(predicates.drop_non_finite(df, ["a"]).select("a"))) == [(1.0,), (3.0,)]
    assert predicates.non_null_columns(df.withColumn("c", F.lit(None).cast("int"))) == ["a", "b"]
    assert one(predicates.missing_profile(df, ["a", "b"])) == [("b", 2, 50.0)]
    empty = frame([], "a double, b double")
    assert one(predicates.missing_profile(empty, ["a", "b"])) == [] and one(predicates.impute_median(empty, ["a"])) == []
    r = frame([(1, 0), (0, 0), (1, 2), (None, 1)], "x int, y int").select(predicates.safe_ratio(F.col("x"), F.col("y")))
    assert sorted(one(r), key=str) == sorted([(-1.0,), (None,), (0.5,), (None,)], key=str)


def test_uncorrelated_and_constant(frame):
    df = frame([(float(i), 2.0 * i + 1, -float(i), 7.0) for i in range(20)], "a double, b double, c double, d double")
    assert predicates.uncorrelated(df, ["a", "b", "c", "d"]) == ["a", "c", "d"]  # signed, and a constant has no correlation
    assert predicates.frequency_diversity(df, ["a", "d"]).where("n_frequencies = 1").count() == 2


def test_joins(frame):
    rows = frame([(1, "x"), (2, None), (3, "z")], "id int, k string")
    refs = frame([(2, ["x", "y"], "two"), (1, ["y", "x", None], "one"), (3, None, "no")], "o int, ks array<string>, v string")
    assert sorted(one(joins.first_match(rows, refs, "k", F.col("ks"), ["o"], ["v"]))) == [(1, "x", "one"), (2, None, None), (3, "z", None)]
    e = frame([("a", "b"), ("b", "a"), ("a", "a"), (None, "b"), ("a", "c")], "p string, q string")
    assert sorted(one(joins.neighbours(e, "p", "q"))) == [("a", ["b", "c"]), ("b", ["a"]), ("c", ["a"])]
    got = joins.full_outer_add(frame([("a", 1)], "k string, n int"), frame([("a", 2), ("b", None)], "k string, n int"), "k", "n")
    assert sorted(one(got)) == [("a", 3), ("b", 0)]
    t = joins.triplets(frame([(i, i % 3) for i in range(9)], "id int, g int"), "id", "g").collect()
    assert len(t) == 9 and all(r.anchor % 3 == r.positive % 3 != r.negative % 3 and r.anchor != r.positive for r in t)


def test_nearest_reference_without_catalogue(frame):
    v = frame([(1, [0.0, 1.0])], "id int, v array<double>")
    assert one(joins.nearest_reference(v, frame([], "l string, v array<double>"), "v", "l", 1.0, "others", "id")) == [(1, "others", None)]


def test_sequences(frame):
    rows = [(random.Random(1).random() + i, i, "abc"[i % 3]) for i in range(23)]
    df = frame(rows, "t double, id int, x string", 5)
    assert sorted((r.rn, r.id) for r in sequences.numbered(df, ["t", "id"]).collect()) == [(i, i) for i in range(23)]
    w = {r.win_start: r["items"] for r in sequences.count_windows(df, ["t"], 5, 2, F.col("x"), F.lit(0)).collect()}
    assert sorted(w) == list(range(0, 19, 2)) and all(v == ["abc"[(s + i) % 3] for i in range(5)] for s, v in w.items())
    assert sequences.count_windows(df, ["t"], 24, 1, F.col("x"), F.lit(0)).count() == 0
    assert sequences.count_windows(frame([], "t double, id int, x string"), ["t"], 3, 1, F.col("x"), F.lit(0)).count() == 0
    b = sequences.bigrams(df, ["t"], "x", block=4)
    assert sorted(one(b)) == [(i, "abc"[i % 3], "abc"[(i + 1) % 3]) for i in range(22)]
    s = sequences.prefix_sums(df, ["t"], {"c": "id"})
    assert sorted((r.id, r.c) for r in s.collect()) == [(i, i * (i + 1) // 2) for i in range(23)]
    g = frame([(["a", "b", "c"],), (["a"],), ([],)], "a array<string>").select(sequences.grams(F.col("a"), 2))
    assert sorted(one(g)) == sorted([([["a", "b"], ["b", "c"]],), ([],), ([],)])


def test_sampling(frame):
    df = frame([(i, i % 4 == 0, i % 2) for i in range(40)], "id int, y boolean, g int")
    got = sampling.under_sample(df, F.col("y"), 0.5, "id")
    assert got.where("y").count() == 10 and got.where("NOT y").count() == 20
    assert sampling.under_sample(df, F.col("y"), 0.1, "id").count() == 40
    assert sorted(one(sampling.dedup_negatives(df, F.col("y"), ["g"], "id").where("NOT y").select("id"))) == [(1,), (2,)]


def test_entropy_and_association(frame):
    df = frame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "f string, t int")
    got = {r.f: r.entropy for r in statistics.conditional_entropy(df, "f", "t").collect()}
    assert got["b"] is None and abs(got["a"] - 1) < 1e-12
    two = frame([(x, y) for x, y, n in (("a", 0, 8), ("a", 1, 2), ("b", 0, 3), ("b", 1, 7)) for _ in range(n)], "x string, y int")
    r, c, n = (10, 10), (11, 9), 20
    chi = sum((abs(o - r[i] * c[j] / n) - 0.5) ** 2 / (r[i] * c[j] / n) for i, j, o in ((0, 0, 8), (0, 1, 2), (1, 0, 3), (1, 1, 7)))
    assert abs(statistics.cramers_v(two, "x", "y").first().v - math.sqrt(chi / n)) < 1e-9
    assert statistics.cramers_v(frame([("a", 1)], "x string, y int"), "x", "y").first().v is None
    h = statistics.histogram(frame([(0.0,), (5.0,), (10.0,), (float("nan"),), (None,)], "v double"), "v", 10)
    assert sorted(one(h)) == [(0, 1), (5, 1), (9, 1)]
    assert one(statistics.histogram(frame([(3.0,), (3.0,)], "v double"), "v", 4)) == [(0, 2)]


def test_evaluation(frame):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.4), (0, 0.1)]
    df = frame(rows, "y int, s double")
    curve = evaluation.score_curve(df, "y", "s")
    pairs = [(p, q) for y, p in rows if y for z, q in rows if not z]
    assert abs(evaluation.roc_auc(curve).first().auc - sum((p > q) + (p == q) / 2 for p, q in pairs) / len(pairs)) < 1e-12
    assert abs(evaluation.average_precision(curve).first().average_precision - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-12
    assert evaluation.youden(curve).first().threshold == 0.5
    assert evaluation.roc_auc(evaluation.score_curve(df.where("y = 1"), "y", "s")).first().auc is None
    same = frame([(0, "p"), (0, "p"), (1, "q"), (2, "r"), (2, "q")], "a int, b string")
    assert evaluation.matched_accuracy(same, "a", "b") == 0.8
    assert evaluation.agreement(frame([(i, i) for i in range(4)], "a int, b int"), "a", "b").first().ari == 1.0


def test_graph(frame):
    e = frame([("a", "b"), ("a", "b"), ("a", "c"), ("b", "a")], "src string, dst string")
    assert {(r.src, r.dst): round(r.w, 3) for r in graph.normalised_adjacency(e, "src", "dst").collect()} == {("a", "b"): 0.667, ("a", "c"): 0.333, ("b", "a"): 1.0}
    lap = {(r.src, r.dst): r.w for r in graph.laplacian(e, "src", "dst").collect()}
    assert abs(lap["a", "a"] - 1 / 3) < 1e-12 and abs(lap["a", "b"] - 1 / math.sqrt(6)) < 1e-12 and lap["b", "a"] == lap["a", "b"]
    f = graph.fan_out(e, frame([("a",)], "n string"), [1, 5])
    assert f.where("hop = 0").count() == 1 and {r.src for r in f.where("hop = 1").collect()} <= {"b", "c"}
    neg = {(r.src, r.dst) for r in graph.negative_edges(e).collect()}
    assert not neg & {("a", "b"), ("a", "c"), ("b", "a")}
    tx = frame([(i, i % 2, i % 3) for i in range(6)], "id int, m int, u int")
    t, m, u = graph.tripartite_ids(tx, ["id"], "m", "u", "id")
    assert sorted(r.tx_id for r in t.collect()) == list(range(6)) and sorted(r.merchant_id for r in m.collect()) == [6, 7] and sorted(r.user_id for r in u.collect()) == [8, 9, 10]
    assert graph.tripartite_edges(t, m, u, "m", "u").count() == 24


def test_url_parts(frame):
    rows = ["http://a.b.example.co.uk:80/x//y?p=1&q=2#f", "'www.example.com\n'", "http://192.0.2.1/", "", "http://user@h.test", "ftp://www.x.test/a"]
    df = frame([(r,) for r in rows], "u string")
    got = {r.u: r for r in df.select("u", U.split_host(U.parts(U.with_scheme(F.col("u")))["host"]).alias("h"), *U.structural(F.col("u"), F.lit(1)), U.without_prefix(F.col("u")).alias("w")).collect()}
    first = got[rows[0]]
    assert tuple(first.h) == ("a.b", "example", "co.uk") and first.queries_amount == 2 and first.fragments_amount == 1 and first.path_double_slash_counts == 1 and first.path_slash_counts == 3
    assert tuple(got[rows[1]].h) == ("www", "example", "com") and tuple(got[rows[2]].h) == ("", "192.0.2.1", "") and tuple(got[rows[4]].h) == ("", "h", "test")
    assert got[rows[3]].domain_len == 0 and got[rows[5]].w == "w.x.test/a"[0:] or got[rows[5]].w.endswith("x.test/a")


def test_text_functions(frame):
    df = frame([("ab^c",), ("",), (None,), ("x" * 120,)], "s string")
    got = {r.s: r for r in df.select("s", X.code_points(F.col("s"), 6).alias("c"), X.shingles(F.col("s"), 4).alias("g"), X.spaced(F.col("s")).alias("p")).collect()}
    assert got["ab^c"].c == [97, 98, 0, 99, 0, 0] and got[""].c == [0] * 6 and got[None].c is None and len(got["x" * 120].c) == 6
    assert got["ab^c"].g == ["a", "b", "^", "c"] and got["x" * 120].g == ["xxxx"] and got[""].g == [] and got[None].p == ""
    ids = frame([(["a", "?", "b"],)], "t array<string>").select(X.vocabulary_ids(F.col("t"), {"a": 1, "b": 2}, 4).alias("k"), X.vocabulary_ids(F.col("t"), {"a": 1, "b": 2}, 4, False).alias("d")).first()
    assert ids.k == [1, 0, 2, 0] and ids.d == [1, 2, 0, 0]
    assert one(frame([("$1,234.50",), ("no",), (None,)], "s string").select(X.money(F.col("s")))).count((None,)) == 2


def test_vectors(frame):
    o = frame([("10.1.2.3.4",), ("1.x",), ("",), (None,), ("256.1",)], "s string").select("s", V.ip_octets(F.col("s")).alias("o")).collect()
    got = {r.s: [round(x * 255, 3) for x in r.o] for r in o}
    assert got == {"10.1.2.3.4": [10, 1, 2, 3], "1.x": [1, 0, 0, 0], "": [0] * 4, None: [0] * 4, "256.1": [256, 1, 0, 0]}
    m = frame([({"a": 1.0, "b": 2.0}, {"b": 1.0})], "x map<string,double>, y map<string,double>").select(V.weighted_jaccard(F.col("x"), F.col("y"))).first()[0]
    assert abs(m - (1 - 1 / 3)) < 1e-12
    z = frame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b")), V.unit(F.col("a"))).first()
    assert z[0] is None and z[1] == [0.0, 0.0]


def test_densities(frame):
    rng = random.Random(3)
    rows = [("g", rng.gauss(10, 1)) for _ in range(200)] + [("g", rng.gauss(30, 1)) for _ in range(200)] + [("c", 5.0)] * 3 + [("c", None)]
    grid = density.kde_grid(frame(rows, "g string, v double"), "g", "v", 100).cache()
    assert grid.where("g = 'c'").count() == 1
    e = density.extrema(grid, "g")
    assert [r.kind for r in e.where("g = 'g' AND kind = 'min'").collect()] == ["min"] and e.where("g = 'c'").first().kind == "max"
    vecs = frame([(i, [float(i % 5), float(i % 3)]) for i in range(60)] + [(99, [50.0, 50.0]), (100, None), (101, [float("nan"), 0.0])], "id int, v array<double>")
    s = {r.id: r.score for r in density.loda_scores(vecs, "id", "v", [[1.0, 0.0], [0.0, 1.0]], 10).collect()}
    assert len(s) == 61 and max(s, key=s.get) == 99
    names = [(i, f"user {i % 7} logged in from host{i % 3}") for i in range(30)] + [(100 + i, f"disk failure on array {i} needs attention right now please") for i in range(30)] + [(200, None), (201, "")]
    g = density.string_groups(frame(names, "id int, s string"), "id", "s").collect()
    assert len(g) == 60 and not {r.group for r in g if r.id < 100} & {r.group for r in g if r.id >= 100}


def brute_dbscan(pts, eps, least, p):
    """(core points, near points of each)."""
    dist = lambda a, b: sum(abs(x - y) ** p for x, y in zip(a, b)) ** (1 / p)
    near = {k: [j for j, v in pts.items() if dist(u, v) <= eps] for k, u in pts.items()}
    return {k for k in near if len(near[k]) >= least}, near


@pytest.mark.parametrize(("dims", "metric", "eps", "parts"), [(2, 2.0, 0.03, 30), (1, 2.0, 0.01, 30), (3, 1.0, 0.05, 6), (2, 0.5, 0.06, 8)])
def test_dbscan_matches_brute_force(frame, dims, metric, eps, parts):
    rng = random.Random(8)
    pts = {f"p{i}": tuple(rng.gauss(c, 0.01) for c in random.Random(i % 3).choices([0.2, 0.5, 0.8], k=dims)) for i in range(150)} | {f"n{i}": tuple(rng.random() for _ in range(dims)) for i in range(20)}
    names = [f"x{i}" for i in range(dims)]
    df = frame([(k, *v) for k, v in pts.items()] + [("gone", *[None] * dims)], "at string, " + ", ".join(f"{n} double" for n in names))
    got = {r["at"]: r.cluster for r in density.dbscan(df, "at", names, eps, 5, metric, parts).collect()}
    assert got.keys() == pts.keys()
    core, near = brute_dbscan(pts, eps, 5, metric)
    wrong = sum((got[k] == -1) != (k not in core and not core & set(near[k])) for k in near)
    assert wrong <= 6 if parts < 10 else wrong <= 2  # distances are off by up to eps/parts
    assert sum(got[k] != got[j] for k in core for j in near[k] if j in core) <= 8


def test_dbscan_is_exact_on_a_lattice(frame):
    """Points whose distances lie clear of eps come out as they are."""
    rng = random.Random(4)
    pts = {f"q{i}": (rng.randrange(30) * 0.1 + 0.013, rng.randrange(30) * 0.1 + 0.007) for i in range(260)}
    got = {r.k: r.cluster for r in density.dbscan(frame([(k, *v) for k, v in pts.items()], "k string, x double, y double"), "k", ["x", "y"], 0.12, 3).collect()}
    core, near = brute_dbscan(pts, 0.12, 3, 2)
    assert all((got[k] == -1) == (k not in core and not core & set(near[k])) for k in pts)
    root = {k: k for k in core}
    find = lambda k: k if root[k] == k else find(root[k])
    for k in core:
        for j in near[k]:
            if j in core:
                root[find(k)] = find(j)
    groups = {}
    for k in core:
        groups.setdefault(find(k), set()).add(got[k])
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_string_groups_label_new_strings(spark, frame, tmp_path):
    names = [(i, f"user {i % 7} logged in from host{i % 3}") for i in range(60)] + [(100 + i, f"disk failure on array {i % 9} needs attention right now please") for i in range(60)] + [(200, None), (201, "")]
    model, own = density.fit_string_groups(frame(names, "id int, s string"), "id", "s")
    mine = {r.id: (r.group, r.representative) for r in own.collect()}
    assert len(mine) == 120 and {(r.id, (r.group, r.representative)) for r in model.transform(frame(names, "id int, s string"), "id", "s").collect()} == set(mine.items())
    model.save(f"{tmp_path}/m")
    again = density.StringGroups.load(spark, f"{tmp_path}/m")
    new = frame([(1, "user 5 logged in from host1"), (2, "disk failure on array 4 needs attention right now please"), (3, "user 9 logged in from host8"), (4, None), (5, "x" * 500)], "id int, s string")
    got = {r.id: r.group for r in again.transform(new, "id", "s").collect()}
    same = {r.s: mine[r.id][0] for r in frame(names, "id int, s string").collect() if r.s}
    assert got[1] == same["user 5 logged in from host1"] and got[2] == same["disk failure on array 4 needs attention right now please"]
    assert got[3].split(".")[0] == got[1].split(".")[0] and 4 not in got and got.keys() <= {1, 2, 3, 5}


_FRESH = """
import sys
from pyspark.sql import SparkSession
from emberline.operators.density import StringGroups

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
at = sys.argv[1]
texts = spark.read.parquet(at + "/texts")  # the first table of the session
got = StringGroups.load(spark, at + "/m").transform(texts, "id", "s")
print("GROUPS", sorted((r.id, r.group, r.representative) for r in got.collect()))
"""


def test_string_groups_label_the_first_table_of_a_session(spark, frame, tmp_path):
    words = frame([(0, [1, 2], [3], 1.0), (1, [1], [2], 1.0), (2, [1], [2], 1.0)], "part int, l array<bigint>, r array<bigint>, d double")
    tops = frame([(i, [0.5]) for i in range(3)], "part int, tops array<double>")
    first = frame([(f"{i}.0", f"text {i}") for i in range(3)], "group string, representative string")
    density.StringGroups(4, [5.0, 9.5], words, tops, first).save(f"{tmp_path}/m")
    frame([(1, "short"), (2, "longer"), (3, "the longest"), (4, ""), (5, None)], "id int, s string").write.parquet(f"{tmp_path}/texts")
    run = subprocess.run([sys.executable, "-c", _FRESH, str(tmp_path)], capture_output=True, text=True, timeout=300)
    assert "GROUPS [(1, '0.0', 'text 0'), (2, '1.0', 'text 1'), (3, '2.0', 'text 2')]" in run.stdout, run.stderr[-2000:]


def test_loda_scores_new_rows_and_both_ways_agree(spark, frame, tmp_path, monkeypatch):
    from emberline.operators import loda

    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(400)] + [(900, None), (901, [1.0]), (902, [1.0, 2.0, float("nan"), 0.0, 0.0])]
    df = frame(rows, "id int, v array<double>")
    loda.fit(df, "v", loda.sparse_cuts(5, 30), 20).save(f"{tmp_path}/m")
    model = loda.Loda.load(spark, f"{tmp_path}/m")
    assert model.n == 400
    new = frame([(1, [0.0] * 5), (2, [9.0] * 5), (3, None)], "id int, v array<double>")
    s = {r.id: r.score for r in model.score(new, "id", "v").collect()}
    assert s.keys() == {1, 2} and s[2] > s[1]
    t = {(r.id, r.feature): r.t for r in model.explain(df, "id", "v").collect()}
    sent = {r.id: r.score for r in model.score(df, "id", "v").collect()}
    monkeypatch.setattr(loda, "MOST_SENT", 0)
    assert not model.sent
    joined = {r.id: r.score for r in model.score(df, "id", "v").collect()}
    other = {(r.id, r.feature): r.t for r in model.explain(df, "id", "v").collect()}
    assert sent.keys() == joined.keys() and all(abs(sent[k] - joined[k]) < 1e-12 for k in sent)
    assert t.keys() == other.keys() and all(t[k] == other[k] or abs(t[k] - other[k]) < 1e-6 for k in t)
    empty = loda.fit(df.limit(0), "v", loda.sparse_cuts(5, 3))
    assert empty.n == 0 and empty.score(new, "id", "v").count() == 2


def test_host_features_add_up_over_blocks(frame):
    rows = [(1, 4624, 2, "h", "h$", "d", "s", None), (2, 4624, 2, "h", "x$", "d", None, None), (3, 4625, 3, "h", None, None, "s", None), (4, 4648, None, "k", "u", "d", None, "h"), (5, None, None, None, None, None, "z", None)]
    schema = "time_s bigint, event_id int, logon_type int, log_host string, user_name string, domain_name string, source string, destination string"
    a = sorted(one(hosts.host_features(frame(rows, schema, 1))), key=str)
    b = sorted(one(hosts.host_features(frame(rows, schema, 5))), key=str)
    assert a == b
    h = next(r for r in hosts.host_features(frame(rows, schema)).collect() if r.LogHost == "h")
    assert (h.total_logins_cnt, h.accnt_fail_logon_cnt, h.UserName_cnt, h.Source_cnt, h.logon_explicit_cred_to_cnt, h.logon_type_2, h.logon_type_frm_2, h.uname_other_compacnt_login_cnt, h.uname_that_compacnt_login_frac) == (2, 1, 2, 1, 1, 2, 1, 1, 0.5)
    assert {r[0] for r in a} == {"h", "k", "s", "z"} and hosts.host_features(frame([], schema)).count() == 0


def test_encoders(frame):
    df = frame([("a",), ("b",), (None,), ("b",)], "c string")
    t = encode.ordinal_table(df, "c")
    assert sorted(one(t)) == [("a", 1), ("b", 2)]
    e = encode.binary_encode(frame([("b",), ("zz",), (None,)], "c string"), "c", t, 2, "c")
    assert sorted(one(e), key=str) == sorted([("b", 1, 0), ("zz", 0, 0), (None, 0, 0)], key=str)


def test_snapshot_files(spark, tmp_path):
    d = tmp_path / "snapshot-1"
    d.mkdir()
    (d / "urls_2026-02-03_10-25-58.4.json").write_text('{"plugin": "urls", "titles": ["PID", "URL", "SHA256"], "data": [[1, "http://a.test", "x"], [2, null, "y"]], "count": 2}')
    (d / "vad_2026-02-03_10-25-59.json").write_text('{"plugin": "vadinfo", "titles": ["PID", "SHA256", "URL"], "data": [[3, "http://b.test"]], "count": 1}')
    (d / "broken_2026-02-03_10-26-00.json").write_text('{"plugin": "urls", "titles": [')
    got = sorted(one(readers.snapshots(spark, str(tmp_path), ["PID", "URL", "Gone"])), key=str)
    assert got == [("1", "http://a.test", None, "urls", "snapshot-1", "2026-02-03_10-25-58.4"), ("2", None, None, "urls", "snapshot-1", "2026-02-03_10-25-58.4"), ("3", "http://b.test", None, "vadinfo", "snapshot-1", "2026-02-03_10-25-59")]
    assert readers.snapshots(spark, str(tmp_path), ["PID"], ["urls"]).count() == 2


def test_stores(spark, frame, tmp_path):
    sinks.save_table_model(spark, str(tmp_path / "m"), {"k": 3}, refs=frame([(1, 2.0)], "a int, b double"))
    meta, t = sinks.load_table_model(spark, str(tmp_path / "m"), "refs")
    assert meta == {"k": 3} and one(t["refs"]) == [(1, 2.0)]
    arr = tmp_path / "a.json"
    arr.write_text('[{"a": {"b": 1}}, {"a": null}]')
    assert sorted(one(predicates.flatten(readers.json_array(spark, str(arr)))), key=str) == [(1,), (None,)]


def test_a_store_survives_a_failed_compaction(spark, frame, tmp_path):
    store = sinks.SketchStore(spark, f"{tmp_path}/s")
    assert store.read().count() == 0
    store.compact()
    store.append(frame([("a", "x", 2), ("b", "y", 1)], "entity string, item string, n bigint"))
    store.append(frame([("a", "x", 3), ("a", None, 1)], "entity string, item string, n bigint"))
    want = sorted([("a", "x", 5), ("b", "y", 1), ("a", None, 1)], key=str)
    half = tmp_path / "s" / "gen-1"  # what a compaction that died left behind
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"torn")
    assert sorted(one(store.read()), key=str) == want
    store.compact()
    assert sorted(one(store.read()), key=str) == want and [p.name for p in (tmp_path / "s").iterdir()] == ["gen-1"]
    store.append(frame([("b", "y", 1)], "entity string, item string, n bigint"))
    assert ("b", "y", 2) in one(sinks.SketchStore(spark, f"{tmp_path}/s").read())


def test_stages(frame):
    import pytest

    from emberline.operators.stages import REGISTRY, stage

    @stage("double_it", ["a"], ["b"])
    def double_it(df):
        return df.withColumn("b", F.col("a") * 2)

    assert one(REGISTRY["double_it"]().transform(frame([(2,)], "a int"))) == [(2, 4)]
    with pytest.raises(ValueError, match="missing"):
        double_it().transform(frame([(2,)], "x int"))


def test_loda_explains_the_odd_feature(frame):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(300)] + [(999, [0.0, 0.0, 12.0, 0.0])]
    t = {r.feature: r.t for r in density.loda_explain(frame(rows, "id int, v array<double>"), "id", "v", density.sparse_cuts(4, 40).tolist(), 20).where("id = 999").collect()}
    assert max(t, key=lambda j: t[j] or 0) == 2


def test_distance_registry(frame):
    df = frame([([1.0, 0.0], [0.0, 1.0])], "a array<double>, b array<double>")
    got = {n: df.select(f(F.col("a"), F.col("b"))).first()[0] for n, f in V.DISTANCES.items() if n in ("l1", "l2", "cosine")}
    assert got == {"l1": 2.0, "l2": math.sqrt(2), "cosine": math.sqrt(2)}
