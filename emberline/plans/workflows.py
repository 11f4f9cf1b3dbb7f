"""Queries for fitted, stored and exported models and for registered stages, with the SQL that checks them."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import clean as C
from emberline.functions import vectors as V
from emberline.operators import density, evaluation, isolation, loda, models, networks, sequences, stages, views
from emberline.plans.durable import scratch, written
from emberline.plans.relational import WE, E
from emberline.plans.security import _CUT_ROWS, _CUTS, _HF
from emberline.sources import tables as T

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


# ---- stored models and new rows ----------------------------------------------------------


@query(f"""WITH c(cut, i, w) AS (VALUES {_CUT_ROWS}), p AS (SELECT vec_id, vec_id % 2 = 0 AS own, cut, sum(w * CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, c GROUP BY 1, 2, 3), s AS (SELECT cut, min(v) AS lo, max(v) AS hi FROM p WHERE own GROUP BY 1), b AS (SELECT vec_id, own, p.cut, greatest(least(floor((v - lo) * 64 / (hi - lo)), 63), 0) AS bin FROM p JOIN s USING (cut)), h AS (SELECT cut, bin, count(*) / (SELECT count(*) FROM embeddings WHERE vec_id % 2 = 0) AS share FROM b WHERE own GROUP BY 1, 2)
 SELECT vec_id, round(sum(-ln(coalesce(share, 0) + 1e-12)) / 1000000, 8) AS score FROM b LEFT JOIN h USING (cut, bin) WHERE NOT own GROUP BY 1""")
def loda_new_rows(s: SparkSession, d: str) -> DataFrame:
    """Histograms of every other vector, stored and read back, score the vectors between them."""
    v = T.table(s, d, "embeddings").select("vec_id", "embedding")
    path = scratch(s)
    loda.fit(v.where("vec_id % 2 = 0"), "embedding", _CUTS, 64).save(path)
    return loda.Loda.load(s, path).score(v.where("vec_id % 2 = 1"), "vec_id", "embedding").withColumn("score", F.round("score", 8))


@query()
def srg_new_rows(s, d):
    """Groups of the texts with even ids, stored and read back, label the other texts."""
    docs = T.table(s, d, "documents").select("doc_id", "text")
    path = scratch(s)
    density.fit_string_groups(docs.where("doc_id % 2 = 0"), "doc_id", "text")[0].save(path)
    return density.StringGroups.load(s, path).transform(docs.where("doc_id % 2 = 1"), "doc_id", "text")


@query()
def pca_new_rows(s, d):
    """Components up to and including 99 % of the variance, fitted on the busier half of the
    hosts and applied to the rest without a new fit."""
    h = T.table(s, d, "host_aggregates").select(C.name("LogHost").alias("host"), *_HF)
    model, k = models.pca(h.where("total_logins_cnt >= 20"), _HF, 0.99, inclusive=True)
    out = model.transform(models.assembled(h.where("NOT coalesce(total_logins_cnt >= 20, false)"), _HF)).select("host", vector_to_array("pca").alias("p"))
    return out.select("host", F.transform(F.slice("p", 1, k), lambda x: F.round(x, 4)).alias("components"))


# ---- trees, forests ----------------------------------------------------------------------

_EC = ["user_id", "k", "value", "hour"]


def _labelled(s, d) -> DataFrame:
    """Events with a label that their value and hour tell in part."""
    e = E(s, d).select("event_id", "user_id", "k", "value", F.hour("ts").alias("hour"))
    return e.withColumn("label", ((F.col("value") > 120) & (F.col("hour") < 12) | (F.pmod(F.xxhash64("event_id"), F.lit(20)) == 0)).cast("double"))


@query()
def boosted_trees(s, d):
    """Scores of held-out events by trees that stopped early on rows of their own."""
    e = _labelled(s, d)
    test, stop = models.held_out("event_id", 0.2), models.held_out("event_id", 0.15, 22)
    m = models.boosted_trees(e.where(~test).withColumn("stop", stop), _EC, "label", depth=3, rounds=20, rate=0.3, stop="stop")
    return models.probability(m, e.where(test), _EC, ["event_id", "label"])


@query()
def tree_search(s, d):
    """Held-out quality of each combination of a small grid, and how many trees it kept."""
    _, rows = models.search_trees(_labelled(s, d), _EC, "label", "event_id", [(2, 0.3, 15, 0.0), (3, 0.3, 15, 0.0), (3, 0.45, 15, 0.1)])
    return s.createDataFrame([(r["depth"], r["rate"], r["rounds"], r["gain"], r["trees"], r["auc"]) for r in rows], "depth int, rate double, rounds int, gain double, trees int, auc double")


@query()
def random_forest(s, d):
    """Confusion of three classes on held-out line items."""
    h = T.table(s, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0).alias("label"))
    cols, test = ["l_quantity", "l_extendedprice", "l_discount"], models.held_out("l_orderkey", 0.2)
    m = models.forest(h.where(~test), cols, "label", trees=5, depth=4)
    return m.transform(models.assembled(h.where(test), cols)).groupBy(F.col("label"), F.col("prediction")).agg(F.count("*").alias("n"))


@query()
def logistic_regression(s, d):
    """Scores of held-out events."""
    e, test = _labelled(s, d), models.held_out("event_id", 0.2)
    return models.probability(models.logistic(e.where(~test), _EC, "label"), e.where(test), _EC, ["event_id", "label"])


@query()
def isolation_forest(s, d):
    h = T.table(s, d, "host_aggregates").select(C.name("LogHost").alias("host"), *_HF)
    return isolation.scores(h, _HF, "host", isolation.fit(h, _HF, "host"))


# ---- clusterings -------------------------------------------------------------------------

_VV = "list_transform(list_zip(a.embedding, b.embedding), lambda z: {})"
_X, _Y = "CAST(z[1] AS DOUBLE)", "CAST(z[2] AS DOUBLE)"
_L2, _L1 = f"sqrt(list_sum({_VV.format(f'({_X} - {_Y}) * ({_X} - {_Y})')}))", f"list_sum({_VV.format(f'abs({_X} - {_Y})')})"


def _sil(dist: str) -> str:
    return f"""WITH p AS (SELECT a.vec_id, a.label, b.label AS other, sum({dist}) AS s, count(*) AS n FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 GROUP BY 1, 2, 3), j AS (SELECT vec_id, label, max(s / nullif(n - 1, 0)) FILTER (WHERE other = label) AS a, max(n) FILTER (WHERE other = label) AS n, min(s / n) FILTER (WHERE other <> label) AS b FROM p GROUP BY 1, 2) SELECT vec_id, round(CASE WHEN n = 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM j"""


@query(_sil(_L2))
def silhouette(s, d):
    """Silhouette by Euclidean distance of the rows whose id is divisible by 20, against all rows."""
    v = T.table(s, d, "embeddings")
    return evaluation.silhouette(v, "vec_id", "embedding", "label", F.col("vec_id") % 20 == 0).select("vec_id", F.round("silhouette", 6).alias("silhouette"))


@query(_sil(_L1))
def silhouette_l1(s, d):
    v = T.table(s, d, "embeddings")
    return evaluation.silhouette(v, "vec_id", "embedding", "label", F.col("vec_id") % 20 == 0, "l1").select("vec_id", F.round("silhouette", 6).alias("silhouette"))


@query("WITH c AS (SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 250000 THEN 0 WHEN o_totalprice > 120000 THEN 1 ELSE 2 END AS k FROM orders), p AS (SELECT * FROM (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) t(f, o, p)) SELECT round(max(n) / (SELECT count(*) FROM c), 6) AS accuracy FROM (SELECT f, o, p.p, count(*) FILTER (WHERE (y = 'F' AND k = f) OR (y = 'O' AND k = o) OR (y = 'P' AND k = p.p)) AS n FROM c, p GROUP BY ALL)")
def matched_accuracy(s, d):
    """Accuracy of clusters under their best assignment to labels."""
    price = F.col("o_totalprice")
    o = T.table(s, d, "orders").select(F.col("o_orderstatus").alias("y"), F.when(price > 250000, 0).when(price > 120000, 1).otherwise(2).alias("k"))
    got = evaluation.matched_accuracy(o, "y", "k")
    return s.createDataFrame([(None if got is None else round(got, 6),)], "accuracy double")


_LAT = "p AS (SELECT host, min(x) AS x, min(y) AS y FROM (SELECT nullif(lower(trim(LogHost)), '') AS host, floor(uname_other_compacnt_login_frac * 25) AS x, floor(uname_that_compacnt_login_frac * 25) AS y FROM host_aggregates WHERE NOT isnan(uname_other_compacnt_login_frac) AND NOT isnan(uname_that_compacnt_login_frac) AND uname_other_compacnt_login_frac BETWEEN 0 AND 1 AND uname_that_compacnt_login_frac BETWEEN 0 AND 1) WHERE host IS NOT NULL GROUP BY 1)"


@query(f"WITH RECURSIVE {_LAT}, g AS (SELECT x, y, count(*) AS n FROM p GROUP BY 1, 2), e AS (SELECT a.x * 100 + a.y AS a, b.x * 100 + b.y AS b, b.n FROM g a JOIN g b ON abs(a.x - b.x) + abs(a.y - b.y) <= 1), core AS (SELECT a FROM e GROUP BY 1 HAVING sum(n) >= 12), ce AS (SELECT e.a, e.b FROM e JOIN core c ON c.a = e.a JOIN core d ON d.a = e.b), r(a, b) AS (SELECT a, b FROM ce UNION SELECT r.a, ce.b FROM r JOIN ce ON ce.a = r.b), l AS (SELECT a, min(b) AS label FROM r GROUP BY 1), w AS (SELECT e.a, min(l.label) AS label FROM e JOIN l ON l.a = e.b WHERE e.a NOT IN (SELECT a FROM core) GROUP BY 1), f AS (SELECT * FROM l UNION ALL SELECT * FROM w), z AS (SELECT host, label FROM p LEFT JOIN f ON f.a = x * 100 + y) SELECT CASE WHEN label IS NULL THEN 'noise' ELSE 'cluster' END AS kind, count(*) AS n FROM z GROUP BY label")
def dbscan_lattice(s, d):
    """Sizes of the density clusters of hosts on a lattice, whose distances lie clear of eps."""
    h = T.table(s, d, "host_aggregates").select(C.name("LogHost").alias("host"), *[F.col(f"uname_{w}_compacnt_login_frac").alias(c) for w, c in (("other", "x"), ("that", "y"))]).where("host IS NOT NULL AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1")
    h = h.select("host", *[(F.floor(F.col(c) * 25) * 0.04 + 0.003).alias(c) for c in ("x", "y")]).groupBy("host").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    got = density.dbscan(h, "host", ["x", "y"], 0.048, 12)
    return got.groupBy("cluster").agg(F.count("*").alias("n")).select(F.when(F.col("cluster") < 0, "noise").otherwise("cluster").alias("kind"), "n")


@query()
def dbscan_l1(s, d):
    """Density clusters by city-block distance over four shares of a host's counts."""
    cols = ["UserName_cnt", "logon_type_2", "logon_type_3", "logon_type_5"]
    h = T.table(s, d, "host_aggregates").select(C.name("LogHost").alias("host"), *[C.div(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)), F.greatest(F.col("total_logins_cnt"), F.lit(1))).alias(c) for c in cols])
    return density.dbscan(h, "host", cols, 0.1, 8, 1.0, 2)


@query()
def tsne_view(s, d):
    """Every vector's place in a plane view."""
    return views.tsne(T.table(s, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")


# ---- exported networks -------------------------------------------------------------------

_W1 = np.array([[0.5, -1.0, 0.25], [0.75, 0.5, -0.5]])
_B1, _W2, _B2 = np.array([0.1, -0.2, 0.3]), np.array([[1.0], [-0.5], [2.0]]), np.array([-0.75])
_HID = [" + ".join(f"{float(_W1[i, j])} * {c}" for i, c in enumerate(("a", "b"))) + f" + {float(_B1[j])}" for j in range(3)]


@query(WE + ", x AS (SELECT event_id, coalesce(value / 100, 0) AS a, coalesce(k / 50, 0) AS b FROM e), z AS (SELECT event_id, " + " + ".join(f"{float(_W2[j, 0])} * greatest({h}, 0)" for j, h in enumerate(_HID)) + f" + {float(_B2[0])} AS z FROM x) SELECT event_id, round(1 / (1 + exp(-z)), 6) AS score FROM z")
def onnx_score(s, d):
    """A network of two layers, exported and scored in batches."""
    e = E(s, d).select("event_id", (F.col("value") / 100).alias("a"), (F.col("k") / 50).alias("b"))
    net = networks.dense([(_W1, _B1), (_W2, _B2)], kind="double")
    return models.score_onnx(e, net, {"features": ["a", "b"]}, ["event_id"], outputs={"logit": "score"}, batch=256).withColumn("score", F.round("score", 6))


@query()
def onnx_logistic(s, d):
    """A fitted regression, exported, gives what it gives itself: the largest difference."""
    e = _labelled(s, d)
    m = models.logistic(e, _EC, "label")
    own = models.probability(m, e, _EC, ["event_id"]).withColumnRenamed("score", "own")
    exported = models.score_onnx(e.select("event_id", *_EC), networks.from_logistic(m), {"features": _EC}, ["event_id"])
    return own.join(exported, "event_id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("own") - F.col("score"))).alias("largest_difference"))


@query()
def onnx_perceptron(s, d):
    """A trained network, exported, gives what it gives itself: the largest difference on held-out rows."""
    e, test = _labelled(s, d), models.held_out("event_id", 0.2)
    scaled = e.select("event_id", "label", (F.col("value") / 200).alias("v"), (F.col("hour") / 24).alias("h"))
    m = models.perceptron(scaled.where(~test), ["v", "h"], "label")
    own = models.probability(m, scaled.where(test), ["v", "h"], ["event_id"]).withColumnRenamed("score", "own")
    exported = models.score_onnx(scaled.where(test).select("event_id", "v", "h"), networks.from_perceptron(m, "double"), {"features": ["v", "h"]}, ["event_id"])
    return own.join(exported, "event_id").agg(F.count("*").alias("n"), F.max(F.abs(F.col("own") - F.col("score"))).alias("largest_difference"))


# ---- sequences ---------------------------------------------------------------------------


@query()
def word_vectors(s, d):
    e = T.table(s, d, "events").select("ts", "event_id", "event_type")
    w = sequences.count_windows(e, ["ts", "event_id"], 10, 10, F.col("event_type"), F.lit(0))
    return models.word2vec(w.select("items"), "items")


@query()
def negative_windows(s, d):
    e = T.table(s, d, "events").select("ts", "event_id", F.concat_ws("_", "event_type", (F.col("user_id") % 50).cast("string")).alias("item"))
    w = written(sequences.count_windows(e, ["ts", "event_id"], 10, 10, F.col("item"), F.lit(0)))
    pairs = w.select("items").select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.struct(F.element_at("items", i).alias("a"), F.element_at("items", i + 1).alias("b")))).alias("p"))
    follow = pairs.groupBy(F.col("p.a").alias("first")).agg(F.collect_set("p.b").alias("seconds"))
    return models.corrupted_windows(w, "win_start", "items", models.vocabulary(w, "items"), follow)


@query()
def sampled_events(s, d):
    """For each event a type drawn from those that follow its own, at temperature 0.7."""
    e = T.table(s, d, "events").select("ts", "event_id", "event_type")
    counts = sequences.bigrams(e, ["ts", "event_id"], "event_type").groupBy("first", "second").agg(F.count("*").alias("n"))
    return models.sample_next(counts, e.select(F.col("event_id").alias("key"), F.col("event_type").alias("first")), 0.7, 3)


# ---- registered stages and distances -----------------------------------------------------


@stages.stage("value_band", ["value"], ["band"])
def value_band(df: DataFrame) -> DataFrame:
    """Low, middle or high."""
    return df.withColumn("band", F.when(F.col("value") < 50, "low").when(F.col("value") < 200, "middle").otherwise("high"))


@stages.stage("band_flag", ["band"], ["flag"])
def band_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("flag", (F.col("band") == "high").cast("int"))


@query("SELECT event_id, CASE WHEN value < 50 THEN 'low' WHEN value < 200 THEN 'middle' ELSE 'high' END AS band, CASE WHEN value < 200 THEN 0 ELSE 1 END AS flag FROM events")
def staged(s, d):
    """Two registered stages, found by name, as one pipeline."""
    from pyspark.ml import PipelineModel

    e = T.table(s, d, "events").select("event_id", "value")
    return PipelineModel([stages.REGISTRY[n]() for n in ("value_band", "band_flag")]).transform(e).select("event_id", "band", "flag")


@query(f"WITH b AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) SELECT a.vec_id, round({_L1}, 4) AS l1, round({_L2}, 4) AS l2, round(sqrt(greatest(2 - 2 * list_sum({_VV.format(f'{_X} * {_Y}')}) / (sqrt(list_sum({_VV.format(f'{_X} * {_X}')})) * sqrt(list_sum({_VV.format(f'{_Y} * {_Y}')}))), 0)), 4) AS cosine FROM embeddings a JOIN b USING (label)")
def distances_by_name(s, d):
    """Every vector's distance to its label's first by each distance of the registry that takes vectors."""
    v = T.table(s, d, "embeddings")
    r = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    return v.join(r, "label").select("vec_id", *[F.round(V.DISTANCES[n](F.col("embedding"), F.col("ref")), 4).alias(n) for n in ("l1", "l2", "cosine")])
