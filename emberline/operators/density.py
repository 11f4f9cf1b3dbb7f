"""Densities, one-dimensional projections of strings, and the grouping built from both."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import clean as C
from emberline.functions import text as X
from emberline.operators import loda
from emberline.operators.loda import sparse_cuts as sparse_cuts
from emberline.plans.durable import dropped, written
from emberline.sources import sinks

#: Different values of a group beyond which they are first counted in bins of 1/BINS of their range.
BINS = 4_096


def kde_grid(df: DataFrame, by: str, value: str, points: int = 50) -> DataFrame:
    """by, i, x, density: Gaussian density of the values on `points` places from the group's
    smallest to its largest value, bandwidth (4 s^5 / 3 n)^(1/5).

    Equal values enter once with their count, and values are counted in at most BINS bins of
    the group's range (an error of at most half a bin, 1/8192 of the range, in a value's place),
    so the grid is evaluated for a bounded number of values however many rows there are. A
    group whose values are all equal has one point of density 1."""
    v = df.select(F.col(by).alias("by"), C.finite(value).alias("v")).where("by IS NOT NULL AND v IS NOT NULL")
    n = v.groupBy("by", "v").agg(F.count("*").alias("c"))
    # moments from counts, so the pass over the rows is the one above
    s = n.groupBy("by").agg(F.sum("c").alias("n"), F.count("*").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(F.col("c") * F.col("v")).alias("s1"), F.sum(F.col("c") * F.col("v") * F.col("v")).alias("s2"))
    sd = F.sqrt(F.greatest(F.try_divide(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.col("n") - 1.0), F.lit(0.0)))
    s = s.select("by", "n", "k", "lo", "hi", F.pow(F.lit(4.0) * F.pow(sd, 5) / (F.lit(3.0) * F.col("n")), F.lit(0.2)).alias("h"))
    j = n.join(s, "by")
    at = F.when(F.col("k") <= BINS, F.col("v")).otherwise(F.col("lo") + (F.floor(F.least((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS, F.lit(BINS - 1.0))) + 0.5) * (F.col("hi") - F.col("lo")) / BINS)
    j = j.groupBy("by", "n", "lo", "hi", "h", at.alias("v")).agg(F.sum("c").alias("c"))
    grid = F.when(F.col("hi") > F.col("lo"), F.sequence(F.lit(0), F.lit(points - 1))).otherwise(F.array(F.lit(0)))
    g = j.withColumn("i", F.explode(grid)).withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1))
    z = (F.col("x") - F.col("v")) / F.col("h")
    term = F.when(F.col("hi") > F.col("lo"), F.col("c") * F.exp(-z * z / 2) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).otherwise(F.col("c").cast("double") / F.col("n"))
    return g.groupBy("by", "i", "x").agg(F.sum(term).alias("density")).select(F.col("by").alias(by), "i", "x", "density")


def extrema(grid: DataFrame, by: str) -> DataFrame:
    """Grid points that are a minimum (no higher than before, lower than after) or a maximum
    (no lower than before, higher than after); a single point is a maximum."""
    w = Window.partitionBy(by).orderBy("i")  # as many rows as grid points
    y = F.col("density")
    g = grid.withColumns({"p": F.lag("density").over(w), "q": F.lead("density").over(w)})
    kind = F.when((y <= F.col("p")) & (y < F.col("q")), "min").when((y >= F.col("p")) & (y > F.col("q")), "max").when(F.col("p").isNull() & F.col("q").isNull(), "max")
    return g.withColumn("kind", kind).where("kind IS NOT NULL").select(by, "i", "x", "density", "kind")


def loda_scores(df: DataFrame, key: str, vec: str, cuts: Sequence[Sequence[float]], bins: int | None = None) -> DataFrame:
    """Scores of the rows from histograms of the same rows, see `loda.fit` and `Loda.score`."""
    return loda.fit(df, vec, np.asarray(cuts), bins).score(df, key, vec)


def loda_explain(df: DataFrame, key: str, vec: str, cuts: Sequence[Sequence[float]], bins: int | None = None) -> DataFrame:
    """What makes the rows stand out from the same rows, see `loda.fit` and `Loda.explain`."""
    return loda.fit(df, vec, np.asarray(cuts), bins).explain(df, key, vec)


def fastmap(dl: Column, dr: Column, d: Column) -> Column:
    """Place on the line through two pivots: (dl^2 + D^2 - dr^2) / 2D, 0 if the pivots coincide."""
    return F.when(d == 0, F.lit(0.0)).otherwise((dl * dl + d * d - dr * dr) / (F.lit(2.0) * d))


def residual(distance: Column, a: Column, b: Column) -> Column:
    """Distance left in the remaining dimensions."""
    return F.sqrt(F.greatest(distance * distance - (a - b) * (a - b), F.lit(0.0)))


def _set_distance(a: Column, b: Column) -> Column:
    """V.jaccard for arrays without repeats: the union's size comes from the two sizes."""
    share = lambda both: 1 - F.coalesce(F.try_divide(both, (F.size(a) + F.size(b) - both).cast("double")), F.lit(1.0))
    return F.transform(F.array(F.size(F.array_intersect(a, b))), share)[0]  # the intersection is made once


def _shingle_ids(c: Column, k: int) -> Column:
    """X.shingles as 64-bit hashes, cut by one pass of a pattern, so that time is linear in the text."""
    cut = F.when(F.length(c) > k, F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))).otherwise(X.characters(c))
    return F.array_distinct(F.transform(cut, lambda x: F.xxhash64(x)))


def fit_pivots(df: DataFrame, group: str, key: str, features: str, iters: int = 5) -> DataFrame:
    """group, l, r, d: for each group two far-apart members by repeatedly going to the member
    farthest from the last one (ties by key). All groups share each round's aggregation;
    `max_by` combines before the shuffle, and only one row per group comes out of a round and
    is broadcast to the next. `features` are arrays without repeats."""
    far = written(df.groupBy(group).agg(F.min_by(features, F.xxhash64(key)).alias("r")).withColumn("l", F.col("r")))
    for _ in range(iters):
        # the distance is a column of its own, so it is taken once a row and the pivot goes no further
        j = df.join(F.broadcast(far.select(group, "r")), group).select(group, features, F.struct(_set_distance(F.col(features), F.col("r")).alias("d"), F.col(key).alias("k")).alias("o"))
        to = j.groupBy(group).agg(F.max_by(features, "o").alias("to"))
        far = written(to.join(far, group).select(group, F.col("r").alias("l"), F.col("to").alias("r")))
    return far.withColumn("d", _set_distance(F.col("l"), F.col("r")))


class StringGroups:
    """Fitted string groups: a `cuts` list of lengths, and per part of the lengths its pivots
    (l, r as shingle hashes, d their distance), the maxima `tops` of its density, and the
    representative of each maximum. All of it is as short as the density's grid."""

    def __init__(self, shingle: int, cuts: list[float], pivots: DataFrame, tops: DataFrame, representatives: DataFrame | None = None):
        self.shingle, self.cuts, self.pivots, self.tops, self.representatives = shingle, cuts, pivots, tops, representatives

    def save(self, path: str) -> None:
        sinks.save_table_model(self.pivots.sparkSession, path, {"shingle": self.shingle, "cuts": self.cuts}, pivots=self.pivots, tops=self.tops, representatives=self.representatives)

    @staticmethod
    def load(spark: SparkSession, path: str) -> StringGroups:
        meta, t = sinks.load_table_model(spark, path, "pivots", "tops", "representatives")
        return StringGroups(meta["shingle"], meta["cuts"], t["pivots"], t["tops"], t["representatives"])

    def _cut(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """key, h (hash of the string), part and f, the shingles, of the strings that aren't null or empty."""
        rows = df.select(F.col(key).alias("key"), F.col(text).alias("s")).where("s IS NOT NULL AND s <> ''")
        # a sum, not a filter by a lambda: over a session's first table, Spark pushes a join filter made from the lambda to the side without the text
        part = sum(((F.length("s") > F.lit(float(c))).cast("int") for c in self.cuts), F.lit(0))
        return rows.select("key", F.xxhash64("s").alias("h"), part.alias("part"), _shingle_ids(F.col("s"), self.shingle).alias("f"))

    def _place(self, cut: DataFrame) -> DataFrame:
        """key, h, part, x0: the string's place on the line through its part's pivots."""
        d = cut.join(F.broadcast(self.pivots), "part").select("key", "h", "part", "d", _set_distance(F.col("f"), F.col("l")).alias("dl"), _set_distance(F.col("f"), F.col("r")).alias("dr"))  # one row of pivots per part
        return d.select("key", "h", "part", fastmap(F.col("dl"), F.col("dr"), F.col("d")).alias("x0"))

    def _nearest(self, placed: DataFrame) -> DataFrame:
        """key, h, group, off: the nearest maximum of the part; a part without one is one group."""
        near = F.array_min(F.transform("tops", lambda t, i: F.struct(F.abs(t - F.col("x0")).alias("d"), i.alias("i"))))
        got = placed.join(F.broadcast(self.tops), "part", "left").withColumn("b", F.coalesce(near, F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("i"))))
        return got.select("key", "h", F.concat_ws(".", "part", "b.i").alias("group"), F.col("b.d").alias("off"))

    def transform(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """key, group, representative of any strings, also ones that were not fitted on. A length
        or a place beyond the fitted ones belongs to the nearest; a part that no fitted string
        was in has no pivots, its strings no row."""
        got = self._nearest(self._place(self._cut(df, key, text)))
        return got.join(F.broadcast(self.representatives), "group", "left").select(F.col("key").alias(key), "group", "representative")  # one row per group


def fit_string_groups(df: DataFrame, key: str, text: str, shingle: int = 4, iters: int = 5, points: int = 200) -> tuple[StringGroups, DataFrame]:
    """The groups of strings by resemblance, and what `transform` gives for the fitted strings.

    Lengths are split at the minima of their density; within each part strings are projected to
    a line by shingle sets, and each goes to the nearest maximum of the projections' density
    (a part without a maximum is one group). The string nearest to the maximum represents the
    group, ties by key. Null and empty strings are left out."""
    rows = df.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.length(text).alias("len"), F.lit(1).alias("one"))
    cuts = [r.x for r in extrema(kde_grid(rows, "one", "len", points), "one").where("kind = 'min'").orderBy("x").collect()]  # at most half the grid
    model = StringGroups(shingle, cuts, None, None)
    cut = written(model._cut(df, key, text))
    model.pivots = written(fit_pivots(cut, "part", "key", "f", iters).select("part", "l", "r", "d"))
    placed = written(model._place(cut))
    dropped(cut)
    model.tops = written(extrema(kde_grid(placed, "part", "x0", points), "part").where("kind = 'max'").groupBy("part").agg(F.sort_array(F.collect_list("x")).alias("tops")))
    got = model._nearest(placed)
    # tables between hold no texts, those of the representatives are read again; a repeated key is told apart by the hash
    least = written(got.groupBy("group").agg(F.min(F.struct("off", "key", "h")).alias("o")).select("group", "o.key", "o.h"))
    texts = df.select(F.col(key).alias("k"), F.col(text).alias("s"), F.xxhash64(text).alias("g")).where("s IS NOT NULL AND s <> ''")
    model.representatives = written(texts.join(F.broadcast(least), F.col("k").eqNullSafe(F.col("key")) & (F.col("g") == F.col("h"))).groupBy("group").agg(F.min("s").alias("representative")))  # one row per group
    return model, got.join(model.representatives, "group").select(F.col("key").alias(key), "group", "representative")


def string_groups(df: DataFrame, key: str, text: str, shingle: int = 4, iters: int = 5, points: int = 200) -> DataFrame:
    """key, group, representative of the strings, see `fit_string_groups`."""
    return fit_string_groups(df, key, text, shingle, iters, points)[1]


def _shifted(cell: str, axis: int, by: int) -> Column:
    return F.transform(cell, lambda x, k: F.when(k == axis, x + by).otherwise(x))


#: Length of the diagonal of a unit cube by metric, in the metric's own measure.
_DIAGONAL = {1.0: lambda d: float(d), 2.0: lambda d: math.sqrt(d), 0.5: lambda d: float(d * d)}


def dbscan(df: DataFrame, key: str, cols: Sequence[str], eps: float, min_points: int, metric: float = 2.0, parts: int = 8, rounds: int = 60) -> DataFrame:
    """key, cluster: density clusters of the points `cols` (any number of coordinates), -1 for
    noise, clusters numbered by size. `metric` is the p of the distance (sum |d|^p)^(1/p): 1, 2 or 0.5.

    Rows are counted in small cubes whose diagonal is eps/parts, and distances are measured
    between cube centres, so a distance may be off by at most eps/parts. A cube is core if
    the cubes within eps hold `min_points` rows. Neighbouring cubes are found by an
    equi-join on coarse cells; a dense spot is one cube however many rows it holds, so no
    pairs of rows are ever made. Components are merged until nothing changes."""
    d = len(cols)
    side = eps / (parts * _DIAGONAL[metric](d))
    reach = math.ceil(eps / side)
    at = F.array(*[F.floor(C.finite(c) / side) for c in cols])
    rows = df.select(F.col(key).alias("__key"), at.alias("at")).where(~F.exists("at", lambda x: x.isNull()))
    sq = written(rows.groupBy("at").agg(F.count("*").alias("n")).select("at", "n", F.transform("at", lambda x: F.floor(x / reach)).alias("cell"), F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("id")))
    around = sq.select("cell", F.col("at").alias("oat"), F.col("n").alias("m"), F.col("id").alias("other"))
    for i in range(d):  # every cell next to its own, one coordinate after the other
        around = around.withColumn("cell", F.explode(F.array(*[_shifted("cell", i, s) for s in (-1, 0, 1)])))
    gaps = F.zip_with("at", "oat", lambda a, b: F.abs(a - b).cast("double"))
    far = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + (g * g if metric == 2.0 else g if metric == 1.0 else F.sqrt(g)))
    far = F.sqrt(far) if metric == 2.0 else far if metric == 1.0 else far * far
    near = written(sq.join(around, "cell").where(far * side <= eps * (1 + 1e-12)).select("id", "other", "n", "m"))
    core = written(near.groupBy("id").agg(F.sum("m").alias("m")).where(F.col("m") >= min_points).select("id"))
    edges = written(near.select("id", "other").join(core, "id").join(core.toDF("other"), "other"))
    label = components(core, edges, rounds)
    border = near.join(core, "id", "left_anti").join(label.toDF("other", "label"), "other").groupBy("id").agg(F.min("label").alias("label"))
    every = label.unionByName(border)
    size = every.join(sq.select("id", "n"), "id").groupBy("label").agg(F.sum("n").alias("size"))
    order = size.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("size"), "label")) - 1)  # one row per cluster
    named = every.join(order, "label").select("id", "cluster")
    return rows.withColumn("id", F.array_join(F.transform("at", lambda x: x.cast("string")), ",")).join(named, "id", "left").select(F.col("__key").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id, label: the least id of each connected component; ends when nothing changes.

    In each round every label with a neighbour is hooked onto its least neighbour (of two that
    chose each other the lesser stays), the chains are jumped down to their roots, and the
    edges are drawn anew between the roots, repeats and loops dropped. A label that has an
    edge never stays alone, so each round at least halves them: `rounds` is enough for
    2^rounds nodes, and when it is hit all the same it raises. Edges count in both directions."""
    label = nodes.select("id", F.col("id").alias("label"))
    ends = edges.where("id <> other").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    ends = written(ends.withColumn("e", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).select("e.*"))
    for done in range(rounds + 1):
        if ends.isEmpty():
            least = label.groupBy("label").agg(F.min("id").alias("least"))
            return label.join(least, "label").select("id", F.col("least").alias("label"))
        if done == rounds:
            raise RuntimeError(f"components: labels still change after {rounds} rounds")
        hook = ends.groupBy("a").agg(F.min("b").alias("b"))
        mutual = hook.select(F.col("a").alias("b"), F.col("b").alias("c"))
        up = written(hook.join(mutual, "b").select("a", F.when((F.col("c") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("b")))
        while True:
            jump = written(up.select("a", "b").join(up.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"), (F.col("b") != F.col("c")).alias("moved")))
            dropped(up)
            up = jump
            if up.where("moved").isEmpty():
                break
        root = lambda c: up.select(F.col("a").alias(c), F.col("b").alias(f"{c}_up"))  # noqa: B023, E731
        old, label = label, written(label.join(root("label"), "label", "left").select("id", F.coalesce("label_up", "label").alias("label")))
        if done:
            dropped(old)
        old, ends = ends, written(ends.join(root("a"), "a").join(root("b"), "b").where("a_up <> b_up").select(F.col("a_up").alias("a"), F.col("b_up").alias("b")).distinct())
        dropped(old)
        dropped(up)
