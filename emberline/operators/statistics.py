"""Entropies, encodings of frequency, association measures, histograms, scalings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import clean as C
from emberline.operators.sequences import ordered
from emberline.plans.durable import written


def conditional_entropy(df: DataFrame, feature: str, target: str) -> DataFrame:
    """feature, n, entropy of target within the feature value, divided by ln n; null for n = 1.

    Two aggregations, of pairs and of their counts: a value with most of the rows is combined
    to its distinct pairs before it meets its own kind. Null targets are a value of their own."""
    pairs = df.where(F.col(feature).isNotNull()).groupBy(feature, target).agg(F.count("*").alias("__c"))
    own = pairs.groupBy(feature).agg(F.sum("__c").alias("__n"), F.sum(F.col("__c") * F.log("__c")).alias("__l"))
    return own.select(feature, F.col("__n").alias("n"), F.when(F.col("__n") > 1, (F.log("__n") - F.col("__l") / F.col("__n")) / F.log("__n")).alias("entropy"))


def pairwise_entropies(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """`df` with a column ent_a_b (of b within a) for each ordered pair of the features."""
    out = df
    for a in features:
        for b in features:
            if a != b:
                out = out.join(conditional_entropy(df, a, b).select(a, F.col("entropy").alias(f"ent_{a}_{b}")), a, "left")
    return out


def mean_entropies(df: DataFrame, features: Sequence[str], by: str) -> DataFrame:
    """by, n and ent_a_b for each ordered pair of the features: the mean over the group's rows
    of what `pairwise_entropies` adds to them. `by` is one of the features; rows without it
    are in no group, but count in the entropies.

    Rows are counted once per combination of all features; those counts are all that is joined
    or averaged, never rows, and one aggregation of (pair, value, other value) makes all
    entropies. A value's entropies come to its group by its counts with it."""
    counts = written(df.groupBy(*features).agg(F.count("*").alias("__c")))
    text = lambda c: F.col(c).cast("string")
    pairs = [(a, b) for a in features for b in features if a != b]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("__p"), text(a).alias("__v"), text(b).alias("__w")) for i, (a, b) in enumerate(pairs)])).alias("__x")
    joint = counts.select("__c", each).select("__c", "__x.*").where("__v IS NOT NULL").groupBy("__p", "__v", "__w").agg(F.sum("__c").alias("__c"))
    own = joint.groupBy("__p", "__v").agg(F.sum("__c").alias("__n"), F.sum(F.col("__c") * F.log("__c")).alias("__l"))
    own = own.select("__p", "__v", F.when(F.col("__n") > 1, (F.log("__n") - F.col("__l") / F.col("__n")) / F.log("__n")).alias("__e"))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("__p"), text(a).alias("__v")) for i, (a, _) in enumerate(pairs)])).alias("__x")
    grouped = counts.where(F.col(by).isNotNull()).select(F.col(by).alias("__by"), "__c", near).select("__by", "__c", "__x.*").where("__v IS NOT NULL").groupBy("__by", "__p", "__v").agg(F.sum("__c").alias("__c"))
    j = grouped.join(own, ["__p", "__v"]).where("__e IS NOT NULL")
    means = [F.try_divide(F.sum(F.when(F.col("__p") == i, F.col("__c") * F.col("__e"))), F.sum(F.when(F.col("__p") == i, F.col("__c"))).cast("double")).alias(f"ent_{a}_{b}") for i, (a, b) in enumerate(pairs)]
    size = counts.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("__by")).agg(F.sum("__c").alias("n"))
    return size.join(j.groupBy("__by").agg(*means), "__by", "left").withColumnRenamed("__by", by)


def frequency_encode(df: DataFrame, c: str) -> DataFrame:
    """Value, n and its frequency over the number of values, scaled to 0..1 by minimum and maximum."""
    n = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n"))
    span = n.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return n.crossJoin(F.broadcast(span)).select(c, "n", C.div(F.col("n") - F.col("lo"), F.col("hi") - F.col("lo")).alias("encoded"))  # one row


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, n_a, n_b, v: Cramer's V from the long contingency table; empty cells enter through
    chi2 = n (sum O^2/(R C) - 1); a 2x2 table has Yates' correction. Null if undefined."""
    t = crosstab(df, a, b)
    rows, cols = t.groupBy(a).agg(F.sum("n").alias("r")), t.groupBy(b).agg(F.sum("n").alias("c"))
    size = t.agg(F.sum("n").alias("n_all"))
    full = t.join(rows, a).join(cols, b).agg(F.sum(F.col("n") * F.col("n") / (F.col("r").cast("double") * F.col("c"))).alias("s"))
    k = rows.agg(F.count("*").alias("n_a"), F.max("r").alias("r1"), F.min("r").alias("r2"))
    m = cols.agg(F.count("*").alias("n_b"), F.max("c").alias("c1"), F.min("c").alias("c2"))
    one = size.crossJoin(full).crossJoin(k).crossJoin(m)  # four single rows
    n, s = F.col("n_all").cast("double"), F.col("s")
    chi = n * (s - 1)
    # in a 2x2 table |O - E| is the same in each cell: chi2 = n d^2 n^2 / (r1 r2 c1 c2), d = |O - E|
    marg = F.col("r1").cast("double") * F.col("r2") * F.col("c1") * F.col("c2")
    d = F.sqrt(F.greatest(chi * marg, F.lit(0.0)) / (n * n * n))
    yates = n * n * n * F.pow(F.greatest(d - F.least(F.lit(0.5), d), F.lit(0.0)), 2) / marg
    lesser = F.least(F.col("n_a"), F.col("n_b")) - 1
    return one.select(F.col("n_all").alias("n"), "n_a", "n_b", F.sqrt(F.try_divide(F.greatest(F.when((F.col("n_a") == 2) & (F.col("n_b") == 2), yates).otherwise(chi), F.lit(0.0)), n * lesser)).alias("v"))


def histogram(df: DataFrame, c: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """bin (from 0), n: equal-width bins, the last closed on the right; values outside given
    edges are left out. With edges given, a second population is binned by the first's."""
    v = df.select(C.finite(c).alias("v")).where("v IS NOT NULL")
    if lo is None or hi is None:
        v = v.crossJoin(F.broadcast(v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))))  # one row
    else:
        v = v.withColumns({"lo": F.lit(lo), "hi": F.lit(hi)}).where("v BETWEEN lo AND hi")
    at = F.least(F.floor(F.coalesce(F.try_divide((F.col("v") - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1))
    return v.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def standardised(df: DataFrame, c: str, key: str) -> DataFrame:
    """key and z, the value over the population deviation; null where all values are equal."""
    v = C.finite(c)
    one = df.agg(F.avg(v).alias("mu"), F.stddev_pop(v).alias("sd"))
    return df.crossJoin(F.broadcast(one)).select(key, C.div(v - F.col("mu"), "sd").alias("z"))  # one row


def quantiles(v: Column, at: Sequence[float], accuracy: int | None) -> Column:
    """Exact percentiles, which hold a group's different values in one task, or with `accuracy`
    such whose rank is off by at most 1/accuracy of the group, from mergeable summaries."""
    at = F.array(*[F.lit(x) for x in at])
    return F.percentile(v, at) if accuracy is None else F.percentile_approx(v, at, accuracy)


def scaled(df: DataFrame, c: str, key: str, accuracy: int | None = None) -> DataFrame:
    """key and the value z-scored (sample deviation + 1e-4), min-max and robustly scaled.

    The statistics are one row from one aggregation; quartiles and median as in `quantiles`."""
    v = C.finite(c)
    one = df.agg(F.avg(v).alias("mu"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"), quantiles(v, (0.25, 0.5, 0.75), accuracy).alias("q"))
    return df.crossJoin(F.broadcast(one)).select(key, ((v - F.col("mu")) / (F.lit(1e-4) + F.col("sd"))).alias("z"), C.div(v - F.col("lo"), F.col("hi") - F.col("lo")).alias("minmax"), C.div(v - F.col("q")[1], F.col("q")[2] - F.col("q")[0]).alias("robust"))


def group_stats(df: DataFrame, by: str, c: str) -> DataFrame:
    v = C.finite(c)
    return df.groupBy(by).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))


def describe(df: DataFrame, by: str, c: str, accuracy: int | None = None) -> DataFrame:
    """n, mean, sd, min, quartiles (see `quantiles`) and max for each group."""
    v = C.finite(c)
    q = quantiles(v, (0.25, 0.5, 0.75), accuracy)
    return df.groupBy(by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("lo"), q.alias("q"), F.max(v).alias("hi")).select(by, "n", "mean", "sd", "lo", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "hi")


def modes(df: DataFrame, by: str, c: str) -> DataFrame:
    """The most frequent value of each group, the smallest on a tie; values are counted before they are ranked."""
    n = df.where(F.col(c).isNotNull()).groupBy(by, c).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.max_by(c, F.struct("n", -F.col(c))).alias("mode"), F.max("n").alias("n"))


_PREFIX = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def history(df: DataFrame, who: str, order: Sequence[str], stats: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """`df` with aggregates over the earlier rows of the same entity (not its own row).

    `stats` maps a new column to (sum|count|min|max, value). `order` is unique within an
    entity; rows without an entity are one entity. A row without earlier ones has count 0 and
    null for the others, as has one whose earlier values are all null.

    Rows are range partitioned by entity and order, so an entity with most of the rows is cut
    into many partitions. Each partition aggregates on its own; what an entity brings along
    from the partitions before is a window over one row per entity and partition."""
    cols = df.columns
    # as a struct an entity is never null, so windows and join have their keys, and the shuffle, in common
    state = ordered(df.withColumns({"__who": F.struct(who), **{f"__v_{n}": v for n, (_, v) in stats.items()}}), [who, *order])
    per = state.groupBy("__pid", "__who").agg(*[_PREFIX[f](f"__v_{n}").alias(f"__c_{n}") for n, (f, _) in stats.items()])
    before = Window.partitionBy("__who").orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as the entity has partitions
    carry = per.select("__pid", "__who", *[(F.sum if f == "count" else _PREFIX[f])(f"__c_{n}").over(before).alias(f"__c_{n}") for n, (f, _) in stats.items()])
    own = Window.partitionBy("__pid", "__who").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    rows = state.withColumns({f"__w_{n}": _PREFIX[f](f"__v_{n}").over(own) for n, (f, _) in stats.items()})
    rows = rows.join(carry, ["__pid", "__who"])

    def both(kind: str, a: Column, b: Column) -> Column:
        if kind == "count":
            return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        if kind == "sum":
            return F.coalesce(a + b, a, b)
        return F.least(a, b) if kind == "min" else F.greatest(a, b)  # nulls are passed over

    return rows.select(*cols, *[both(f, F.col(f"__c_{n}"), F.col(f"__w_{n}")).alias(n) for n, (f, _) in stats.items()])


def moments(n: str | Column, s: str | Column, ss: str | Column) -> tuple[Column, Column]:
    """(mean, sample variance) from a count, a sum and a sum of squares; null where undefined."""
    n, s, ss = C.col(n), C.col(s), C.col(ss)
    return C.div(s, n), F.when(n > 1, F.greatest(ss - s * s / n, F.lit(0.0)) / (n - 1))


def sketch_similarity(df: DataFrame, who: str, order: Sequence[str], key: str, tokens: Column, least_variance: float = 0.0) -> DataFrame:
    """key, who, n_before, similarity, drift: each message against the bag of all tokens of its
    sender's earlier messages.

    similarity is the cosine of the two bags, 0 where either is empty, null for a sender's
    first message. drift is (mean - similarity) / variance over the similarities of the
    sender's earlier messages, -1 where there are fewer than two or their variance is no more
    than `least_variance`. Rows without a sender are left out.

    No bag is ever built: a token's earlier count is a running sum over the sender's messages
    that have it, which gives the dot product, and the bag's squared length grows by
    2 * dot + |message|^2 with each message, which makes it a running sum as well. Both run
    over range partitions (see `history`), so neither a busy sender nor a common token gathers."""
    cols = list(dict.fromkeys([key, who, *order]))
    rows = df.where(F.col(who).isNotNull()).select(*cols, tokens.alias("__tokens"))
    bag = rows.select(*cols, F.explode("__tokens").alias("__t")).groupBy(*cols, "__t").agg(F.count("*").alias("__n"))
    bag = history(bag.withColumn("__wt", F.struct(who, "__t")), "__wt", order, {"__prior": ("sum", F.col("__n"))})
    per = bag.groupBy(key).agg(F.sum(F.col("__n") * F.coalesce("__prior", F.lit(0))).alias("__dot"), F.sum(F.col("__n") * F.col("__n")).alias("__own"))
    each = rows.drop("__tokens").join(per, key, "left").na.fill(0, ["__dot", "__own"])
    each = history(each, who, order, {"n_before": ("count", F.lit(1)), "__len": ("sum", 2 * F.col("__dot") + F.col("__own"))})
    sim = F.when(F.col("n_before") > 0, F.coalesce(F.try_divide(F.col("__dot").cast("double"), F.sqrt(F.col("__len").cast("double")) * F.sqrt(F.col("__own").cast("double"))), F.lit(0.0)))
    each = each.withColumn("similarity", sim)
    x = F.col("similarity")
    each = history(each, who, order, {"__sn": ("count", x), "__s": ("sum", x), "__ss": ("sum", x * x)})
    mean, var = moments("__sn", "__s", "__ss")
    return each.select(key, who, "n_before", "similarity", F.when((F.col("__sn") > 1) & (var > least_variance), (mean - x) / var).otherwise(-1.0).alias("drift"))


def neighbour_mean(edges: DataFrame, features: DataFrame, src: str, dst: str, node: str, cols: Sequence[str]) -> DataFrame:
    """dst and the mean of its in-neighbours' features, an edge counting as often as it occurs."""
    j = edges.groupBy(src, dst).agg(F.count("*").alias("__w")).join(features.select(F.col(node).alias(src), *cols), src)
    return j.groupBy(dst).agg(*[F.try_divide(F.sum(F.col(c) * F.col("__w")), F.sum(F.when(F.col(c).isNotNull(), F.col("__w"))).cast("double")).alias(c) for c in cols])
