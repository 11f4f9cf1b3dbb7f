"""Joins beyond a plain equi-join. The physical strategy is Catalyst's; no side is forced
into a broadcast unless its size is fixed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.sequences import numbered


def full_outer_add(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Values of both sides added by key, an absent side counting as 0. One aggregation over
    the union: partial sums meet before the shuffle, and no outer join is needed."""
    return a.select(key, value).unionByName(b.select(key, value)).groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))


def frequency_difference(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Share of each value (percent) among the rows where `first` holds and among the others,
    and their absolute difference; a value absent on one side has 0 there."""
    n = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    total = n.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    pct = n.crossJoin(F.broadcast(total))  # one row
    return pct.select(value, *[F.coalesce(F.try_divide(F.col(c) * 100.0, F.col(t)), F.lit(0.0)).alias(f"pct_{c}") for c, t in (("a", "ta"), ("b", "tb"))]).withColumn("diff", F.abs(F.col("pct_a") - F.col("pct_b")))


def first_match(rows: DataFrame, refs: DataFrame, key: str, ref_keys: Column, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Left join to the first (by `order`) of the reference rows that list the key among
    several alternatives. `ref_keys` is an array; exploding it turns the OR of equalities into
    an equi-join. A null key matches nothing."""
    one = refs.select(F.explode(ref_keys).alias(key), *order, *keep)
    best = one.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("__best"))
    return rows.join(best, key, "left").select(*rows.columns, *[F.col(f"__best.{c}").alias(c) for c in keep])


def edge_predictions(rows: DataFrame, preds: DataFrame, src: str, dst: str, pos: str, pred: str) -> DataFrame:
    """Each row with the prediction of its edge, null where there is none; of several
    predictions of an edge the one at the lowest position counts."""
    first = preds.groupBy(src, dst).agg(F.min_by(pred, pos).alias(pred))
    return rows.join(first, [src, dst], "left")


def neighbours(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, neighbours: the sorted different counterparties in either direction, itself left out.
    A node's neighbours have to fit into one row; `neighbour_pairs` has no such limit."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(b, a))
    return both.where("node IS NOT NULL AND other IS NOT NULL AND node <> other").groupBy("node").agg(F.sort_array(F.collect_set("other")).alias("neighbours"))


def neighbour_pairs(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, other: each counterparty of a node in either direction once, itself left out. As
    rows, so that a hub's neighbours need no room in one of them."""
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(b, a))
    return both.where("node IS NOT NULL AND other IS NOT NULL AND node <> other").distinct()


#: References that fit into one expression.
MOST_REFERENCES = 5_000


def nearest_reference(rows: DataFrame, refs: DataFrame, vec: str, label: str, cutoff: float, other: str, key: str) -> DataFrame:
    """key, nearest (label of the reference with the least squared distance, ties by label),
    distance; beyond `cutoff` the label is `other`. `refs` is a short fixed catalogue, collected
    into the expression so that rows need neither a join nor a shuffle; one of more than
    MOST_REFERENCES rows raises."""
    catalogue = refs.select(label, vec).limit(MOST_REFERENCES + 1).collect()
    if len(catalogue) > MOST_REFERENCES:
        raise ValueError(f"more than {MOST_REFERENCES} references")
    catalogue.sort(key=lambda r: str(r[label]))
    if not catalogue:
        return rows.select(key, F.lit(other).alias("nearest"), F.lit(None).cast("double").alias("distance"))
    dist = lambda v: F.aggregate(F.zip_with(F.col(vec), F.array(*[F.lit(float(x)) for x in v]), lambda p, q: (p.cast("double") - q) * (p.cast("double") - q)), F.lit(0.0), lambda s, x: s + x)
    best = F.array_min(F.array(*[F.struct(dist(r[vec]).alias("distance"), F.lit(str(r[label])).alias("label")) for r in catalogue]))
    return rows.select(key, best.alias("__b")).select(key, F.when(F.col("__b.distance") <= cutoff, F.col("__b.label")).otherwise(other).alias("nearest"), F.col("__b.distance").alias("distance"))


def positional(a: DataFrame, b: DataFrame, order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """Columns of both side by side, row by row in the given orders; what is left over of the
    longer one has nulls. The orders are unique; numbers come from range partitions, and the
    rows meet by an equi-join of their numbers. Column names must differ."""
    x, y = numbered(a, order_a, "__n"), numbered(b, order_b, "__n")
    return x.join(y, "__n", "full").select(F.col("__n").alias("position"), *a.columns, *b.columns)


def universe(*columns: DataFrame) -> DataFrame:
    """Distinct non-null values of one-column frames under the name `entity`."""
    out = columns[0].toDF("entity")
    for c in columns[1:]:
        out = out.union(c.toDF("entity"))
    return out.where("entity IS NOT NULL").distinct()


def triplets(df: DataFrame, key: str, label: str, seed: int = 11) -> DataFrame:
    """anchor, positive, negative for each row: the next row of its label and the next row of
    another label in a seeded order. Needs no pairing of all rows: rows are ranked within their
    label over range partitions, and the partner ranks are joined by equality. Rows without a
    label are left out; a label of one row is its own positive."""
    rows = numbered(df.select(key, label).where(F.col(label).isNotNull()).withColumn("h", F.xxhash64(key, F.lit(seed))), [label, "h", key])
    size = rows.groupBy(label).agg(F.min("rn").alias("start"), F.count("*").alias("n"))
    ranked = rows.join(size.select(label, "start"), label).select(key, label, (F.col("rn") - F.col("start") + 1).alias("r"))
    size = size.select(label, "n")
    labels = size.withColumn("i", F.row_number().over(Window.orderBy(label)))
    m = labels.agg(F.max("i").alias("m"))
    pick = labels.crossJoin(F.broadcast(m)).select(label, "n", (F.col("i") % F.col("m") + 1).alias("i2"))
    other = labels.select(F.col("i").alias("i2"), F.col(label).alias("other"), F.col("n").alias("n2"))
    full = ranked.join(pick.join(other, "i2"), label)
    pos = ranked.select(F.col(key).alias("positive"), F.col(label), F.col("r").alias("rp"))
    neg = ranked.select(F.col(key).alias("negative"), F.col(label).alias("other"), F.col("r").alias("rn"))
    out = full.withColumn("rp", F.col("r") % F.col("n") + 1).withColumn("rn", F.col("r") % F.col("n2") + 1)
    return out.join(pos, [label, "rp"]).join(neg, ["other", "rn"]).select(F.col(key).alias("anchor"), "positive", "negative")
