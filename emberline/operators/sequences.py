"""Operators over a global row order: numbering, count-based windows, batches, n-grams, prefix sums.

The order is made by range partitioning and a sort inside each partition; a row's number is its
place in its partition plus the sizes of the partitions before, so no operator here sorts the
whole table in one task. `order` must name a unique order (a clock and an id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.plans.durable import written


def ordered(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """`df` in order with __pid and __i (place in the partition); written, since range bounds
    are drawn anew each time a plan runs."""
    part = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(part.select("*", F.spark_partition_id().alias("__pid"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__i")))


def _before(state: DataFrame, totals: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """For each partition the totals of the partitions before it: a row for each partition."""
    per = state.groupBy("__pid").agg(*[t.alias(n) for t, n in zip(totals, names)])
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # over as many rows as there are partitions
    return per.select("__pid", *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in names])


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """`df` with its row number from 0 in the given order."""
    state = ordered(df, order)
    return state.join(_before(state, [F.count("*")], ["__off"]), "__pid").withColumn(name, F.col("__i") + F.col("__off")).drop("__pid", "__i", "__off")


def prefix_sums(df: DataFrame, order: Sequence[Column | str], sums: dict[str, str]) -> DataFrame:
    """`df` with running totals, `sums` mapping new names to columns; the row's own value counts."""
    state = ordered(df, order)
    off = _before(state, [F.coalesce(F.sum(c), F.lit(0)) for c in sums.values()], [f"__o_{n}" for n in sums])
    w = Window.partitionBy("__pid").orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = state.join(off, "__pid").withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"__o_{n}") for n, c in sums.items()})
    return rows.drop("__pid", "__i", *[f"__o_{n}" for n in sums])


def count_windows(df: DataFrame, order: Sequence[Column | str], width: int, step: int, item: Column, flag: Column) -> DataFrame:
    """Full windows of `width` rows every `step` rows: win_start (row number), label (max of
    `flag`), items (in order). Each row is sent to the at most ceil(width/step) windows it is in."""
    rows = numbered(df.select(*[c if isinstance(c, str) else c for c in df.columns]), order)
    n = rows.agg(F.coalesce(F.max("rn") + 1, F.lit(0))).first()[0]
    lo = F.greatest(F.lit(0), F.ceil((F.col("rn") - (width - 1)) / step))
    hi = F.least(F.floor(F.col("rn") / step), F.lit((n - width) // step))
    hit = rows.select("rn", item.alias("__x"), flag.alias("__f"), lo.alias("__lo"), hi.alias("__hi")).where("__lo <= __hi").withColumn("w", F.explode(F.sequence("__lo", "__hi")))
    out = hit.groupBy("w").agg(F.max("__f").alias("label"), F.array_sort(F.collect_list(F.struct("rn", "__x"))).alias("__a"))
    return out.select((F.col("w") * step).alias("win_start"), "label", F.transform("__a", lambda x: x["__x"]).alias("items"))


def batches(df: DataFrame, order: Sequence[Column | str], size: int) -> DataFrame:
    """`df` with rn and batch: consecutive rows by `size`, the last batch may be short."""
    return numbered(df, order).withColumn("batch", F.floor(F.col("rn") / size))


def length_batches(df: DataFrame, order: Sequence[Column | str], length: str, size: int) -> DataFrame:
    """`df` with place (row number in `order`) and batch: consecutive rows by `size` from the
    longest to the shortest, equal lengths in the given order. Sorting by place gives the old
    order back."""
    placed = numbered(df, order, "place")
    return numbered(placed, [F.desc(length), F.col("place")], "__by").withColumn("batch", F.floor(F.col("__by") / size)).drop("__by")


def grams(items: Column, n: int) -> Column:
    """All runs of n neighbours of an array; none if it is shorter."""
    return F.when(F.size(items) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(items) - (n - 1), F.lit(1))), lambda i: F.slice(items, i, n))).otherwise(F.array().cast("array<array<string>>"))


def bigrams(df: DataFrame, order: Sequence[Column | str], item: str, block: int = 65_536) -> DataFrame:
    """rn, first, second for each row and the next. Rows are looked at in blocks that overlap
    by one row, so neither a self-join nor one long window is needed."""
    rows = numbered(df.select(*df.columns), order).select("rn", item)
    own = F.floor(F.col("rn") / block)
    spread = rows.withColumn("b", F.explode(F.when((F.col("rn") % block == 0) & (F.col("rn") > 0), F.array(own - 1, own)).otherwise(F.array(own))))
    nxt = F.lead(item).over(Window.partitionBy("b").orderBy("rn"))
    last = F.lead("rn").over(Window.partitionBy("b").orderBy("rn"))
    return spread.select("rn", F.col(item).alias("first"), nxt.alias("second"), last.alias("l"), "b").where((F.col("l") == F.col("rn") + 1) & (F.col("b") == own)).drop("l", "b")


def first_seen_ids(df: DataFrame, order: Sequence[str], key: str) -> DataFrame:
    """key, id: numbers from 0 by first appearance."""
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("at"))
    return numbered(first, ["at"], "id").select(key, "id")
