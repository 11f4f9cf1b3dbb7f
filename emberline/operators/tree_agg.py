"""Per-key totals by multi-level tree aggregation, for keys that hold most of the rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.plans.durable import written

#: How a partial of each kind is made from rows and how partials are put together.
MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
MAKE = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def tree_aggregate(df: DataFrame, keys: list[str], aggs: Mapping[str, tuple[str, str]], fan_in: int = 32) -> DataFrame:
    """Totals per key; `aggs` maps an output name to (count|sum|min|max, column).

    Level 0: an input chunk is one scan partition, bounded by spark.sql.files.maxPartitionBytes;
    its rows are combined in place. Each round then merges the states of `fan_in` neighbouring
    chunks of a key, so a reducer receives at most `fan_in` states of any key, and the number
    of rounds is the logarithm of the number of chunks. With at most `fan_in` chunks one round
    is left. A null key is a key of its own; a null value counts for nothing; sums of no value
    are null. Chunk numbers only steer who merges with whom, the result doesn't depend on them.
    """
    chunks = max(1, df.rdd.getNumPartitions())
    state = df.withColumn("__chunk", F.spark_partition_id())
    make = [MAKE[kind](F.col(c)).alias(out) for out, (kind, c) in aggs.items()]
    merge = [MERGE[kind](F.col(out)).alias(out) for out, (kind, _) in aggs.items()]
    first = True
    while True:
        chunks = -(-chunks // fan_in)
        group = [*keys] if chunks == 1 else [*keys, "__chunk"]
        if chunks > 1:
            state = state.withColumn("__chunk", F.floor(F.col("__chunk") / fan_in).cast("int"))
        state = state.groupBy(*group).agg(*(make if first else merge))
        first = False
        if chunks == 1:
            return state


def heavy_keys(df: DataFrame, key: str, share: float, fan_in: int = 32) -> DataFrame:
    """Keys that hold at least `share` of all rows, null keys counted in the rows but never returned.

    Result: key_value, n, total."""
    totals = tree_aggregate(df.select(F.col(key).alias("key_value"), F.lit(1).alias("one")), ["key_value"], {"n": ("count", "one")}, fan_in)
    totals = written(totals)
    total = totals.agg(F.sum("n")).first()[0] or 0
    return totals.where(F.col("key_value").isNotNull() & (F.col("n") >= F.lit(share * total))).select("key_value", "n", F.lit(total).cast("bigint").alias("total"))
