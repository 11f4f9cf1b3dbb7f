"""Rolling totals over trailing periods of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import clean as C


def daily_totals(df: DataFrame, entity: str, day: Column, measures: Sequence[str]) -> DataFrame:
    """One row for each entity and day number: the sum of every measure, null and negative as 0.

    Rows without an entity or a day are left out. Result: `entity`, `day`, and the measures.
    """
    rows = df.select(F.col(entity).alias("entity"), day.alias("day"), *[C.count_of(m).alias(m) for m in measures])
    return rows.where("entity IS NOT NULL AND day IS NOT NULL").groupBy("entity", "day").agg(*[F.sum(m).alias(m) for m in measures])


def rolling_totals(daily: DataFrame, measures: Sequence[str], last_day: int | None, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals and daily averages over trailing periods for each entity and calendar day.

    `daily` has one row per `entity` and `day` (a day number). Every row is exploded onto the
    days it influences (its own and the max(periods)-1 after it, none beyond `last_day`); the
    entity's first row also carries the calendar, one row of weight 0 for each day from the
    first to the last, so that days without activity come out as zeros. One aggregation by
    entity and date adds both up. A period of p days averages over p, also before the entity
    has been seen for p days.

    Repartitioning by entity moves daily rows only, at most one per entity and day, and the
    explosion, the calendar and the final aggregation all reuse that partitioning.

    Result: entity, day, days_seen (days since the first, inclusive), for each measure m and
    period p: m_p, m_avg_p. An empty `daily` or no `last_day` gives no rows.
    """
    longest, last = max(periods), F.lit(last_day).cast("int")
    by = daily.select("entity", "day", *measures).where(F.col("day") <= last).repartition("entity")
    by = by.withColumn("first", F.min("day").over(Window.partitionBy("entity")))
    reach = F.transform(F.sequence(F.col("day"), F.least(F.col("day") + (longest - 1), last)), lambda d: F.struct(d.alias("at"), (d - F.col("day")).alias("age")))
    calendar = F.transform(F.sequence(F.col("first"), last), lambda d: F.struct(d.alias("at"), F.lit(longest).alias("age")))
    hit = by.withColumn("hit", F.explode(F.concat(reach, F.when(F.col("day") == F.col("first"), calendar).otherwise(F.array().cast("array<struct<at:int,age:int>>")))))
    sums = [F.sum(F.when(F.col("hit.age") < p, F.col(m)).otherwise(0)).alias(f"{m}_{p}") for m in measures for p in periods]
    out = hit.groupBy("entity", F.col("hit.at").alias("day")).agg(F.first("first").alias("first"), *sums)
    avgs = [(F.col(f"{m}_{p}") / p).alias(f"{m}_avg_{p}") for m in measures for p in periods]
    return out.select("entity", "day", (F.col("day") - F.col("first") + 1).alias("days_seen"), *[f"{m}_{p}" for m in measures for p in periods], *avgs)


def surges(rolled: DataFrame, measures: Sequence[str], short: int, long: int, percent: int) -> DataFrame:
    """Rows of `rolling_totals` with `long` days of history whose last `short` days hold more
    than `percent` of the `long` days in every measure; whole-number arithmetic, no rounding."""
    cond = F.col("days_seen") >= long
    for m in measures:
        cond = cond & (F.col(f"{m}_{short}") * 100 > F.col(f"{m}_{long}") * percent)
    return rolled.where(cond)
