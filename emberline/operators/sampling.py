"""Deterministic sampling, splits and de-duplication; ties break by key, draws by hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.sequences import numbered


def fraction(key: str, share: float, seed: int = 3) -> Column:
    """True for a share of the keys by their seeded hash, the same rows however they are partitioned."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < round(share * 1_000_000)


def stratified(df: DataFrame, group: str, per_group: int, order: Sequence[Column | str]) -> DataFrame:
    """The first `per_group` rows of each group by `order`; the rank limit is applied before
    the shuffle as well, so a large group sends no more than its sample from each task."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("__r", rank).where(F.col("__r") <= per_group).drop("__r")


def under_sample(df: DataFrame, positive: Column, ratio: float, key: str, seed: int = 5) -> DataFrame:
    """All positive rows and floor(positives/ratio) of the others, at most all of them, by hash of
    the key. The others are numbered over range partitions, so no task gathers the sample."""
    n = df.agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q")).first()
    take = min(n.q, int(n.p / ratio)) if ratio else n.q
    rest = numbered(df.where(~positive).withColumn("__h", F.xxhash64(F.col(key), F.lit(seed))), ["__h", key], "__rn")
    return df.where(positive).unionByName(rest.where(F.col("__rn") < take).drop("__h", "__rn"))


def class_split(df: DataFrame, label: str, cap: int, train: float, key: str) -> DataFrame:
    """Every row with part: of each class the first floor(train * least(n, cap)) rows by key are
    train, all others test. `cap` bounds the training part of a class, it drops nothing.

    The key is unique within a class; rows without a label are a class. Only a class's first
    `cap` keys are ranked (the rank limit is applied before the shuffle as well), and its last
    training key comes back to the rows by a broadcast of one row per class."""
    size = df.groupBy(F.col(label).alias("__c")).agg(F.count("*").alias("__n"))
    rank = F.row_number().over(Window.partitionBy("__c").orderBy("__k"))
    first = df.select(F.col(label).alias("__c"), F.struct(key).alias("__k")).withColumn("__r", rank).where(F.col("__r") <= cap)
    last = first.join(F.broadcast(size.withColumnRenamed("__c", "__d")), F.col("__c").eqNullSafe(F.col("__d"))).where(F.col("__r") <= F.floor(F.least("__n", F.lit(cap)) * train)).groupBy("__c").agg(F.max("__k").alias("__last"))
    part = F.when(F.struct(key) <= F.col("__last"), "train").otherwise("test")
    return df.join(F.broadcast(last), F.col(label).eqNullSafe(F.col("__c")), "left").withColumn("part", part).select(*df.columns, "part")


def dedup_negatives(df: DataFrame, positive: Column, subset: Sequence[str], key: str) -> DataFrame:
    """All positive rows, and of the others the row of the lowest key for each combination of
    `subset`. min_by combines before the shuffle: copies of a hot combination never gather."""
    cols = df.columns
    one = df.where(~positive).groupBy(*subset).agg(F.min_by(F.struct(*cols), key).alias("__x")).select("__x.*")
    return df.where(positive).unionByName(one)


def time_split(day: Column, train_to: int, test_from: int) -> Column:
    return F.when(day <= train_to, "train").when(day >= test_from, "test").otherwise("validation")
