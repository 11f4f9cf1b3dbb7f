"""Sinks: CSV, JSON lines, token files, keyed sketch stores, model tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, header=header)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def token_file(tokens: DataFrame, vocabulary: DataFrame, path: str) -> None:
    """Token ids with their place (doc, pos, id) in parts sorted by place, and the vocabulary beside them."""
    tokens.sortWithinPartitions(*[c for c in tokens.columns if c != "id"]).write.mode("overwrite").parquet(f"{path}/tokens")
    vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")


def read_token_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/tokens"), spark.read.parquet(f"{path}/vocabulary")


def binary(spark: SparkSession, content: bytes, path: str) -> None:
    """One file of the given bytes, on any file system the session knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(content, 0, len(content))
    finally:
        out.close()


class SketchStore:
    """Additive counts per (entity, item): appended in parts, read as sums, compacted by rewriting.

    A generation is a folder of parts. Compaction writes the sums as the next generation, which
    counts once it is complete (its commit marker is the last thing written); until then, and
    if it fails, the one before stays whole. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _generations(self) -> list[int]:
        """Complete generations in order."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n[4:]) for n in names if n.startswith("gen-") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def append(self, counts: DataFrame) -> None:
        """`counts`: entity string, item string, n bigint."""
        now = (self._generations() or [0])[-1]
        counts.select(F.col("entity").cast("string"), F.col("item").cast("string"), F.col("n").cast("bigint")).write.mode("append").parquet(f"{self.path}/gen-{now}")

    def read(self) -> DataFrame:
        """entity, item, n: the sums of all parts; no rows for a store without any."""
        schema = "entity string, item string, n bigint"
        have = self._generations()
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/gen-{have[-1]}") if have else self.spark.createDataFrame([], schema)
        return rows.groupBy("entity", "item").agg(F.sum("n").alias("n"))

    def compact(self) -> None:
        """The sums become the next generation; older ones are removed after it is complete."""
        old = self._generations()
        if not old:
            return
        self.read().write.mode("overwrite").parquet(f"{self.path}/gen-{old[-1] + 1}")
        for n in old:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/gen-{n}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def save_table_model(spark: SparkSession, path: str, meta: dict, **tables: DataFrame) -> None:
    """A fitted model as JSON and parquet tables."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def load_table_model(spark: SparkSession, path: str, *tables: str) -> tuple[dict, dict[str, DataFrame]]:
    meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first().meta)
    return meta, {t: spark.read.parquet(f"{path}/{t}") for t in tables}
