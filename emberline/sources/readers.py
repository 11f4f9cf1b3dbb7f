"""Readers with explicit schemas for the file forms the workflows start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import clean as C

FLOW_SCHEMA = "time bigint, Duration double, SrcDevice string, DstDevice string, Protocol int, SrcPort int, DstPort int, SrcPackets bigint, DstPackets bigint, SrcBytes bigint, DstBytes bigint"
LOG_SCHEMA = "Time bigint, EventID int, LogHost string, UserName string, DomainName string, LogonType int, Source string, Destination string"
SNAPSHOT_SCHEMA = "plugin string, titles array<string>, data array<array<string>>, count bigint"


def csv(spark: SparkSession, path, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    """One or several CSV paths; malformed rows give nulls."""
    return spark.read.schema(schema).csv(path, header=header, sep=sep)


def flows_csv(spark: SparkSession, path) -> DataFrame:
    """Headerless flow log, columns by position, with `ts` from milliseconds."""
    return csv(spark, path, FLOW_SCHEMA, header=False).withColumn("ts", F.timestamp_millis(C.flow_ms("time")))


def logs_json(spark: SparkSession, path, max_lines: int | None = None) -> DataFrame:
    """Event log, one JSON object a line (bz2, gz or plain), with `ts` from seconds. Splittable
    codecs are read in parallel, and there is no block state to carry over. `max_lines` ends
    after so many lines, whichever they are."""
    rows = spark.read.schema(LOG_SCHEMA).json(path)
    return (rows if max_lines is None else rows.limit(max_lines)).withColumn("ts", F.timestamp_seconds(C.log_s("Time")))


def parse_logs(df: DataFrame, text: str) -> DataFrame:
    """The same from a text column; a line that isn't JSON gives nulls."""
    return df.select(F.from_json(text, LOG_SCHEMA).alias("r")).select("r.*")


def json_array(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    """Files that hold one array of objects."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def public_suffixes(path: str) -> list[str]:
    """The suffixes of more than one label of a public suffix file (one a line, comments after
    //), for `url.split_host`; wildcards and exceptions are left out."""
    with open(path, encoding="utf-8") as f:
        lines = [line.split("//")[0].strip().lower() for line in f]
    return sorted({x for x in lines if "." in x and x[0] not in "*!"})


def by_days(spark: SparkSession, path: str, first: str, last: str, schema: str | None = None) -> DataFrame:
    """Parquet partitioned by `day`, only the days first..last: other folders are never listed
    into tasks. A table that may have no files needs its `schema`, with `day`."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path).where(F.col("day").between(first, last))


def sign_in_columns(df: DataFrame, prefix: str = "properties.", names: dict[str, str] | None = None) -> DataFrame:
    """Flat sign-in columns under their names without `prefix`, `time` as `_time`, with `day` of the year."""
    names = names or {}
    cols = [F.col(f"`{c}`").alias(names.get(b, b)) for c in df.columns if c != "time" for b in [c[len(prefix) :] if c.startswith(prefix) else c]]
    out = df.select(*cols, F.to_timestamp("time").alias("_time"))
    return out.withColumn("day", F.dayofyear("_time"))


def snapshot_rows(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of columnar JSON records (SNAPSHOT_SCHEMA and `file`), see `snapshots`."""
    titles = F.when(F.col("plugin") == "vadinfo", F.array_remove("titles", "SHA256")).otherwise(F.col("titles"))
    rows = raw.withColumn("titles", titles).withColumn("row", F.explode("data"))
    at = lambda c: F.try_element_at("row", F.nullif(F.array_position("titles", c).cast("int"), F.lit(0)))
    file = F.col("file")
    return rows.select(*[at(c).alias(c) for c in columns], "plugin", F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("snapshot"), F.regexp_extract(file, r"_(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}(?:\.\d+)?)\.json$", 1).alias("file_time"))


def snapshots(spark: SparkSession, path: str, columns: list[str], plugins: list[str] | None = None, glob: str = "*.json") -> DataFrame:
    """Rows of columnar plugin JSON below `path`: the wanted columns by title (null where a file
    has no such title), plugin, snapshot (the file's folder) and file_time. Unreadable files are skipped."""
    raw = spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreCorruptFiles", True).json(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file")).where("data IS NOT NULL")
    return snapshot_rows(raw.where(F.col("plugin").isin(plugins)) if plugins else raw, columns)


def replay(df: DataFrame, batches: int, per_batch: int, key: str, seed: int = 13) -> DataFrame:
    """`df` resampled with replacement: batch, i, row_id = batch * per_batch + i and the drawn row's columns."""
    from emberline.operators.sequences import numbered

    rows = numbered(df, [key], "__n")
    n = max(rows.count(), 1)
    draws = df.sparkSession.range(batches * per_batch).select((F.col("id") / per_batch).cast("bigint").alias("batch"), (F.col("id") % per_batch).alias("i"), F.col("id").alias("row_id"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).alias("__n"))
    return draws.join(rows, "__n").drop("__n")
