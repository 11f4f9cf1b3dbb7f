"""The event tables as operators want them: names and clocks normalised, repeated deliveries merged.

A table may lack rows, hold nulls in any column or carry extra columns; only the columns
named here are read, so that the scan stays narrow and clashing names never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from emberline.functions import clean as C

#: Columns that tell one flow from another; names and clock are normalised first.
FLOW_FIELDS = ["time", "Duration", "SrcDevice", "DstDevice", "Protocol", "SrcPort", "DstPort", "SrcPackets", "DstPackets", "SrcBytes", "DstBytes"]
#: Columns that tell one log record from another.
LOG_FIELDS = ["Time", "EventID", "LogHost", "UserName", "DomainName", "LogonType", "Source", "Destination"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_flows(df: DataFrame) -> DataFrame:
    """Raw flow rows with `ms` (null: no time) and normalised device names, repeats kept."""
    rest = [c for c in FLOW_FIELDS if c not in ("time", "SrcDevice", "DstDevice")]
    return df.select(C.flow_ms("time").alias("ms"), C.name("SrcDevice").alias("src_device"), C.name("DstDevice").alias("dst_device"), *rest)


def row_hash(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns, h1 and h2, that tell rows apart: rows that agree
    everywhere (nulls and NaNs agree) have both in common, and others don't (one pair in 2**128).
    Spark's hash passes over a null, so which columns are null is hashed as well."""
    nulls = sum((F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(df.columns)), F.lit(0))
    return [F.xxhash64(nulls, *df.columns).alias("h1"), F.xxhash64(F.lit("h2"), *df.columns[::-1], nulls).alias("h2")]


def one_of_each(df: DataFrame, *columns: str) -> DataFrame:
    """`columns` of the rows of `df`, rows that agree in all columns of `df` once.

    Rows meet under the two hashes of the whole row, so the shuffle carries 16 bytes and the
    wanted columns instead of every column, is spread by the whole row however often one
    value occurs, and copies are combined before it."""
    text = [c for c in columns if not isinstance(df.schema[c].dataType, K.NumericType)]  # only numbers can be combined in place
    keyed = df.select(*columns, *row_hash(df))
    if len(text) == len(columns):
        return keyed.distinct().select(*columns)
    return keyed.groupBy("h1", "h2", *text).agg(*[F.max(c).alias(c) for c in columns if c not in text]).select(*columns)


def flows(df: DataFrame, *columns: str) -> DataFrame:
    """One row for each flow, all columns or those named: rows that agree in all fields but the
    delivery time count once.

    The shuffle is spread by the whole row, so no device, however busy, gathers in one task;
    copies meet map-side first. With `columns`, see `one_of_each`.
    """
    rows = read_flows(df)
    return one_of_each(rows, *columns) if columns else rows.distinct()


def read_records(df: DataFrame) -> DataFrame:
    """Raw log rows with `time_s` and normalised names, repeats kept."""
    names = {"LogHost": "log_host", "UserName": "user_name", "DomainName": "domain_name", "Source": "source", "Destination": "destination"}
    return df.select(C.log_s("Time").alias("time_s"), F.col("EventID").alias("event_id"), F.col("LogonType").alias("logon_type"), *[C.name(a).alias(b) for a, b in names.items()])


def records(df: DataFrame, *columns: str) -> DataFrame:
    """One row for each log record, all columns or those named, see `flows`."""
    rows = read_records(df)
    return one_of_each(rows, *columns) if columns else rows.distinct()
