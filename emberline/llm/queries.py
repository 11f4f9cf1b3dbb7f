"""Queries for problems 2, 6, 7, 8, 9 and 10, with the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import clean as C
from emberline.llm import bitmaps, bpe, clusters, mixing, quantiles, subjects
from emberline.sources import tables as T

FIELDS = ["SrcBytes", "DstBytes", "Duration"]
#: p2_found: least number of values, and how far the 99th percentile lies above the median.
LEAST_VALUES, TAIL = 60, 50
CROWD = 24
ALIKE, LEAST_HOSTS = 0.03, 5


def _sketched(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    """Sketches of the three fields for each combination of `keys`, each flow once."""
    flows = T.flows(T.table(spark, d, "netflow"), "src_device", "ms", *FIELDS).where("src_device IS NOT NULL").withColumn("day", C.day_of_ms("ms"))
    base, most = quantiles.base_sketches(flows.select(*keys, *FIELDS), keys, FIELDS)
    return quantiles.merge_sketches(base, keys, FIELDS, most)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = quantiles.percentiles(_sketched(spark, d, "src_device"), ["src_device"], FIELDS, [50, 99])
    return rows.where((F.col("n") >= LEAST_VALUES) & (F.col("p50") > 0) & (F.col("p99") >= TAIL * F.col("p50"))).select("src_device", "field")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per device over all days."""
    return quantiles.percentiles(_sketched(spark, d, "src_device"), ["src_device"], FIELDS, [5, 25, 50, 75, 90, 95, 99])


def p2_daily(spark: SparkSession, d: str) -> DataFrame:
    """Per device and day; flows without a time have none."""
    day = _sketched(spark, d, "src_device", "day").where("day IS NOT NULL")
    return quantiles.percentiles(day, ["src_device", "day"], FIELDS, [50, 90, 99]).withColumn("day", C.yyyymmdd("day"))


def _cells(spark: SparkSession, d: str) -> DataFrame:
    """Bitmap cells per kind, key and day, null for rows without one. Repeated rows set the same bits."""
    logs = T.read_records(T.table(spark, d, "windows_event_logs")).select(F.lit("users").alias("kind"), F.col("log_host").alias("key_value"), C.day_of_s("time_s").alias("day"), F.col("user_name").alias("who"))
    flows = T.read_flows(T.table(spark, d, "netflow")).select(F.lit("peers").alias("kind"), F.col("src_device").alias("key_value"), C.day_of_ms("ms").alias("day"), F.col("dst_device").alias("who"))
    return bitmaps.cells(logs.unionByName(flows), ["kind", "key_value", "day"], "who", ["key_value", "day"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d).where("key_value IS NOT NULL AND day IS NOT NULL")
    rows = bitmaps.estimates(cells, ["kind", "key_value", "day"])
    return rows.where(F.col("n_distinct") >= CROWD).select("kind", "key_value", C.yyyymmdd("day").alias("day"))


def p6_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct counts per day, per key and in total, put together from the cells per key and
    day. A row without a time counts for its key and in total, one without a key for its day."""
    cells = _cells(spark, d)
    cells.createOrReplaceTempView("emberline_cells")
    rolled = spark.sql("SELECT kind, CASE WHEN grouping(day) = 0 THEN 'day' WHEN grouping(key_value) = 0 THEN 'key' ELSE 'total' END AS per, key_value, day, level, word, bit_or(bits) AS bits FROM emberline_cells GROUP BY GROUPING SETS ((kind, key_value, level, word), (kind, day, level, word), (kind, level, word))")
    rolled = rolled.where("per = 'total' OR key_value IS NOT NULL OR day IS NOT NULL")
    rows = bitmaps.estimates(rolled, ["kind", "per", "key_value", "day"])
    return rows.select("kind", "per", "key_value", C.yyyymmdd("day").alias("day"), "n_distinct")


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    hosts = T.table(spark, d, "host_aggregates").select(C.name("LogHost").alias("host"), "uname_other_compacnt_login_frac", "uname_that_compacnt_login_frac")
    return clusters.clusters(clusters.unit_points(hosts, "host", "uname_other_compacnt_login_frac", "uname_that_compacnt_login_frac"), ALIKE, LEAST_HOSTS)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d).where("id <> cluster").select(F.col("cluster").alias("host_a"), F.col("id").alias("host_b"))


def p7_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.describe(_clusters(spark, d)).select("cluster", "size", F.round("centre_x", 6).alias("centre_other"), F.round("centre_y", 6).alias("centre_that"), "rank", F.col("id").alias("log_host"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(T.table(spark, d, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, d: str):
    docs = T.table(spark, d, "documents").select("doc_id", C.name("source").alias("source"), "text").where("source IS NOT NULL")
    counted = mixing.written(bpe.count_tokens(docs, "text"))
    targets = T.table(spark, d, "mix_targets").select(C.name("source").alias("source"), "target_share", "max_repeats")
    return mixing.mix(counted, targets)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each source was meant to give, can give and does give."""
    chosen, report = _mixed(spark, d)
    goal = spark.createDataFrame([(x["source"], x["target_share"], x["max_repeats"], x["n_docs"], x["n_tokens"], float(x["goal_tokens"])) for x in report], "source string, target_share double, max_repeats int, n_docs bigint, n_tokens bigint, goal_tokens double")
    got = chosen.groupBy("source").agg(F.sum("copies").alias("n_chosen"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_chosen"), F.max("copies").alias("most_copies"))
    all_tokens = got.agg(F.sum("tokens_chosen")).first()[0] or 0
    rows = goal.join(got, "source", "left").na.fill(0, ["n_chosen", "tokens_chosen", "most_copies"])
    return rows.withColumn("actual_share", F.col("tokens_chosen") / F.lit(float(all_tokens) or None))


def _labels(spark: SparkSession, d: str):
    docs = T.table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return subjects.unit_labels(docs, T.table(spark, d, "subjects"), T.table(spark, d, "subject_examples"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    labels, codes, _ = _labels(spark, d)
    return subjects.document_subjects(labels, codes).select("doc_id", "subject")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """Composition of the corpus: documents with each subject and the subject's share of all units."""
    labels, codes, _ = _labels(spark, d)
    docs = subjects.document_subjects(labels, codes).groupBy("subject").agg(F.count("*").alias("n_docs"))
    names = spark.createDataFrame([(i, c) for i, c in enumerate([*codes, "none"])], "label int, subject string")
    weights = F.posexplode("weights").alias("label", "w")
    count = labels.select(weights).groupBy("label").agg(F.sum("w").alias("n_units"))
    total = labels.agg(F.sum("n_units").cast("double").alias("total"))
    rows = names.join(count, "label", "left").join(docs, "subject", "left").na.fill(0, ["n_units", "n_docs"]).crossJoin(F.broadcast(total))  # one row
    return rows.select("subject", "n_docs", F.round("n_units", 2).alias("n_units"), F.round(F.try_divide("n_units", "total"), 6).alias("unit_share"))


QUERIES = {f.__name__: f for f in (p2_found, p2_percentiles, p2_daily, p6_found, p6_rollup, p7_found, p7_clusters, p8_ids, p9_mix, p9_shares, p10_found, p10_shares)}

_FLOWS = """flows AS (SELECT DISTINCT CASE WHEN time >= 100000000000 THEN time WHEN time >= 1 THEN time * 1000 END AS ms, Duration, nullif(lower(trim(SrcDevice)), '') AS src, nullif(lower(trim(DstDevice)), '') AS dst, Protocol, SrcPort, DstPort, SrcPackets, DstPackets, SrcBytes, DstBytes FROM netflow)"""
_VALUES = "vals AS (" + " UNION ALL ".join(f"SELECT src, ms // 86400000 AS d, '{f}' AS field, CAST({f} AS DOUBLE) AS v FROM flows WHERE src IS NOT NULL AND {f} >= 0 AND NOT isnan(CAST({f} AS DOUBLE)) AND NOT isinf(CAST({f} AS DOUBLE))" for f in FIELDS) + ")"


def _pct(by: str, where: str, percents: list[int]) -> str:
    cols = ", ".join(f"max(v) FILTER (WHERE r = CAST(ceil({q} * n / 100.0) AS BIGINT)) AS p{q}" for q in percents)
    return f"SELECT {by}, field, max(n) AS n, {cols} FROM (SELECT {by}, field, v, row_number() OVER (PARTITION BY {by}, field ORDER BY v) AS r, count(*) OVER (PARTITION BY {by}, field) AS n FROM vals {where}) GROUP BY {by}, field"


_YMD = "CAST(strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y%m%d') AS BIGINT)"
_WHO = """who AS (SELECT 'users' AS kind, nullif(lower(trim(LogHost)), '') AS k, CASE WHEN "Time" > 100000000000 THEN "Time" // 1000 ELSE "Time" END // 86400 AS d, nullif(lower(trim(UserName)), '') AS w FROM windows_event_logs
 UNION ALL SELECT 'peers', nullif(lower(trim(SrcDevice)), ''), CASE WHEN time >= 100000000000 THEN time WHEN time >= 1 THEN time * 1000 END // 86400000, nullif(lower(trim(DstDevice)), '') FROM netflow)"""
_ALIKE = """h AS (SELECT nullif(lower(trim(LogHost)), '') AS h, min(uname_other_compacnt_login_frac) AS x, min(uname_that_compacnt_login_frac) AS y FROM host_aggregates WHERE uname_other_compacnt_login_frac BETWEEN 0 AND 1 AND uname_that_compacnt_login_frac BETWEEN 0 AND 1 AND nullif(lower(trim(LogHost)), '') IS NOT NULL GROUP BY 1),
 g AS (SELECT a.h, a.x, a.y, min(b.h) AS m FROM h a JOIN h b ON abs(a.x - b.x) <= 0.03 AND abs(a.y - b.y) <= 0.03 GROUP BY a.h, a.x, a.y HAVING count(*) >= 5)"""
ORACLE = {
    "p2_found": f"WITH {_FLOWS}, {_VALUES}, p AS ({_pct('src', '', [50, 99])}) SELECT src AS src_device, field FROM p WHERE n >= 60 AND p50 > 0 AND p99 >= 50 * p50",
    "p6_found": f"WITH {_WHO} SELECT kind, k AS key_value, {_YMD} AS day FROM who WHERE k IS NOT NULL AND d IS NOT NULL GROUP BY kind, k, d HAVING count(DISTINCT w) >= 24",
    "p7_found": f"WITH {_ALIKE} SELECT m AS host_a, h AS host_b FROM g WHERE h <> m",
    "p7_clusters": f"WITH {_ALIKE}, c AS (SELECT m, count(*) AS size, avg(x) AS cx, avg(y) AS cy FROM g GROUP BY 1), r AS (SELECT m, size, cx, cy, h, row_number() OVER (PARTITION BY m ORDER BY sqrt(pow(x - cx, 2) + pow(y - cy, 2)), h) AS rank FROM g JOIN c USING (m)) SELECT m AS cluster, size, round(cx, 6) AS centre_other, round(cy, 6) AS centre_that, CAST(rank AS INTEGER) AS rank, h AS log_host FROM r WHERE rank <= 5",
}
