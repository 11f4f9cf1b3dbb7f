"""Queries over the event tables for problems 1, 3, 4 and 5, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import clean as C
from emberline.operators import entity_features, rolling, sessions, tree_agg
from emberline.sources import tables as T

#: Production parameters.
SESSION_GAP = 1_800
SURGE_PERCENT = 70
HEAVY_SHARE = 0.02
QUIET_DAYS = 14


def _last_flow_day(spark: SparkSession, d: str) -> int | None:
    return T.table(spark, d, "netflow").agg(C.day_of_ms(F.max(C.flow_ms("time")))).first()[0]


def _last_record_s(spark: SparkSession, d: str) -> int | None:
    return T.table(spark, d, "windows_event_logs").agg(F.max(C.log_s("Time"))).first()[0]


def rolled(spark: SparkSession, d: str) -> DataFrame:
    daily = rolling.daily_totals(T.flows(T.table(spark, d, "netflow"), "src_device", "ms", "SrcPackets", "SrcBytes"), "src_device", C.day_of_ms("ms"), ["SrcPackets", "SrcBytes"])
    return rolling.rolling_totals(daily, ["SrcPackets", "SrcBytes"], _last_flow_day(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    hit = rolling.surges(rolled(spark, d), ["SrcBytes", "SrcPackets"], 7, 30, SURGE_PERCENT)
    return hit.select(F.col("entity").alias("src_device"), C.yyyymmdd("day").alias("day"))


def p1_rolling(spark: SparkSession, d: str) -> DataFrame:
    cols = [F.col(f"{m}_{p}").alias(f"{a}_{p}") for m, a in (("SrcPackets", "packets"), ("SrcBytes", "bytes")) for p in (7, 30)]
    avgs = [F.round(F.col(f"{m}_avg_{p}"), 4).alias(f"{a}_avg_{p}") for m, a in (("SrcPackets", "packets"), ("SrcBytes", "bytes")) for p in (7, 30)]
    return rolled(spark, d).select(F.col("entity").alias("src_device"), C.yyyymmdd("day").alias("day"), *cols, *avgs)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # start and end of a session don't depend on repeated rows, so the records needn't be made distinct
    rows = T.read_records(T.table(spark, d, "windows_event_logs"))
    cut = sessions.sessions_at(sessions.session_tree(rows, "user_name", "time_s"), SESSION_GAP)
    return cut.select(F.col("entity").alias("user_name"), "start_time", "end_time")


def p3_sessions(spark: SparkSession, d: str) -> DataFrame:
    # both kinds of entity go through one tree, so the records are made distinct and read once
    rows = T.records(T.table(spark, d, "windows_event_logs"), "user_name", "log_host", "time_s")
    kinds = {"u": "user_name", "h": "log_host"}
    both = rows.select("time_s", F.explode(F.array(*[F.concat(F.lit(p), F.col(c)) for p, c in kinds.items()])).alias("who"))
    cut = sessions.sessions_at(sessions.session_tree(both, "who", "time_s"), SESSION_GAP)
    kind = F.when(F.col("entity").startswith("u"), kinds["u"]).otherwise(kinds["h"])
    return cut.select(kind.alias("kind"), F.substring("entity", 2, 2**31 - 1).alias("entity"), "start_time", "end_time", "duration", "n_records")


def p3_gap_settings(spark: SparkSession, d: str) -> DataFrame:
    """Number of sessions and longest session of each user at several thresholds, from one tree."""
    rows = T.read_records(T.table(spark, d, "windows_event_logs"))
    each = sessions.sessions_for(sessions.session_tree(rows, "user_name", "time_s"), [300, 1_800, 3_600, 21_600])
    return each.groupBy(F.col("entity").alias("user_name"), "gap_s").agg(F.count("*").alias("n_sessions"), F.max("duration").alias("longest_s"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for table, column in (("netflow", "SrcDevice"), ("windows_event_logs", "LogHost")):
        rows = T.table(spark, d, table).select(C.name(column).alias("k"))
        parts.append(tree_agg.heavy_keys(rows, "k", HEAVY_SHARE).select(F.lit(table).alias("table_name"), "key_value"))
    return parts[0].union(parts[1])


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    flows = T.table(spark, d, "netflow").select(C.name("SrcDevice").alias("k"), C.flow_ms("time").alias("ms"), C.count_of("SrcPackets").alias("p"), C.count_of("SrcBytes").alias("b"))
    logs = T.table(spark, d, "windows_event_logs").select(C.name("LogHost").alias("k"), (C.log_s("Time") * 1000).alias("ms"), F.lit(None).cast("bigint").alias("p"), F.lit(None).cast("bigint").alias("b"))
    aggs = {"n_rows": ("count", "one"), "packets": ("sum", "p"), "bytes": ("sum", "b"), "first_ms": ("min", "ms"), "last_ms": ("max", "ms")}
    parts = [tree_agg.tree_aggregate(x.where("k IS NOT NULL").withColumn("one", F.lit(1)), ["k"], aggs).withColumn("table_name", F.lit(t)) for x, t in ((flows, "netflow"), (logs, "windows_event_logs"))]
    return parts[0].unionByName(parts[1]).select("table_name", F.col("k").alias("key_value"), *aggs)


def _pairs(spark: SparkSession, d: str, timeless: bool) -> tuple[DataFrame, DataFrame | None]:
    """Records by host, event id and user, each record once, and the hosts that are split."""
    rows = T.read_records(T.table(spark, d, "windows_event_logs"))
    splits = entity_features.split_table(rows, "log_host")
    keyed = rows.select("log_host", "event_id", "user_name", "time_s", *T.row_hash(rows))
    keyed = keyed if timeless else keyed.where("time_s IS NOT NULL")
    return entity_features.event_pairs(keyed, "log_host", "event_id", "user_name", "time_s", ["h1", "h2"], splits), splits


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    last = _last_record_s(spark, d)
    runs = entity_features.event_runs(*_pairs(spark, d, False))  # the moment matters
    quiet = runs.where((F.col("n") >= 5) & (F.col("n_actors") >= 2) & (C.day_of_s("latest") <= F.lit(None if last is None else last // C.DAY_S - QUIET_DAYS).cast("int")))
    return quiet.select(F.col("entity").alias("log_host"), F.col("type").alias("event_id"))


def p5_features(spark: SparkSession, d: str) -> DataFrame:
    # the catalogue of event types is a fixed list, one column each
    types = [r[0] for r in T.table(spark, d, "event_types").select("EventID").where("EventID IS NOT NULL").distinct().orderBy("EventID").collect()]
    pairs, splits = _pairs(spark, d, True)
    return entity_features.wide_features(pairs, types, _last_record_s(spark, d) or 0, splits).withColumnRenamed("entity", "log_host")


def p5_long(spark: SparkSession, d: str) -> DataFrame:
    """The same numbers one row per host and event id, for every event id that occurs."""
    return entity_features.event_runs(*_pairs(spark, d, True)).select(F.col("entity").alias("log_host"), F.col("type").alias("event_id"), "n", "latest", F.col("n_actors").alias("n_users"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rolling, p3_found, p3_sessions, p3_gap_settings, p4_found, p4_totals, p5_found, p5_features, p5_long)}

#: Common table expressions of the checking SQL: flows and records as the conventions read them.
FLOWS_SQL = """flows AS (SELECT DISTINCT CASE WHEN time >= 100000000000 THEN time WHEN time >= 1 THEN time * 1000 END AS ms, Duration, nullif(lower(trim(SrcDevice)), '') AS src, nullif(lower(trim(DstDevice)), '') AS dst, Protocol, SrcPort, DstPort, SrcPackets, DstPackets, SrcBytes, DstBytes FROM netflow)"""
RECORDS_SQL = """recs AS (SELECT DISTINCT CASE WHEN "Time" > 100000000000 THEN "Time" // 1000 ELSE "Time" END AS t, EventID, nullif(lower(trim(LogHost)), '') AS host, nullif(lower(trim(UserName)), '') AS usr, nullif(lower(trim(DomainName)), '') AS dom, LogonType, nullif(lower(trim(Source)), '') AS src, nullif(lower(trim(Destination)), '') AS dst FROM windows_event_logs)"""
_ROLL = f"""WITH {FLOWS_SQL},
 daily AS (SELECT src, ms // 86400000 AS d, sum(greatest(coalesce(SrcPackets, 0), 0)) AS p, sum(greatest(coalesce(SrcBytes, 0), 0)) AS b FROM flows WHERE src IS NOT NULL AND ms IS NOT NULL GROUP BY 1, 2),
 lastd AS (SELECT max(ms // 86400000) AS l FROM flows),
 cal AS (SELECT src, f, unnest(range(f, l + 1)) AS d FROM (SELECT src, min(d) AS f, (SELECT l FROM lastd) AS l FROM daily GROUP BY src)),
 filled AS (SELECT c.src, c.f, c.d, coalesce(p, 0) AS p, coalesce(b, 0) AS b FROM cal c LEFT JOIN daily x ON x.src = c.src AND x.d = c.d),
 roll AS (SELECT src, f, d, sum(p) OVER w7 AS p7, sum(p) OVER w30 AS p30, sum(b) OVER w7 AS b7, sum(b) OVER w30 AS b30 FROM filled
   WINDOW w7 AS (PARTITION BY src ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), w30 AS (PARTITION BY src ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))"""
_YMD = "CAST(strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y%m%d') AS BIGINT)"


def _sessions_sql(kind: str, gap: str = "1800") -> str:
    return f"""SELECT k, min(t) AS s, max(t) AS e, count(*) AS n FROM (SELECT k, t, sum(new) OVER (PARTITION BY k ORDER BY t, i ROWS UNBOUNDED PRECEDING) AS g FROM
 (SELECT {kind} AS k, t, row_number() OVER (PARTITION BY {kind} ORDER BY t) AS i, CASE WHEN t - lag(t) OVER (PARTITION BY {kind} ORDER BY t) <= {gap} THEN 0 ELSE 1 END AS new FROM recs WHERE {kind} IS NOT NULL AND t IS NOT NULL)) GROUP BY k, g"""


_PAIRS = f"""WITH {RECORDS_SQL}, r AS (SELECT host, CAST(EventID AS BIGINT) AS ev, count(*) AS n, max(t) AS latest, count(DISTINCT usr) AS u FROM recs WHERE host IS NOT NULL AND EventID IS NOT NULL{{}} GROUP BY 1, 2)"""
_LONG, _TIMED = _PAIRS.format(""), _PAIRS.format(" AND t IS NOT NULL")

ORACLE = {
    "p1_found": f"{_ROLL} SELECT src AS src_device, {_YMD} AS day FROM roll WHERE d >= f + 29 AND b7 * 100 > b30 * 70 AND p7 * 100 > p30 * 70",
    "p1_rolling": f"{_ROLL} SELECT src AS src_device, {_YMD} AS day, CAST(p7 AS BIGINT) AS packets_7, CAST(p30 AS BIGINT) AS packets_30, CAST(b7 AS BIGINT) AS bytes_7, CAST(b30 AS BIGINT) AS bytes_30, round(p7 / 7, 4) AS packets_avg_7, round(p30 / 30, 4) AS packets_avg_30, round(b7 / 7, 4) AS bytes_avg_7, round(b30 / 30, 4) AS bytes_avg_30 FROM roll",
    "p3_found": f"WITH {RECORDS_SQL} SELECT k AS user_name, s AS start_time, e AS end_time FROM ({_sessions_sql('usr')})",
    "p3_sessions": f"WITH {RECORDS_SQL} SELECT 'user_name' AS kind, k AS entity, s AS start_time, e AS end_time, e - s AS duration, n AS n_records FROM ({_sessions_sql('usr')}) UNION ALL SELECT 'log_host', k, s, e, e - s, n FROM ({_sessions_sql('host')})",
    "p3_gap_settings": f"WITH {RECORDS_SQL} SELECT user_name, gap_s, count(*) AS n_sessions, max(l) AS longest_s FROM ("
    + " UNION ALL ".join(f"SELECT k AS user_name, {g} AS gap_s, e - s AS l FROM ({_sessions_sql('usr', str(g))})" for g in (300, 1800, 3600, 21600))
    + ") GROUP BY 1, 2",
    "p4_found": "SELECT 'netflow' AS table_name, k AS key_value FROM (SELECT nullif(lower(trim(SrcDevice)), '') AS k, count(*) AS n FROM netflow GROUP BY 1) WHERE k IS NOT NULL AND n >= 0.02 * (SELECT count(*) FROM netflow) UNION ALL SELECT 'windows_event_logs', k FROM (SELECT nullif(lower(trim(LogHost)), '') AS k, count(*) AS n FROM windows_event_logs GROUP BY 1) WHERE k IS NOT NULL AND n >= 0.02 * (SELECT count(*) FROM windows_event_logs)",
    "p4_totals": """SELECT 'netflow' AS table_name, nullif(lower(trim(SrcDevice)), '') AS key_value, count(*) AS n_rows, CAST(sum(greatest(coalesce(SrcPackets, 0), 0)) AS BIGINT) AS packets, CAST(sum(greatest(coalesce(SrcBytes, 0), 0)) AS BIGINT) AS bytes, min(CASE WHEN time >= 100000000000 THEN time WHEN time >= 1 THEN time * 1000 END) AS first_ms, max(CASE WHEN time >= 100000000000 THEN time WHEN time >= 1 THEN time * 1000 END) AS last_ms FROM netflow WHERE nullif(lower(trim(SrcDevice)), '') IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'windows_event_logs', nullif(lower(trim(LogHost)), ''), count(*), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), min(CASE WHEN "Time" > 100000000000 THEN "Time" // 1000 ELSE "Time" END) * 1000, max(CASE WHEN "Time" > 100000000000 THEN "Time" // 1000 ELSE "Time" END) * 1000 FROM windows_event_logs WHERE nullif(lower(trim(LogHost)), '') IS NOT NULL GROUP BY 2""",
    "p5_found": f"{_TIMED} SELECT host AS log_host, ev AS event_id FROM r WHERE n >= 5 AND u >= 2 AND latest // 86400 <= (SELECT max(t) // 86400 FROM recs) - 14",
    "p5_features": f"{_LONG}, c AS (SELECT DISTINCT CAST(EventID AS BIGINT) AS ev FROM event_types WHERE EventID IS NOT NULL), h AS (SELECT DISTINCT host FROM r), g AS (SELECT h.host, c.ev, coalesce(r.n, 0) AS n, (SELECT max(t) FROM recs) - latest AS age, coalesce(u, 0) AS u FROM h CROSS JOIN c LEFT JOIN r ON r.host = h.host AND r.ev = c.ev), l AS (SELECT host AS log_host, unnest(['cnt_' || ev, 'age_' || ev, 'users_' || ev]) AS name, unnest([n, age, u]) AS v FROM g) SELECT * FROM (PIVOT l ON name USING max(v) GROUP BY log_host)",
    "p5_long": f"{_LONG} SELECT host AS log_host, ev AS event_id, n, latest, u AS n_users FROM r",
}
