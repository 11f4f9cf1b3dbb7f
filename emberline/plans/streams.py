"""Queries over streams, with the SQL that checks them.

The events come as files that are written week by week, in order of time, and read a week per
micro-batch, so that state, windows and numbers have to cross batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans.durable import scratch
from emberline.sources import tables as T
from emberline.streaming import pipelines as P

Q: dict = {}
S: dict[str, str] = {}
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"
#: Last day of the month of each week's files but the last week's, and files of a week.
CUTS, FILES = (8, 16, 24), 4


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def _rows(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _add_files(s: SparkSession, d: str, path: str, first: int = 0, last: int = 4) -> None:
    day, bounds = F.dayofmonth("ts"), (0, *CUTS, 31)
    for i in range(first, last):
        _rows(s, d).where((day > bounds[i]) & (day <= bounds[i + 1])).repartition(FILES).write.mode("append").parquet(path)


def _stream(s: SparkSession, d: str) -> DataFrame:
    """The events, a week per micro-batch."""
    src = scratch(s)
    _add_files(s, d, src)
    return P.file_stream(s, src, SCHEMA, "parquet", FILES, "*.parquet")


def _in_memory(s: SparkSession, counts: DataFrame) -> DataFrame:
    name = "emberline_" + scratch(s).rsplit("/", 1)[1]
    P.into_memory(counts, name, scratch(s)).awaitTermination()
    return s.table(name)


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def stream_files(s, d):
    src, out = scratch(s), scratch(s)
    _rows(s, d).repartition(4).write.json(src)
    stream = P.file_stream(s, src, SCHEMA, files_per_batch=2)
    P.run(P.pipeline(stream, lambda x: x.select("event_type", "value")), out, scratch(s)).awaitTermination()
    return s.read.schema("event_type string, value double").parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_watch(s, d):
    """A watched folder: files that come while the query runs are taken as well."""
    src, out = scratch(s), scratch(s)
    _add_files(s, d, src, 0, 2)
    q = P.run(P.file_stream(s, src, SCHEMA, "parquet", FILES, "*.parquet").select("event_type"), out, scratch(s), watch=True, every="1 second")
    try:
        q.processAllAvailable()
        _add_files(s, d, src, 2, 4)
        q.processAllAvailable()
    finally:
        q.stop()
    return s.read.schema("event_type string").parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(s, d):
    out = _in_memory(s, P.tumbling_counts(_stream(s, d), "ts", "1 hour", ["event_type"]))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') - o * INTERVAL 6 HOUR AS window_start, event_type, count(*) AS n FROM events, (SELECT unnest(range(4)) AS o) GROUP BY 1, 2")
def sliding_counts(s, d):
    """Windows of a day, one every six hours."""
    out = _in_memory(s, P.sliding_counts(_stream(s, d), "ts", "24 hours", "6 hours", ["event_type"]))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 12 HOUR AS window_end, count(*) AS n FROM i GROUP BY user_id, i.i")
def session_counts(s, d):
    """Event-time sessions of each user, some of them reaching over micro-batches."""
    out = _in_memory(s, P.session_counts(_stream(s, d), "ts", "12 hours", ["user_id"]))
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")], "n")


@query("WITH m AS (SELECT max(ts) - INTERVAL 2 DAY AS w FROM events) SELECT date_trunc('day', ts) AS window_start, count(*) AS n FROM events, m GROUP BY 1, m.w HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= m.w")
def watermark_counts(s, d):
    """Days are given out, once and whole, when they are two days behind the latest event; rows
    of a week ago that come in again at the end are too late for any day and left out."""
    src, out = scratch(s), scratch(s)
    _add_files(s, d, src)
    _rows(s, d).where(F.dayofmonth("ts") <= CUTS[1]).repartition(FILES).write.mode("append").parquet(src)
    stream = P.file_stream(s, src, SCHEMA, "parquet", FILES, "*.parquet")
    P.run(P.tumbling_counts(stream, "ts", "1 day", [], "2 days"), out, scratch(s)).awaitTermination()
    return s.read.parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("WITH o AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT event_id, CAST(count(value) OVER w AS BIGINT) AS n_before, round(avg(value) OVER w, 9) AS mean_before FROM o WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def stream_sender_state(s, d):
    """Keyed state over four micro-batches gives what the batch window over earlier rows gives."""
    out = scratch(s)
    P.run(P.running_moments(_stream(s, d), "user_id", "ts", "event_id", "value"), out, scratch(s)).awaitTermination()
    return s.read.parquet(out).select("event_id", "n_before", F.round("mean_before", 9).alias("mean_before"))


@query(f"WITH b AS (SELECT *, CASE WHEN day(ts) <= {CUTS[0]} THEN 0 WHEN day(ts) <= {CUTS[1]} THEN 1 WHEN day(ts) <= {CUTS[2]} THEN 2 ELSE 3 END AS batch FROM events) SELECT CAST(batch AS BIGINT) AS batch, 'node' AS kind, count(DISTINCT user_id) + count(DISTINCT event_type) AS n FROM b GROUP BY 1 UNION ALL SELECT batch, 'edge', count(*) FROM (SELECT DISTINCT batch, user_id, event_type FROM b) GROUP BY 1")
def stream_batches(s, d):
    """Each micro-batch's graph, its nodes and its edges, into tables of their own."""
    out = scratch(s)

    def graph(rows: DataFrame, number: int) -> None:
        edges = rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("t"), "event_type").alias("dst")).distinct()
        edges.write.mode("overwrite").parquet(f"{out}/edge/batch={number}")
        edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().write.mode("overwrite").parquet(f"{out}/node/batch={number}")

    P.per_batch(_stream(s, d), graph, scratch(s)).awaitTermination()
    counts = [s.read.parquet(f"{out}/{k}").groupBy(F.col("batch").cast("bigint").alias("batch")).agg(F.count("*").alias("n")).select("batch", F.lit(k).alias("kind"), "n") for k in ("node", "edge")]
    return counts[0].unionByName(counts[1])


@query(f"SELECT CASE WHEN day(ts) <= {CUTS[0]} THEN 0 WHEN day(ts) <= {CUTS[1]} THEN 1 WHEN day(ts) <= {CUTS[2]} THEN 2 ELSE 3 END AS batch, count(*) AS n_rows, 'ended' AS state FROM events GROUP BY 1")
def stream_monitor(s, d):
    """What the throughput monitor saw of a stream, and that its closing hook ran."""
    closed: dict[str, str] = {}
    monitor = P.Throughput(lambda i, error: closed.update({i: error or "ended"}))
    s.streams.addListener(monitor)
    try:
        q = P.run(_stream(s, d).select("event_id"), scratch(s), scratch(s))
        q.awaitTermination()
        monitor.wait(q.id)
    finally:
        s.streams.removeListener(monitor)
    return s.createDataFrame([(b, n, closed[q.id]) for b, n in sorted(monitor.rows(q.id).items())], "batch int, n_rows bigint, state string")
