"""Queries for the further forms of operators: other sources, encodings, orders and measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import clean as C
from emberline.functions import text as X
from emberline.functions import url as U
from emberline.functions import vectors as V
from emberline.operators import encode, joins, predicates, sequences, statistics
from emberline.plans.durable import scratch
from emberline.plans.relational import ESQL, E
from emberline.plans.security import USQL, urls
from emberline.sources import archives, matlab, readers, sinks
from emberline.sources import tables as T

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


# ---- sources and sinks -------------------------------------------------------------------


@query("SELECT EventID, count(*) AS n, count(Source) AS n_sources FROM windows_event_logs GROUP BY 1")
def scan_bz2(s: SparkSession, d: str) -> DataFrame:
    """The event log as bzip2 blocks of JSON lines, which are read in parallel."""
    p = scratch(s)
    T.table(s, d, "windows_event_logs").select(*T.LOG_FIELDS).write.option("compression", "bzip2").json(p)
    return readers.logs_json(s, p).groupBy("EventID").agg(F.count("*").alias("n"), F.count("Source").alias("n_sources"))


@query("SELECT n_nationkey AS nation_key, n_name AS nation_name, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def scan_json_array(s, d):
    """One file with an array of nested objects, flattened."""
    p = scratch(s)
    n = T.table(s, d, "nation").join(T.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.struct(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("nation"), F.struct(F.col("r_name").alias("name")).alias("region")).alias("r"))
    rows.agg(F.to_json(F.collect_list("r")).alias("value")).write.text(p)  # 25 rows
    return predicates.flatten(readers.json_array(s, p, "nation struct<key: int, name: string>, region struct<name: string>"))


@query("SELECT CAST(EventID AS VARCHAR) AS id, description, 'urls' AS plugin FROM event_types UNION ALL SELECT CAST(PortNumber AS VARCHAR), Description, 'vadinfo' FROM port_names")
def snapshot_walk(s, d):
    """Plugin files below a folder: one plugin lists a title that its rows don't have, one file is broken."""
    p = scratch(s)

    def plugin(name: str, titles: list[str], rows: DataFrame) -> None:
        t = rows.agg(F.collect_list(F.array(*rows.columns)).alias("data"))  # both are short fixed tables
        t.select(F.to_json(F.struct(F.lit(name).alias("plugin"), F.array(*[F.lit(x) for x in titles]).alias("titles"), "data", F.size("data").alias("count"))).alias("value")).write.text(f"{p}/snapshot-1/{name}")

    plugin("urls", ["id", "description", "SHA256"], T.table(s, d, "event_types").select(F.col("EventID").cast("string"), "description", F.lit("x").alias("h")))
    plugin("vadinfo", ["id", "SHA256", "description"], T.table(s, d, "port_names").select(F.col("PortNumber").cast("string"), "Description"))
    s.range(1).select(F.lit('{"plugin": "urls", "titles": [').alias("value")).write.text(f"{p}/snapshot-2/broken")
    return readers.snapshots(s, p, ["id", "description"], glob="*.txt").select("id", "description", "plugin")


@query("SELECT CAST(k AS BIGINT) AS k, n, total FROM (SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1) t, (SELECT 3 AS k)")
def model_store(s, d):
    """A fitted table and its parameters, stored and read back."""
    p = scratch(s)
    fitted = T.table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    sinks.save_table_model(s, p, {"k": 3}, counts=fitted)
    meta, tables = sinks.load_table_model(s, p, "counts")
    return tables["counts"].select(F.lit(meta["k"]).cast("bigint").alias("k"), "n", "total")


@query("SELECT user_id, event_type AS event, value AS the_value FROM events")
def header_names(s, d):
    """Column names with spaces in and around them, made regular."""
    e = T.table(s, d, "events").select(F.col("user_id").alias(" user  id "), F.col("event_type").alias("event"), F.col("value").alias("the value "))
    return predicates.regular_names(e)


@query("SELECT r_regionkey AS region, r_name AS name FROM region")
def fetch_archive(s, d):
    """A table as a CSV file in a zip archive, fetched by its address, taken apart and read."""
    import tempfile
    import zipfile
    from pathlib import Path

    rows = T.table(s, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()  # 5 rows
    shared = scratch(s)
    with tempfile.TemporaryDirectory() as folder:  # the driver's own; what executors read goes to the shared folder
        with zipfile.ZipFile(f"{folder}/region.zip", "w") as z:
            z.writestr("data/region.csv", "".join(f"{r[0]},{r[1]}\n" for r in rows))
        for p in archives.fetch(Path(f"{folder}/region.zip").as_uri(), f"{folder}/out"):
            sinks.binary(s, Path(p).read_bytes(), f"{shared}/{Path(p).name}")
    return readers.csv(s, shared, "region int, name string", header=False)


@query("SELECT CAST(n_nationkey AS BIGINT) AS src, CAST(n_regionkey AS BIGINT) AS dst, CAST(n_regionkey + 1 AS DOUBLE) AS weight FROM nation")
def mat_edges(s, d):
    """Nations and their regions as a sparse matrix in a MAT file, read back as edges."""
    import numpy as np

    rows = T.table(s, d, "nation").select("n_nationkey", "n_regionkey").collect()  # 25 rows
    entries = np.array([(r[0], r[1], r[1] + 1.0) for r in rows]).reshape(-1, 3)
    p = scratch(s)
    content = matlab.packed("adjacency", entries, (25, 5), compressed=True)
    sinks.binary(s, content, f"{p}/graph.mat")
    return matlab.edges(matlab.read(s, p), "adjacency")


# ---- orders ------------------------------------------------------------------------------


@query("WITH a AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders) SELECT position, event_id, o_orderkey FROM a FULL JOIN b USING (position)")
def positional_concat(s, d):
    """Two tables side by side by position; the shorter one ends in nulls."""
    return joins.positional(T.table(s, d, "events").select("event_id", "ts"), T.table(s, d, "orders").select("o_orderkey", "o_orderdate"), ["ts", "event_id"], ["o_orderdate", "o_orderkey"]).select("position", "event_id", "o_orderkey")


@query("WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY created_ts, doc_id) - 1 AS place, coalesce(length(text), 0) AS n FROM documents) SELECT doc_id, place, n, (row_number() OVER (ORDER BY n DESC, place) - 1) // 64 AS batch FROM o")
def length_batches(s, d):
    """Batches of texts of like length, each row with its place in the old order, by which it finds back."""
    docs = T.table(s, d, "documents").select("doc_id", "created_ts", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"))
    rows = sequences.length_batches(docs, ["created_ts", "doc_id"], "n", 64)
    return rows.select("doc_id", "place", "n", "batch")


# ---- text --------------------------------------------------------------------------------


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS decoded FROM nation")
def char_decode(s, d):
    """Names to character ids and back."""
    n = T.table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")
    v = encode.char_vocabulary(n, "n_name")
    return encode.decode_characters(encode.encode_characters(n, "n_nationkey", "n_name", v), "n_nationkey", v, "decoded")


@query(f"WITH {USQL} SELECT doc_id, url, trim(trim(url, 'htps:/'), 'htp:/') AS stripped FROM u")
def url_strip(s, d):
    """Characters, not prefixes, stripped from both ends."""
    return urls(s, d).select("doc_id", "url", U.strip_characters(U.strip_characters(F.col("url"), "https://"), "http://").alias("stripped"))


@query()
def hashed_tokens(s, d):
    """Token bags of the languages under 32-bit hashes (Murmur 3, seed 23), as stored sketches have them."""
    words = F.explode(X.letter_tokens(F.col("text"))).alias("token")
    bag = T.table(s, d, "documents").select("lang", words).groupBy("lang", "token").agg(F.count("*").alias("n"))
    return bag.select("lang", "token", X.murmur3(F.col("token")).alias("hash"), "n")


@query("SELECT p_partkey, CAST(length(substr(p_name, 1, CAST(p_partkey % 8 AS INTEGER))) AS INTEGER) AS len, array_to_string(list_sort(list_filter(list_distinct(string_split(substr(p_name, 1, CAST(p_partkey % 8 AS INTEGER)), '')), lambda x: x <> '')), '|') AS chars FROM part WHERE p_partkey % 8 <= 4")
def short_shingles(s, d):
    """Shingles of texts that are no longer than a shingle: their characters."""
    p = T.table(s, d, "part").where("p_partkey % 8 <= 4").select("p_partkey", F.expr("substr(p_name, 1, cast(p_partkey % 8 as int))").alias("t"))
    return p.select("p_partkey", F.length("t").alias("len"), F.array_join(F.array_sort(X.shingles(F.col("t"), 4)), "|").alias("chars"))


# ---- measures ----------------------------------------------------------------------------

_HA = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"


@query(f"WITH p AS (SELECT o_orderkey, epoch(o_orderdate) AS t, CAST(o_custkey % 180 - 90 AS DOUBLE) AS lat1, CAST(o_custkey % 360 - 180 AS DOUBLE) AS lon1, CAST(o_orderkey % 180 - 90 AS DOUBLE) AS lat2, CAST(o_orderkey % 360 - 180 AS DOUBLE) AS lon2 FROM orders), a AS (SELECT o_orderkey, t, {_HA} AS a FROM p) SELECT o_orderkey, round(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) / nullif(t / 1e9, 0), 3) AS speed FROM a")
def travel_speed(s, d):
    """Kilometres over the clock in thousands of millions of seconds."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    km = V.haversine_km((c % 180 - 90).cast("double"), (c % 360 - 180).cast("double"), (o % 180 - 90).cast("double"), (o % 360 - 180).cast("double"))
    return T.table(s, d, "orders").select("o_orderkey", F.round(V.speed(km, F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))), 3).alias("speed"))


@query("WITH c AS (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2), r AS (SELECT event_type, n AS m FROM c WHERE user_id = (SELECT min(user_id) FROM events)), j AS (SELECT u.user_id, t.event_type, coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM (SELECT DISTINCT user_id FROM c) u CROSS JOIN (SELECT DISTINCT event_type FROM c) t LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = t.event_type LEFT JOIN r ON r.event_type = t.event_type) SELECT user_id, round(1 - sum(least(n, m)) / sum(greatest(n, m)), 6) AS distance FROM j GROUP BY 1")
def weighted_jaccard(s, d):
    """Distance of each user's bag of event types to that of the first user."""
    bags = T.table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("bag"))  # a few types a user
    first = bags.agg(F.min_by("bag", "user_id").alias("ref"))
    return bags.crossJoin(F.broadcast(first)).select("user_id", F.round(V.weighted_jaccard(F.col("bag"), F.col("ref")), 6).alias("distance"))  # one row


@query("SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 5) AS z FROM events")
def standard_scale(s, d):
    """Values over their population deviation."""
    return statistics.standardised(T.table(s, d, "events"), "value", "event_id").withColumn("z", F.round("z", 5))


@query("WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events WHERE event_type = 'purchase'), v AS (SELECT value, lo, hi FROM events, b WHERE event_type = 'error' AND value BETWEEN lo AND hi) SELECT CAST(least(floor((value - lo) * 10 / (hi - lo)), 9) AS INTEGER) AS bin, count(*) AS n FROM v GROUP BY 1")
def histogram_reuse(s, d):
    """Errors in the bins of purchases."""
    e = T.table(s, d, "events")
    lo, hi = e.where("event_type = 'purchase'").agg(F.min("value"), F.max("value")).first()
    return statistics.histogram(e.where("event_type = 'error'"), "value", 10, lo, hi)


@query(f"WITH {ESQL}, t AS (SELECT event_type = 'error' AS a, k % 2 AS b, CAST(count(*) AS DOUBLE) AS o FROM e GROUP BY 1, 2), m AS (SELECT o, sum(o) OVER (PARTITION BY a) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS x, sum(o) OVER () AS n FROM t) SELECT CAST(max(n) AS BIGINT) AS n, round(sqrt(sum(pow(abs(o - x) - least(0.5, abs(o - x)), 2) / x) / max(n)), 5) AS v FROM m")
def cramers_v_2x2(s, d):
    """Cramer's V of a table of two by two, with Yates' correction."""
    e = E(s, d).select((F.col("event_type") == "error").alias("a"), (F.col("k") % 2).alias("b"))
    return statistics.cramers_v(e, "a", "b").select("n", F.round("v", 5).alias("v"))


@query("WITH v AS (SELECT value AS a, 2 * value + 1 AS b, -value AS c, CAST(user_id AS DOUBLE) AS d FROM events) SELECT 'a' AS column_name UNION ALL SELECT 'b' FROM v HAVING corr(a, b) <= 0.95 UNION ALL SELECT 'c' FROM v HAVING corr(a, c) <= 0.95 AND corr(b, c) <= 0.95 UNION ALL SELECT 'd' FROM v HAVING corr(a, d) <= 0.95 AND corr(b, d) <= 0.95 AND corr(c, d) <= 0.95")
def drop_correlated(s, d):
    """Columns that are left when those that go with an earlier one are dropped."""
    v = F.col("value")
    df = T.table(s, d, "events").select(v.alias("a"), (2 * v + 1).alias("b"), (-v).alias("c"), F.col("user_id").cast("double").alias("d"))
    return s.createDataFrame([(c,) for c in predicates.uncorrelated(df, ["a", "b", "c", "d"])], "column_name string")
