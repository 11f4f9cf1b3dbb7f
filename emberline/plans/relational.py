"""Queries for scans, projections, joins, aggregations, windows, sampling and set operators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import clean as C
from emberline.functions import text as X
from emberline.operators import assets, encode, evaluation, hosts, joins, predicates, sampling, sequences, statistics
from emberline.plans.durable import scratch, written
from emberline.sources import readers, sinks
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


def E(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def R(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return T.records(T.table(s, d, "windows_event_logs"), *columns)


def FL(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return T.flows(T.table(s, d, "netflow"), *columns)


ESQL = "e AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"
WE = f"WITH {ESQL} "
FSQL = """f AS (SELECT DISTINCT CASE WHEN time >= 100000000000 THEN time WHEN time >= 1 THEN time * 1000 END AS ms, Duration, nullif(lower(trim(SrcDevice)), '') AS src, nullif(lower(trim(DstDevice)), '') AS dst, Protocol, SrcPort, DstPort, SrcPackets, DstPackets, SrcBytes, DstBytes FROM netflow)"""
RSQL = """r AS (SELECT DISTINCT CASE WHEN "Time" > 100000000000 THEN "Time" // 1000 ELSE "Time" END AS t, EventID AS ev, nullif(lower(trim(LogHost)), '') AS host, nullif(lower(trim(UserName)), '') AS usr, nullif(lower(trim(DomainName)), '') AS dom, LogonType AS lt, nullif(lower(trim(Source)), '') AS src, nullif(lower(trim(Destination)), '') AS dst FROM windows_event_logs)"""


# ---- sources and sinks -------------------------------------------------------------------


@query("SELECT DstPort, count(*) AS n, CAST(sum(SrcBytes) AS BIGINT) AS bytes FROM netflow GROUP BY 1")
def scan_csv(s, d):
    p = scratch(s)
    sinks.csv(T.table(s, d, "netflow").select(*T.FLOW_FIELDS), p)
    return readers.csv(s, p, readers.FLOW_SCHEMA).groupBy("DstPort").agg(F.count("*").alias("n"), F.sum("SrcBytes").alias("bytes"))


@query("SELECT Protocol, count(*) AS n, min(epoch_ms(CASE WHEN time >= 100000000000 THEN time WHEN time >= 1 THEN time * 1000 END)) AS first_ts FROM netflow GROUP BY 1")
def scan_flows_csv(s, d):
    p = scratch(s)
    sinks.csv(T.table(s, d, "netflow").select(*T.FLOW_FIELDS), p, header=False)
    return readers.flows_csv(s, p).groupBy("Protocol").agg(F.count("*").alias("n"), F.min("ts").cast("timestamp_ntz").alias("first_ts"))


@query("SELECT EventID, count(*) AS n, count(UserName) AS n_users FROM windows_event_logs GROUP BY 1")
def scan_json_lines(s, d):
    p = scratch(s)
    sinks.json_lines(T.table(s, d, "windows_event_logs").select(*T.LOG_FIELDS), p)
    return readers.logs_json(s, p).groupBy("EventID").agg(F.count("*").alias("n"), F.count("UserName").alias("n_users"))


@query("""SELECT CAST(strftime(make_timestamp(t * 1000000), '%Y%m%d') AS BIGINT) AS day, count(*) AS n FROM (SELECT CASE WHEN "Time" > 100000000000 THEN "Time" // 1000 ELSE "Time" END AS t FROM windows_event_logs) WHERE t IS NOT NULL AND CAST(strftime(make_timestamp(t * 1000000), '%Y%m%d') AS BIGINT) BETWEEN 20260210 AND 20260220 GROUP BY 1""")
def scan_day_range(s, d):
    p = scratch(s)
    rows = T.read_records(T.table(s, d, "windows_event_logs")).where("time_s IS NOT NULL").withColumn("day", C.yyyymmdd(C.day_of_s("time_s")))
    rows.select("event_id", "log_host", "day").write.partitionBy("day").parquet(p)
    return readers.by_days(s, p, "20260210", "20260220", "event_id int, log_host string, day bigint").groupBy(F.col("day").cast("bigint").alias("day")).agg(F.count("*").alias("n"))


@query(WE + "SELECT event_id, k FROM e")
def json_extract(s, d):
    return T.table(s, d, "events").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k")


@query(WE + "SELECT event_id, k AS props_k, event_type AS kind_name FROM e")
def json_flatten(s, d):
    nested = T.table(s, d, "events").select("event_id", F.from_json("props", "k int").alias("props"), F.struct(F.col("event_type").alias("name")).alias("kind"))
    return predicates.flatten(nested)


@query("SELECT event_id AS id, user_id AS principal, CAST(ts AS TIMESTAMP) AS _time, CAST(dayofyear(ts) AS INTEGER) AS day FROM events")
def project_rename(s, d):
    flat = T.table(s, d, "events").select(F.col("event_id").alias("properties.id"), F.col("user_id").alias("properties.user"), F.col("ts").cast("timestamp").alias("time"))
    out = readers.sign_in_columns(flat, names={"user": "principal"})
    return out.withColumn("_time", F.col("_time").cast("timestamp_ntz"))


@query("SELECT CAST(EventID AS VARCHAR) AS EventID, description, category AS snapshot FROM event_types")
def snapshot_scan(s, d):
    """Event types as columnar plugin files, one folder per category, and back."""
    p = scratch(s)
    t = T.table(s, d, "event_types").groupBy("category").agg(F.collect_list(F.array(F.col("EventID").cast("string"), F.lit("x"), F.col("description"))).alias("data"))
    text = F.to_json(F.struct(F.lit("types").alias("plugin"), F.array(F.lit("EventID"), F.lit("Skipped"), F.lit("description")).alias("titles"), "data", F.size("data").cast("bigint").alias("count")))
    t.select(text.alias("value"), "category").write.partitionBy("category").option("compression", "none").text(p)
    raw = s.read.schema(readers.SNAPSHOT_SCHEMA).option("recursiveFileLookup", True).json(p).select("*", F.col("_metadata.file_path").alias("file"))
    return readers.snapshot_rows(raw, ["EventID", "description"]).select("EventID", "description", F.regexp_extract("snapshot", "category=(.*)", 1).alias("snapshot"))


@query()
def replay_source(s, d):
    return readers.replay(T.table(s, d, "netflow").select(*T.FLOW_FIELDS).withColumn("key", F.xxhash64(*T.FLOW_FIELDS)), 4, 10_000, "key").select("batch", "i", "row_id", "SrcDevice", "SrcBytes")


@query("SELECT n_nationkey AS nation, count(*) AS n FROM (SELECT c_nationkey AS n_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def union_all(s, d):
    a, b = T.table(s, d, "customer").select(F.col("c_nationkey").alias("nation")), T.table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    return a.unionByName(b).groupBy("nation").agg(F.count("*").alias("n"))


@query("SELECT doc_id, w AS item, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split_regex(lower(regexp_replace(text, '[^a-zA-Z ]', '', 'g')), ' +')) AS w FROM documents) WHERE length(w) > 3 GROUP BY 1, 2")
def sketch_store(s, d):
    p = scratch(s)
    store = sinks.SketchStore(s, p)
    bag = written(token_counts(s, d, "doc_id"))
    store.append(bag.select(F.col("who").cast("string").alias("entity"), "item", (F.col("n") - 1).alias("n")))
    store.append(bag.select(F.col("who").cast("string").alias("entity"), "item", F.lit(1).cast("bigint").alias("n")))
    store.compact()
    return store.read().select(F.col("entity").cast("bigint").alias("doc_id"), "item", "n")


@query("WITH v AS (SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS id FROM (SELECT DISTINCT unnest(string_split(n_name, '')) AS ch FROM nation) WHERE ch <> ''), c AS (SELECT n_nationkey, generate_subscripts(string_split(n_name, ''), 1) - 1 AS pos, unnest(string_split(n_name, '')) AS ch FROM nation) SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(pos AS INTEGER) AS pos, id FROM c JOIN v USING (ch)")
def token_file(s, d):
    n = T.table(s, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")
    v = encode.char_vocabulary(n, "n_name")
    p = scratch(s)
    sinks.token_file(encode.encode_characters(n, "n_nationkey", "n_name", v), v, p)
    return sinks.read_token_file(s, p)[0]


# ---- projections and predicates ----------------------------------------------------------


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")
def select_numeric(s, d):
    df = T.table(s, d, "supplier")
    return df.select(*predicates.numeric_columns(df))


@query("SELECT event_id, user_id, value FROM events WHERE value > 100 AND event_type IN ('purchase', 'error')")
def filter_pred(s, d):
    return T.table(s, d, "events").where((F.col("value") > 100) & F.col("event_type").isin("purchase", "error")).select("event_id", "user_id", "value")


@query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error')")
def filter_notin(s, d):
    return T.table(s, d, "events").where(~F.col("event_type").isin("error")).select("event_id", "event_type")


@query("SELECT doc_id, lang, source FROM documents WHERE lang IS NULL OR source IS NULL")
def filter_null_or(s, d):
    return T.table(s, d, "documents").where(predicates.any_null("lang", "source")).select("doc_id", "lang", "source")


@query(f"WITH {RSQL} SELECT host AS log_host, count(*) FILTER (WHERE usr LIKE '%$' AND usr <> host || '$') AS n_other, count(*) FILTER (WHERE usr = host || '$') AS n_own FROM r WHERE host IS NOT NULL GROUP BY 1")
def suffix_pred(s, d):
    own = F.col("user_name") == F.concat("log_host", F.lit("$"))
    return R(s, d, "log_host", "user_name").where("log_host IS NOT NULL").groupBy("log_host").agg(C.count_if(F.col("user_name").endswith("$") & ~own).alias("n_other"), C.count_if(own).alias("n_own"))


@query(f"WITH {FSQL} SELECT src AS src_device, count(*) FILTER (WHERE DstPort BETWEEN 0 AND 1023) AS system_ports, count(*) FILTER (WHERE DstPort BETWEEN 1024 AND 49151) AS user_ports, count(*) FILTER (WHERE DstPort BETWEEN 49152 AND 65535) AS dynamic_ports FROM f WHERE src IS NOT NULL GROUP BY 1")
def port_bands(s, d):
    p = F.col("DstPort")
    return FL(s, d, "src_device", "DstPort").where("src_device IS NOT NULL").groupBy("src_device").agg(*[C.count_if(p.between(a, b)).alias(n) for n, a, b in (("system_ports", 0, 1023), ("user_ports", 1024, 49151), ("dynamic_ports", 49152, 65535))])


SERVICES = assets.SERVICES


@query(f"WITH {FSQL} SELECT src AS src_device, " + ", ".join(f"count(*) FILTER (WHERE SrcPort IN ({', '.join(map(str, p))}) OR DstPort IN ({', '.join(map(str, p))})) AS n_{n}" for n, p in SERVICES.items()) + " FROM f WHERE src IS NOT NULL GROUP BY 1")
def service_counts(s, d):
    return FL(s, d, "src_device", "SrcPort", "DstPort").where("src_device IS NOT NULL").groupBy("src_device").agg(*[C.count_if(F.col("SrcPort").isin(p) | F.col("DstPort").isin(p)).alias(f"n_{n}") for n, p in SERVICES.items()])


@query("SELECT doc_id, CASE WHEN text LIKE '%phish%' OR text LIKE '%invoice%' THEN 1 END AS mail, CASE WHEN text LIKE '%relay%' OR text LIKE '%breaker%' THEN 1 END AS grid FROM documents")
def substr_flags(s, d):
    return T.table(s, d, "documents").select("doc_id", predicates.contains_any(F.col("text"), ["phish", "invoice"]).alias("mail"), predicates.contains_any(F.col("text"), ["relay", "breaker"]).alias("grid"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS code, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS kind FROM events")
def value_remap(s, d):
    t = F.col("event_type")
    return T.table(s, d, "events").select("event_id", predicates.remap(t, {"error": 1, "purchase": 2}, 0).alias("code"), predicates.remap(t, {"click": "click", "view": "view"}, "other").alias("kind"))


@query("SELECT doc_id, coalesce(lang, 'XX') AS lang, coalesce(source, 'Unknown') AS source, coalesce(n_chars, 0) AS n_chars FROM documents")
def fill_sentinel(s, d):
    return T.table(s, d, "documents").select("doc_id", "lang", "source", "n_chars").na.fill({"lang": "XX", "source": "Unknown", "n_chars": 0})


@query("SELECT time, Duration, SrcBytes FROM netflow WHERE Duration IS NOT NULL AND NOT isnan(Duration) AND NOT isinf(Duration) AND SrcBytes IS NOT NULL")
def drop_naninf(s, d):
    return predicates.drop_non_finite(T.table(s, d, "netflow").select("time", "Duration", "SrcBytes"), ["Duration", "SrcBytes"])


@query("WITH v AS (SELECT LogHost, CASE WHEN isnan(uname_other_compacnt_login_frac) OR isinf(uname_other_compacnt_login_frac) THEN NULL ELSE uname_other_compacnt_login_frac END AS a, CAST(UserName_cnt AS DOUBLE) AS b FROM host_aggregates) SELECT LogHost, round(coalesce(a, (SELECT median(a) FROM v)), 6) AS frac, round(coalesce(b, (SELECT median(b) FROM v)), 6) AS users FROM v")
def median_impute(s, d):
    df = T.table(s, d, "host_aggregates").select("LogHost", F.col("uname_other_compacnt_login_frac").alias("frac"), F.col("UserName_cnt").alias("users"))
    return predicates.impute_median(df, ["frac", "users"]).select("LogHost", F.round("frac", 6).alias("frac"), F.round("users", 6).alias("users"))


@query("WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY 1) SELECT user_id, round(CASE WHEN purchases <> 0 THEN errors / purchases WHEN errors > 0 THEN -1.0 END, 6) AS ratio FROM c")
def safe_ratio(s, d):
    c = T.table(s, d, "events").groupBy("user_id").agg(C.count_if(F.col("event_type") == "error").alias("errors"), C.count_if(F.col("event_type") == "purchase").alias("purchases"))
    return c.select("user_id", F.round(predicates.safe_ratio(F.col("errors"), F.col("purchases")), 6).alias("ratio"))


@query("SELECT doc_id, lang, source, log_host FROM documents WHERE doc_id IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND log_host IS NOT NULL")
def dropna(s, d):
    return T.table(s, d, "documents").select("doc_id", "lang", "source", "log_host").dropna("any")


@query("SELECT event_id, user_id FROM events")
def drop_null_cols(s, d):
    df = T.table(s, d, "events").select("event_id", "user_id", F.lit(None).cast("string").alias("empty"))
    return df.select(*predicates.non_null_columns(df))


@query(WE + " ".join(["SELECT column_name, count(DISTINCT c) AS n_frequencies FROM ("] + ["SELECT 'user_id' AS column_name, count(*) AS c FROM e GROUP BY user_id UNION ALL SELECT 'event_type', count(*) FROM e GROUP BY event_type UNION ALL SELECT 'k', count(*) FROM e GROUP BY k UNION ALL SELECT 'event_id', count(*) FROM e GROUP BY event_id"] + [") GROUP BY 1"]))
def low_diversity_cols(s, d):
    return predicates.frequency_diversity(E(s, d), ["user_id", "event_type", "k", "event_id"])


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 5) AS r FROM lineitem" for a, b in _PAIRS))
def corr_pairs(s, d):
    return predicates.correlations(T.table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).withColumn("r", F.round("r", 5))


@query("SELECT column_name, n_missing, round(100.0 * n_missing / (SELECT count(*) FROM netflow), 1) AS pct_missing FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM netflow" for c in T.FLOW_FIELDS) + ") WHERE n_missing > 0")
def missing_profile(s, d):
    return predicates.missing_profile(T.table(s, d, "netflow"), T.FLOW_FIELDS)


@query("SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(min(value), 4) AS lo, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75, round(max(value), 4) AS hi FROM events GROUP BY 1")
def describe(s, d):
    out = statistics.describe(T.table(s, d, "events"), "event_type", "value")
    return out.select("event_type", "n", *[F.round(c, 4).alias(c) for c in out.columns[2:]])


@query("SELECT 'customer' AS origin, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def union_tagged(s, d):
    a = T.table(s, d, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(T.table(s, d, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@query("SELECT event_id, CASE WHEN value >= 250 THEN 1 ELSE 0 END AS label FROM events")
def threshold_label(s, d):
    return T.table(s, d, "events").select("event_id", F.when(F.col("value") >= 250, 1).otherwise(0).alias("label"))


@query("WITH known AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' OR c_custkey IS NULL THEN 'Yes' ELSE 'No' END AS flagged FROM orders LEFT JOIN known ON o_custkey = c_custkey")
def flag_rule(s, d):
    known = T.table(s, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("known"))
    j = T.table(s, d, "orders").join(known, "o_custkey", "left")
    return j.select("o_orderkey", F.when((F.col("o_orderpriority") == "1-URGENT") | F.col("known").isNull(), "Yes").otherwise("No").alias("flagged"))


# ---- joins -------------------------------------------------------------------------------


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def host_left_counts(s, d):
    n = T.table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return T.table(s, d, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0, ["n"])


@query("SELECT user_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, count(*) AS n FROM events WHERE day(ts) <= 15 GROUP BY 1 UNION ALL SELECT user_id, count(*) FROM events WHERE day(ts) > 15 AND value > 200 GROUP BY 1) GROUP BY 1")
def full_outer_add(s, d):
    e = T.table(s, d, "events")
    half = [e.where(c).groupBy("user_id").agg(F.count("*").alias("n")) for c in (F.dayofmonth("ts") <= 15, (F.dayofmonth("ts") > 15) & (F.col("value") > 200))]
    return joins.full_outer_add(half[0], half[1], "user_id", "n")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def inner_join(s, d):
    return T.table(s, d, "orders").where("o_totalprice > 100000").join(T.table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("WITH c AS (SELECT event_type, count(*) FILTER (WHERE user_id < 50) AS a, count(*) FILTER (WHERE user_id >= 50) AS b FROM events GROUP BY 1), p AS (SELECT event_type, coalesce(a * 100.0 / nullif(sum(a) OVER (), 0), 0) AS x, coalesce(b * 100.0 / nullif(sum(b) OVER (), 0), 0) AS y FROM c) SELECT event_type, round(x, 4) AS pct_a, round(y, 4) AS pct_b, round(abs(x - y), 4) AS diff FROM p")
def freq_diff(s, d):
    out = joins.frequency_difference(T.table(s, d, "events"), "event_type", F.col("user_id") < 50)
    return out.select("event_type", *[F.round(c, 4).alias(c) for c in ("pct_a", "pct_b", "diff")])


@query(f"WITH {FSQL}, p AS (SELECT PortNumber, min(Description) AS Description FROM port_names GROUP BY 1) SELECT coalesce(Description, 'Unknown') AS service, count(*) AS n, count(DISTINCT DstPort) AS n_ports FROM f LEFT JOIN p ON DstPort = PortNumber GROUP BY 1")
def lookup_join(s, d):
    names = T.table(s, d, "port_names").groupBy(F.col("PortNumber").alias("DstPort")).agg(F.min("Description").alias("service"))
    return FL(s, d, "DstPort").join(names, "DstPort", "left").groupBy(F.coalesce("service", F.lit("Unknown")).alias("service")).agg(F.count("*").alias("n"), F.count_distinct("DstPort").alias("n_ports"))


@query(WE + ", p AS (SELECT user_id, k, arg_min(value, event_id) AS pred FROM e WHERE event_type = 'error' GROUP BY 1, 2) SELECT event_id, pred FROM e LEFT JOIN p USING (user_id, k)")
def edge_pred_join(s, d):
    e = E(s, d)
    preds = e.where("event_type = 'error'").select("user_id", "k", "event_id", F.col("value").alias("pred"))
    return joins.edge_predictions(e.select("event_id", "user_id", "k"), preds.withColumnRenamed("event_id", "pos"), "user_id", "k", "pos", "pred").select("event_id", "pred")


@query("WITH dev AS (SELECT c_custkey AS id, c_mktsegment AS seg, unnest([c_custkey % 97, c_custkey % 89, c_custkey % 83]) AS user_id FROM customer), one AS (SELECT user_id, arg_min(seg, id) AS segment FROM dev GROUP BY 1) SELECT event_id, segment FROM events LEFT JOIN one USING (user_id)")
def multi_key_enrich(s, d):
    c = F.col("c_custkey")
    refs = T.table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.array(c % 97, c % 89, c % 83).alias("alts"))
    return joins.first_match(T.table(s, d, "events").select("event_id", "user_id"), refs, "user_id", F.col("alts"), ["id"], ["segment"]).select("event_id", "segment")


@query(f"WITH {RSQL} SELECT x AS entity FROM (SELECT host AS x FROM r UNION SELECT src FROM r) WHERE x IS NOT NULL EXCEPT SELECT nullif(lower(trim(LogHost)), '') FROM host_aggregates WHERE UserName_cnt > 5")
def entity_universe(s, d):
    r = T.read_records(T.table(s, d, "windows_event_logs"))
    known = T.table(s, d, "host_aggregates").where("UserName_cnt > 5").select(C.name("LogHost").alias("entity"))
    return joins.universe(r.select("log_host"), r.select("source")).join(known, "entity", "left_anti")


@query(f"WITH {FSQL}, b AS (SELECT src AS node, dst AS other FROM f UNION SELECT dst, src FROM f) SELECT node, other FROM b WHERE node IS NOT NULL AND other IS NOT NULL AND node <> other")
def neighbors(s, d):
    return joins.neighbour_pairs(T.read_flows(T.table(s, d, "netflow")), "src_device", "dst_device")


_DIST = "list_sum(list_transform(list_zip(v.embedding, r.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))"


@query(f"WITH refs AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1), x AS (SELECT vec_id, CAST(r.label AS VARCHAR) AS label, {_DIST} AS dist FROM embeddings v, refs r) SELECT vec_id, CASE WHEN min(dist) <= 1.5 THEN arg_min(label, dist) ELSE 'others' END AS nearest, round(min(dist), 4) AS distance FROM x GROUP BY 1")
def nearest_ref(s, d):
    v = T.table(s, d, "embeddings")
    refs = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return joins.nearest_reference(v, refs, "embedding", "label", 1.5, "others", "vec_id").withColumn("distance", F.round("distance", 4))


@query()
def triplet_samples(s, d):
    return joins.triplets(T.table(s, d, "embeddings"), "vec_id", "label")


# ---- aggregations ------------------------------------------------------------------------


@query(f"WITH {RSQL} SELECT host AS entity, " + ", ".join(f"count(*) FILTER (WHERE ev = {v}) AS {k}" for k, v in hosts.HOST_EVENTS.items()) + " FROM r WHERE host IS NOT NULL GROUP BY 1")
def host_event_counts(s, d):
    return hosts.event_counts(R(s, d, "log_host", "event_id"), "log_host", hosts.HOST_EVENTS)


@query(f"WITH {RSQL} SELECT src AS entity, " + ", ".join(f"count(*) FILTER (WHERE ev = {v}) AS {k}" for k, v in hosts.SOURCE_EVENTS.items()) + " FROM r WHERE src IS NOT NULL GROUP BY 1")
def source_event_counts(s, d):
    return hosts.event_counts(R(s, d, "source", "event_id"), "source", hosts.SOURCE_EVENTS)


_TYPES = ", ".join([f"count(*) FILTER (WHERE ev IN (4624, 4625) AND lt = {t}) AS logon_type_{t}" for t in hosts.LOGON_TYPES] + [f"count(*) FILTER (WHERE ev IN (4624, 4625) AND lt = {t} AND src IS NOT NULL) AS logon_type_frm_{t}" for t in hosts.LOGON_TYPES])


@query(f"WITH {RSQL} SELECT host AS entity, {_TYPES} FROM r WHERE host IS NOT NULL GROUP BY 1")
def pivot_counts(s, d):
    return hosts.logon_types(R(s, d, "log_host", "source", "event_id", "logon_type"))


_DISTINCT = 'count(DISTINCT usr) AS "UserName_cnt", count(DISTINCT dom) AS "DomainName_cnt", count(DISTINCT src) AS "Source_cnt"'


@query(f"WITH {RSQL} SELECT * FROM (SELECT host AS entity, {_DISTINCT} FROM r WHERE host IS NOT NULL GROUP BY 1) WHERE UserName_cnt + DomainName_cnt + Source_cnt > 0")
def host_distinct(s, d):
    return hosts.distinct_values(T.read_records(T.table(s, d, "windows_event_logs")))


_HOST_COLS = ["UserName_cnt", "DomainName_cnt", "Source_cnt", *hosts.HOST_EVENTS, *hosts.SOURCE_EVENTS, "logon_explicit_cred_to_cnt", *[f"logon_type_{t}" for t in hosts.LOGON_TYPES], *[f"logon_type_frm_{t}" for t in hosts.LOGON_TYPES], "uname_other_compacnt_login_cnt", "uname_that_compacnt_login_cnt"]


@query(f"""WITH {RSQL}, u AS (SELECT host AS h FROM r WHERE host IS NOT NULL UNION SELECT src FROM r WHERE src IS NOT NULL),
 a AS (SELECT host AS h, {_DISTINCT}, {', '.join(f'count(*) FILTER (WHERE ev = {v}) AS {k}' for k, v in hosts.HOST_EVENTS.items())}, {_TYPES}, count(*) FILTER (WHERE ev = 4624 AND usr LIKE '%$' AND usr <> host || '$') AS uname_other_compacnt_login_cnt, count(*) FILTER (WHERE ev = 4624 AND usr = host || '$') AS uname_that_compacnt_login_cnt FROM r WHERE host IS NOT NULL GROUP BY 1),
 b AS (SELECT src AS h, {', '.join(f'count(*) FILTER (WHERE ev = {v}) AS {k}' for k, v in hosts.SOURCE_EVENTS.items())} FROM r WHERE src IS NOT NULL GROUP BY 1),
 c AS (SELECT dst AS h, count(*) FILTER (WHERE ev = 4648) AS logon_explicit_cred_to_cnt FROM r WHERE dst IS NOT NULL GROUP BY 1),
 w AS (SELECT u.h, {', '.join(f'coalesce({k}, 0) AS {k}' for k in _HOST_COLS)} FROM u LEFT JOIN a USING (h) LEFT JOIN b USING (h) LEFT JOIN c USING (h))
 SELECT h AS "LogHost", {', '.join(f'{k} AS "{k}"' for k in _HOST_COLS)}, {', '.join(f'CASE WHEN total_logins_cnt <> 0 THEN CAST(uname_{x}_compacnt_login_cnt AS DOUBLE) / total_logins_cnt WHEN uname_{x}_compacnt_login_cnt > 0 THEN CAST(-1 AS DOUBLE) END AS uname_{x}_compacnt_login_frac' for x in ('other', 'that'))} FROM w""")
def host_features(s, d):
    return hosts.host_features(R(s, d, "event_id", "logon_type", "log_host", "source", "destination", "user_name"), T.read_records(T.table(s, d, "windows_event_logs")))


@query(WE + "SELECT user_id, event_type, CAST(dayofyear(ts) AS INTEGER) AS day, count(DISTINCT k) AS n_k, max(value) AS max_value, count(*) FILTER (WHERE bucket = 'low') AS bucket_low, count(*) FILTER (WHERE bucket = 'high') AS bucket_high FROM (SELECT *, CASE WHEN value < 100 THEN 'low' ELSE 'high' END AS bucket FROM e) GROUP BY 1, 2, 3")
def auth_session_agg(s, d):
    e = E(s, d).withColumns({"day": F.dayofyear("ts"), "bucket": F.when(F.col("value") < 100, "low").otherwise("high")})
    return hosts.session_aggregate(e, ["user_id", "event_type", "day"], ["k"], ["value"], {"bucket": ["low", "high"]})


@query("SELECT day, user_id, s AS top_value, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY s DESC, user_id) AS r FROM (SELECT CAST(ts AS DATE) AS day, user_id, max(value) AS s FROM events GROUP BY 1, 2)) WHERE r <= 5")
def topk_per_day(s, d):
    top = T.table(s, d, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.max("value").alias("top_value"))
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("top_value"), "user_id"))).where("rank <= 5")


@query("SELECT day, avg(y) AS precision FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY s DESC, user_id) AS r FROM (SELECT CAST(ts AS DATE) AS day, user_id, max(value) AS s, max(CAST(event_type = 'error' AS INTEGER)) AS y FROM events GROUP BY 1, 2)) WHERE r <= 5 GROUP BY 1")
def precision_topk(s, d):
    e = T.table(s, d, "events").select(F.to_date("ts").alias("day"), "user_id", "value", (F.col("event_type") == "error").alias("bad"))
    return evaluation.precision_at_k(e, "day", "user_id", "value", "bad", 5)


@query("WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), t AS (SELECT *, sum(c) OVER (PARTITION BY user_id) AS n FROM c) SELECT user_id, CAST(max(n) AS BIGINT) AS n, round(CASE WHEN max(n) > 1 THEN -sum(c / n * ln(c / n)) / ln(max(n)) END, 6) AS entropy FROM t GROUP BY 1")
def entropy_encode(s, d):
    return statistics.conditional_entropy(T.table(s, d, "events"), "user_id", "event_type").withColumn("entropy", F.round("entropy", 6))


def _ent(a: str, b: str) -> str:
    return f"(WITH c AS (SELECT {a} AS a, {b} AS b, count(*) AS c FROM f WHERE {a} IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, sum(c) OVER (PARTITION BY a) AS n FROM c) SELECT a, CASE WHEN max(n) > 1 THEN -sum(c / n * ln(c / n)) / ln(max(n)) END AS ent FROM t GROUP BY 1)"


_EC = {"src_device": "src", "dst_device": "dst", "DstPort": "DstPort"}
_EP = [(a, b) for a in _EC for b in _EC if a != b]


@query(f"WITH {FSQL} SELECT src AS src_device, count(*) AS n, " + ", ".join(f"round(avg(x{i}.ent), 5) AS ent_{a}_{b}" for i, (a, b) in enumerate(_EP)) + " FROM f " + " ".join(f"LEFT JOIN {_ent(_EC[a], _EC[b])} x{i} ON x{i}.a = f.{_EC[a]}" for i, (a, b) in enumerate(_EP)) + " WHERE src IS NOT NULL GROUP BY 1")
def pairwise_entropies(s, d):
    out = statistics.mean_entropies(FL(s, d, *_EC), list(_EC), "src_device")
    return out.select("src_device", "n", *[F.round(f"ent_{a}_{b}", 5).alias(f"ent_{a}_{b}") for a, b in _EP])


@query(WE + ", c AS (SELECT k, count(*) AS n FROM e WHERE k IS NOT NULL GROUP BY 1) SELECT k, n, round((n - min(n) OVER ()) / nullif(CAST(max(n) OVER () - min(n) OVER () AS DOUBLE), 0), 6) AS encoded FROM c")
def freq_encode(s, d):
    return statistics.frequency_encode(E(s, d), "k").withColumn("encoded", F.round("encoded", 6))


@query("SELECT event_id, " + ", ".join(f"CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END AS type_{t}" for t in ("click", "error", "purchase", "view")) + " FROM events")
def one_hot(s, d):
    return T.table(s, d, "events").select("event_id", *encode.one_hot("event_type", ["click", "error", "purchase", "view"], "type"))


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 4) AS pct FROM events GROUP BY 1")
def value_counts(s, d):
    e = T.table(s, d, "events")
    n = e.groupBy("event_type").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("event_type", "n", F.round(F.col("n") * 100.0 / F.col("t"), 4).alias("pct"))  # one row


_CF = ["UserName_cnt", "total_logins_cnt", "logon_type_2", "logon_type_5"]
_CP = "SELECT '{f}' AS feature, lower(trim(substr(trim(LogHost), 1, 2))) AS cluster, CAST({f} AS DOUBLE) AS v FROM host_aggregates"


@query("WITH l AS (" + " UNION ALL ".join(_CP.format(f=f) for f in _CF) + "), o AS (SELECT cluster, feature, count(*) AS size, count(*) FILTER (WHERE coalesce(v, 0) <> 0) AS nz, sum(v) AS s, median(v) AS med FROM l GROUP BY 1, 2), t AS (SELECT feature, count(*) AS n, count(*) FILTER (WHERE coalesce(v, 0) <> 0) AS nza, sum(v) AS sa, median(v) AS meda FROM l GROUP BY 1) SELECT cluster, feature, size, round(s / nullif(nz, 0), 4) AS mean, round(sa / nullif(nza, 0), 4) AS mean_total, round(coalesce((s / nullif(nz, 0)) / nullif(sa / nullif(nza, 0), 0) - 1, 0), 4) AS mean_dev, round(med, 4) AS median, round(meda, 4) AS median_total, round(med / nullif(meda, 0) - 1, 4) AS median_dev, round(100.0 * nz / size, 4) AS nz_frac, round(100.0 * nza / n, 4) AS nz_frac_total, round(100.0 * (nza - nz) / nullif(n - size, 0), 4) AS nz_frac_rem FROM o JOIN t USING (feature)")
def cluster_profile(s, d):
    h = T.table(s, d, "host_aggregates").select(F.substring(C.name("LogHost"), 1, 2).alias("g"), *_CF)
    out = hosts.cluster_profile(h, "g", _CF)
    return out.select("cluster", "feature", "size", *[F.round(c, 4).alias(c) for c in out.columns[3:]])


@query("WITH l AS (" + " UNION ALL ".join(_CP.format(f=f) for f in _CF) + "), o AS (SELECT cluster, feature, count(*) AS size, count(*) FILTER (WHERE coalesce(v, 0) <> 0) AS nz, sum(v) AS s FROM l GROUP BY 1, 2), t AS (SELECT feature, count(*) FILTER (WHERE coalesce(v, 0) <> 0) AS nza, sum(v) AS sa FROM l GROUP BY 1), p AS (SELECT cluster, feature, 100.0 * nz / size AS f, coalesce((s / nullif(nz, 0)) / nullif(sa / nullif(nza, 0), 0) - 1, 0) AS dev FROM o JOIN t USING (feature)) SELECT cluster, CAST(rank AS INTEGER) AS rank, feature, round(dev, 4) AS mean_dev FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY abs(dev) DESC, feature) AS rank FROM p WHERE f > 5) WHERE rank <= 2")
def cluster_top_features(s, d):
    h = T.table(s, d, "host_aggregates").select(F.substring(C.name("LogHost"), 1, 2).alias("g"), *_CF)
    return hosts.top_deviations(hosts.cluster_profile(h, "g", _CF), 2).withColumn("mean_dev", F.round("mean_dev", 4))


@query("WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT CAST(least(floor((value - lo) * 10 / (hi - lo)), 9) AS INTEGER) AS bin, count(*) AS n FROM events, b GROUP BY 1")
def histogram(s, d):
    return statistics.histogram(T.table(s, d, "events"), "value", 10)


@query("SELECT event_type, count(value) AS n, min(value) AS lo, max(value) AS hi, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd FROM events GROUP BY 1")
def group_describe(s, d):
    return statistics.group_stats(T.table(s, d, "events"), "event_type", "value").withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


@query(f"WITH {FSQL}, c AS (SELECT src, DstPort, count(*) AS n FROM f WHERE src IS NOT NULL AND DstPort IS NOT NULL GROUP BY 1, 2) SELECT src AS src_device, DstPort AS mode, n FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, DstPort) AS i FROM c) WHERE i = 1")
def port_mode(s, d):
    return statistics.modes(FL(s, d, "src_device", "DstPort").where("src_device IS NOT NULL"), "src_device", "DstPort")


_PROTO = {"tcp": 6, "udp": 17, "icmp": 1}


@query(f"WITH {FSQL} SELECT src AS src_device, count(*) AS n_flows, " + ", ".join(f"nullif(count(*) FILTER (WHERE Protocol = {v}), 0) AS n_{k}" for k, v in _PROTO.items()) + ", nullif(count(*) FILTER (WHERE Protocol NOT IN (1, 2, 6, 17)), 0) AS n_other, nullif(count(*) FILTER (WHERE DstPort BETWEEN 0 AND 1023), 0) AS n_system, round(avg(SrcBytes), 3) AS mean_bytes, max(SrcBytes) AS max_bytes, round(avg(SrcPackets), 3) AS mean_packets, max(SrcPackets) AS max_packets FROM f WHERE src IS NOT NULL GROUP BY 1")
def flow_profile(s, d):
    p = F.col("Protocol")
    zero = lambda c: F.nullif(C.count_if(c), F.lit(0))
    return FL(s, d, "src_device", "Protocol", "DstPort", "SrcBytes", "SrcPackets").where("src_device IS NOT NULL").groupBy("src_device").agg(F.count("*").alias("n_flows"), *[zero(p == v).alias(f"n_{k}") for k, v in _PROTO.items()], zero(~p.isin(1, 2, 6, 17)).alias("n_other"), zero(F.col("DstPort").between(0, 1023)).alias("n_system"), *[g for c, n in (("SrcBytes", "bytes"), ("SrcPackets", "packets")) for g in (F.round(F.avg(c), 3).alias(f"mean_{n}"), F.max(c).alias(f"max_{n}"))])


_DEV = """CASE WHEN n LIKE 'ws-%' OR n LIKE 'lap-%' THEN 'Computers' WHEN n LIKE 'sw-%' OR n LIKE 'fw-%' THEN 'Network Equipment' END AS category, CASE WHEN n LIKE 'srv-%' OR n LIKE 'dc-%' THEN 'Servers' WHEN n LIKE 'ws-%' THEN 'Personal Computers' WHEN n LIKE 'sw-%' THEN 'Switches' END AS mtype, CASE length(n) % 4 WHEN 0 THEN 'Ubuntu' WHEN 1 THEN 'Windows 10' WHEN 2 THEN 'Debian Linux' ELSE 'VMware ESXi' END AS os, CASE length(n) % 3 WHEN 0 THEN 'Dell Inc' WHEN 1 THEN 'Intel Corp' END AS manufacturer"""
_ASSET = {"n_flows": "count(*)", **{f"n_{k}": f"nullif(count(*) FILTER (WHERE Protocol = {v}), 0)" for k, v in assets.PROTOCOLS.items()}, "n_other": "nullif(count(*) FILTER (WHERE Protocol NOT IN (1, 2, 6, 17)), 0)", **{f"{k}_ports": f"nullif(count(*) FILTER (WHERE SrcPort IN ({', '.join(map(str, v))}) OR DstPort IN ({', '.join(map(str, v))})), 0)" for k, v in SERVICES.items()}, "mean_bytes": "round(avg(SrcBytes), 3)", "max_bytes": "max(SrcBytes)", "mean_packets": "round(avg(SrcPackets), 3)", "max_packets": "max(SrcPackets)"}
_TOP = " ".join(f"LEFT JOIN (SELECT src, count(*) AS n_{k}_ports, arg_max(SrcPort, (n, -SrcPort)) AS top_{k}_port FROM sp WHERE SrcPort BETWEEN {lo} AND {hi} GROUP BY 1) b_{k} ON b_{k}.src = a.src_device" for k, (lo, hi) in assets.BANDS.items())
_APP = ", ".join(f"max(CASE WHEN {' OR '.join(f"contains(text, '{x}')" for x in xs)} THEN 1 END) AS {k}_app" for k, xs in assets.PARTS["app"].items())


@query(f"""WITH {FSQL}, a AS (SELECT src AS src_device, {', '.join(f'{v} AS {k}' for k, v in _ASSET.items())} FROM f WHERE src IS NOT NULL GROUP BY 1), sp AS (SELECT src, SrcPort, count(*) AS n FROM f WHERE src IS NOT NULL GROUP BY 1, 2),
 inv AS (SELECT *, {_DEV} FROM (SELECT DISTINCT unnest(string_split(replace(lower(LogHost || ', x-' || LogHost), ' ', ''), ',')) AS n FROM host_aggregates) WHERE n <> ''), e AS (SELECT n, {', '.join(assets.flag_sql(c, {c: c}) for c in ('category', 'mtype', 'os', 'manufacturer'))} FROM inv), t AS (SELECT nullif(lower(trim(log_host)), '') AS n, {_APP} FROM documents GROUP BY 1)
 SELECT a.*, {', '.join(f'n_{k}_ports, top_{k}_port' for k in assets.BANDS)}, e.* EXCLUDE (n), t.* EXCLUDE (n) FROM a {_TOP} LEFT JOIN e ON e.n = src_device LEFT JOIN t ON t.n = src_device""")
def asset_profile(s, d):
    """The wide profile of each source device: traffic, ports, services, and flags of inventory and texts."""
    n = F.col("n")
    is_a = lambda *ps: reduce(or_, [n.startswith(p) for p in ps])
    inv = T.table(s, d, "host_aggregates").select(F.explode(X.listed(F.concat("LogHost", F.lit(", x-"), "LogHost"))).alias("n")).distinct()
    inv = inv.select("n", F.when(is_a("ws-", "lap-"), "Computers").when(is_a("sw-", "fw-"), "Network Equipment").alias("category"), F.when(is_a("srv-", "dc-"), "Servers").when(is_a("ws-"), "Personal Computers").when(is_a("sw-"), "Switches").alias("mtype"), F.element_at(F.array(F.lit("Ubuntu"), F.lit("Windows 10"), F.lit("Debian Linux"), F.lit("VMware ESXi")), F.length("n") % 4 + 1).alias("os"), F.element_at(F.array(F.lit("Dell Inc"), F.lit("Intel Corp"), F.lit(None).cast("string")), F.length("n") % 3 + 1).alias("manufacturer"))
    texts = T.table(s, d, "documents").select(C.name("log_host").alias("host"), "text")
    flows = FL(s, d, "src_device", "Protocol", "SrcPort", "DstPort", "SrcBytes", "SrcPackets")
    out = assets.profile(flows, assets.inventory_flags(inv, F.array("n"), ["n"]), assets.text_flags(texts, "host", "text"))
    return out.withColumns({c: F.round(c, 3) for c in ("mean_bytes", "mean_packets")})


@query("SELECT c_mktsegment AS segment, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1, 2")
def crosstab(s, d):
    return statistics.crosstab(T.table(s, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")), "segment", "nation")


@query(WE + ", t AS (SELECT event_type AS a, k % 5 AS b, count(*) AS n FROM e GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS c, sum(n) OVER () AS t FROM t) SELECT CAST(max(t) AS BIGINT) AS n, count(DISTINCT a) AS n_a, count(DISTINCT b) AS n_b, round(sqrt((sum(n * n / (r * c)) - 1) / (least(count(DISTINCT a), count(DISTINCT b)) - 1)), 5) AS v FROM m")
def cramers_v(s, d):
    return statistics.cramers_v(E(s, d).withColumn("m", F.col("k") % 5), "event_type", "m").withColumn("v", F.round("v", 5))


@query("SELECT 'is_error' AS a, 'value' AS b, round(corr(CAST(event_type = 'error' AS INTEGER), value), 5) AS r FROM events")
def point_biserial(s, d):
    e = T.table(s, d, "events").select((F.col("event_type") == "error").cast("int").alias("is_error"), "value")
    return predicates.correlations(e, ["is_error", "value"]).withColumn("r", F.round("r", 5))


def token_counts(s, d, who: str) -> DataFrame:
    words = F.explode(X.letter_tokens(F.col("text"))).alias("item")
    return T.table(s, d, "documents").select(F.col(who).alias("who"), words).groupBy("who", "item").agg(F.count("*").alias("n"))


_BAG = "SELECT source AS who, w AS item, count(*) AS n FROM (SELECT source, unnest(string_split_regex(lower(regexp_replace(text, '[^a-zA-Z ]', '', 'g')), ' +')) AS w FROM documents) WHERE length(w) > 3 GROUP BY 1, 2"


@query(_BAG)
def token_bag(s, d):
    return token_counts(s, d, "source")


@query(f"WITH b AS ({_BAG}), n AS (SELECT who, sqrt(sum(n * n)) AS norm FROM b WHERE who IS NOT NULL GROUP BY 1), t AS (SELECT item, sum(n) AS n FROM b WHERE who IS NOT NULL GROUP BY 1), tn AS (SELECT sqrt(sum(n * n)) AS norm FROM t) SELECT b.who, round(sum(b.n * t.n) / (max(n.norm) * max(tn.norm)), 5) AS similarity FROM b JOIN t USING (item) JOIN n ON n.who = b.who, tn GROUP BY 1")
def bag_cosine(s, d):
    """Similarity of each sender's bag to the bag of all."""
    b = written(token_counts(s, d, "source").where("who IS NOT NULL"))
    t = b.groupBy("item").agg(F.sum("n").alias("m"))
    total = t.agg(F.sqrt(F.sum(F.col("m").cast("double") * F.col("m"))).alias("tn"))
    dot = b.join(t, "item").groupBy("who").agg(F.sum(F.col("n").cast("double") * F.col("m")).alias("x"), F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("nn"))
    return dot.crossJoin(F.broadcast(total)).select("who", F.round(F.coalesce(F.try_divide("x", F.col("nn") * F.col("tn")), F.lit(0.0)), 5).alias("similarity"))  # one row


_HIST = "WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END AS code FROM events)"


def _sent(s, d) -> DataFrame:
    return T.table(s, d, "events").withColumn("code", predicates.remap(F.col("event_type"), {"click": 1, "view": 2, "purchase": 3}, 4)).withColumn("at", F.col("ts").cast("timestamp"))


@query(_HIST + ", c AS (SELECT event_id, user_id, i, CAST(round(value * 100) AS BIGINT) AS x FROM o), m AS (SELECT event_id, count(x) OVER w AS n, coalesce(CAST(sum(x) OVER w AS BIGINT), 0) AS sx, coalesce(CAST(sum(x * x) OVER w AS BIGINT), 0) AS sxx FROM c WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, n, CASE WHEN n > 0 THEN CAST(sx AS DOUBLE) / n END AS mu, CASE WHEN n > 1 THEN CAST(n * sxx - sx * sx AS DOUBLE) / (n * (n - 1)) END AS variance FROM m")
def sender_syntax_stats(s, d):
    """Mean and variance of the earlier values, from exact sums of hundredths."""
    e = _sent(s, d).withColumn("x", F.round(F.col("value") * 100).cast("bigint"))
    x = F.col("x")
    out = statistics.history(e, "user_id", ["ts", "event_id"], {"n": ("count", x), "sx": ("sum", x), "sxx": ("sum", x * x)}).na.fill(0, ["sx", "sxx"])
    n, sx = F.col("n"), F.col("sx")
    return out.select("event_id", "n", F.when(n > 0, sx.cast("double") / n).alias("mu"), F.when(n > 1, (n * F.col("sxx") - sx * sx).cast("double") / (n * (n - 1))).alias("variance"))


@query(_HIST + " SELECT event_id, CASE WHEN code < coalesce(min(code) OVER w, 1000) THEN 1 ELSE 0 END AS is_new FROM o WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def new_intent(s, d):
    out = statistics.history(_sent(s, d), "user_id", ["ts", "event_id"], {"least": ("min", F.col("code"))})
    return out.select("event_id", F.when(F.col("code") < F.coalesce("least", F.lit(1000)), 1).otherwise(0).alias("is_new"))


_HOW = "CAST(CAST(floor(round(epoch(ts)) / 3600) AS BIGINT) % 168 AS INTEGER)"


@query(f"WITH h AS (SELECT event_id, user_id, ts, {_HOW} AS how FROM events) SELECT event_id, how, CASE WHEN count(*) OVER w < 20 THEN -1.0 ELSE round(count(*) OVER v / (count(*) OVER w), 6) END AS likelihood FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY user_id, how ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def hour_of_week(s, d):
    e = _sent(s, d).withColumn("how", X.hour_of_week(F.col("at")))
    e = statistics.history(e, "user_id", ["ts", "event_id"], {"n": ("count", F.lit(1))})
    e = statistics.history(e.withColumn("at_hour", F.struct("user_id", "how")), "at_hour", ["ts", "event_id"], {"c": ("count", F.lit(1))})
    return e.select("event_id", "how", F.when(F.col("n") < 20, F.lit(-1.0)).otherwise(F.round(C.div("c", "n"), 6)).alias("likelihood"))


@query(_HIST + " SELECT event_id, round(CASE WHEN count(value) OVER w > 2 THEN (avg(value) OVER w - value) / nullif(var_samp(value) OVER w, 0) END, 6) AS drift FROM o WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def sender_history(s, d):
    x = F.col("value")
    out = statistics.history(_sent(s, d), "user_id", ["ts", "event_id"], {"n": ("count", x), "s": ("sum", x), "ss": ("sum", x * x)})
    mean, var = statistics.moments("n", "s", "ss")
    return out.select("event_id", F.round(F.when(F.col("n") > 2, F.try_divide(mean - x, var)), 6).alias("drift"))


_TOKS = "t AS (SELECT doc_id, nullif(lower(trim(log_host)), '') AS host, created_ts, unnest(string_split_regex(lower(regexp_replace(text, '[^a-zA-Z ]', '', 'g')), ' +')) AS w FROM documents), b AS (SELECT doc_id, host, created_ts, w, count(*) AS n FROM t WHERE host IS NOT NULL AND length(w) > 3 GROUP BY ALL), p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY host, w ORDER BY created_ts, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM b), d AS (SELECT doc_id, sum(n * prior) AS dot, sum(n * n) AS own FROM p GROUP BY 1), e AS (SELECT x.doc_id, nullif(lower(trim(log_host)), '') AS host, created_ts, coalesce(dot, 0) AS dot, coalesce(own, 0) AS own FROM documents x LEFT JOIN d USING (doc_id) WHERE nullif(lower(trim(log_host)), '') IS NOT NULL)"


@query(f"WITH {_TOKS}, l AS (SELECT *, count(*) OVER w AS n_before, sum(2 * dot + own) OVER w AS len FROM e WINDOW w AS (PARTITION BY host ORDER BY created_ts, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), s AS (SELECT *, CASE WHEN n_before > 0 THEN CASE WHEN len > 0 AND own > 0 THEN CAST(dot AS DOUBLE) / (sqrt(CAST(len AS DOUBLE)) * sqrt(CAST(own AS DOUBLE))) ELSE 0.0 END END AS sim FROM l) SELECT doc_id, host AS log_host, n_before, round(sim, 6) AS similarity, round(CASE WHEN count(sim) OVER w > 1 AND var_samp(sim) OVER w > 1e-6 THEN (avg(sim) OVER w - sim) / var_samp(sim) OVER w ELSE -1.0 END, 2) AS drift FROM s WINDOW w AS (PARTITION BY host ORDER BY created_ts, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def sender_sketches(s, d):
    """Each text against the bag of all earlier texts of its host."""
    docs = T.table(s, d, "documents").select("doc_id", C.name("log_host").alias("log_host"), "created_ts", "text")
    out = statistics.sketch_similarity(docs, "log_host", ["created_ts", "doc_id"], "doc_id", X.letter_tokens(F.col("text")), 1e-6)
    return out.select("doc_id", "log_host", "n_before", F.round("similarity", 6).alias("similarity"), F.round("drift", 2).alias("drift"))


@query("WITH m AS (SELECT source, median(n_chars) AS m FROM documents GROUP BY 1) SELECT source, doc_id FROM (SELECT d.source, doc_id, row_number() OVER (PARTITION BY d.source ORDER BY abs(n_chars - m), doc_id) AS i FROM documents d JOIN m ON m.source IS NOT DISTINCT FROM d.source) WHERE i = 1")
def group_representative(s, d):
    docs = T.table(s, d, "documents").select("source", "doc_id", "n_chars")
    m = docs.groupBy("source").agg(F.median("n_chars").alias("m")).withColumnRenamed("source", "g")
    j = docs.join(m, F.col("source").eqNullSafe(F.col("g")))
    return j.groupBy("source").agg(F.min_by("doc_id", F.struct(F.abs(F.col("n_chars") - F.col("m")), "doc_id")).alias("doc_id"))


@query("SELECT event_type, count(*) FILTER (WHERE value > 100) / count(*) AS rate FROM events GROUP BY 1")
def detect_rate(s, d):
    return T.table(s, d, "events").groupBy("event_type").agg((C.count_if(F.col("value") > 100) / F.count("*")).alias("rate"))


# ---- sequences, samples, sets ------------------------------------------------------------

_RN = "r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, count(*) OVER () AS n FROM events)"


@query(f"WITH {_RN}, w AS (SELECT unnest(range(0, (SELECT max(n) FROM r) - 10 + 1, 5)) AS s) SELECT s AS win_start, max(CAST(event_type = 'error' AS INTEGER)) AS label, string_agg(event_type, ',' ORDER BY rn) AS items FROM w JOIN r ON rn BETWEEN s AND s + 9 GROUP BY 1")
def seq_windows(s, d):
    e = T.table(s, d, "events").select("ts", "event_id", "event_type")
    out = sequences.count_windows(e, ["ts", "event_id"], 10, 5, F.col("event_type"), (F.col("event_type") == "error").cast("int"))
    return out.select("win_start", "label", F.array_join("items", ",").alias("items"))


@query(f"WITH {_RN} SELECT event_id, rn // 64 AS batch FROM r")
def row_batches(s, d):
    return sequences.batches(T.table(s, d, "events").select("ts", "event_id"), ["ts", "event_id"], 64).select("event_id", "batch")


_BI = f"WITH {_RN}, b AS (SELECT rn, event_type AS first, lead(event_type) OVER (ORDER BY rn) AS second FROM r)"


@query(_BI + " SELECT first, second, count(*) AS n FROM b WHERE second IS NOT NULL GROUP BY 1, 2")
def bigrams(s, d):
    return sequences.bigrams(T.table(s, d, "events").select("ts", "event_id", "event_type"), ["ts", "event_id"], "event_type").groupBy("first", "second").agg(F.count("*").alias("n"))


@query(_BI + " SELECT first, string_agg(DISTINCT second, ',' ORDER BY second) AS followers FROM b WHERE second IS NOT NULL GROUP BY 1")
def bigram_map(s, d):
    b = sequences.bigrams(T.table(s, d, "events").select("ts", "event_id", "event_type"), ["ts", "event_id"], "event_type")
    return b.groupBy("first").agg(F.array_join(F.sort_array(F.collect_set("second")), ",").alias("followers"))


@query("SELECT user_id, CAST(row_number() OVER (ORDER BY t, i) - 1 AS BIGINT) AS id FROM (SELECT user_id, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS i FROM events GROUP BY 1)")
def first_seen_ids(s, d):
    return sequences.first_seen_ids(T.table(s, d, "events"), ["ts", "event_id"], "user_id")


@query(f"WITH {RSQL} SELECT host AS log_host, min(t) AS first_s, max(t) AS last_s, count(*) AS n FROM r WHERE host IS NOT NULL GROUP BY 1")
def slice_per_key(s, d):
    return R(s, d, "log_host", "time_s").where("log_host IS NOT NULL").groupBy("log_host").agg(F.min("time_s").alias("first_s"), F.max("time_s").alias("last_s"), F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN day(ts) <= 20 THEN 'train' WHEN day(ts) >= 26 THEN 'test' ELSE 'validation' END AS part FROM events")
def time_split(s, d):
    return T.table(s, d, "events").select("event_id", sampling.time_split(F.dayofmonth("ts"), 20, 26).alias("part"))


@query(f"WITH {_RN} SELECT event_id, rn * 5 // n AS fold FROM r")
def kfold(s, d):
    e = T.table(s, d, "events").select("ts", "event_id")
    n = e.count()
    return sequences.numbered(e, ["ts", "event_id"]).select("event_id", F.floor(F.col("rn") * 5 / F.lit(max(n, 1))).alias("fold"))


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_multi(s, d):
    return T.table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice", "o_orderdate").limit(100)


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def limit_tail(s, d):
    return T.table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).select("event_id").limit(10)


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) WHERE i <= 3")
def stratified_sample(s, d):
    return sampling.stratified(T.table(s, d, "documents").select("source", "doc_id"), "source", 3, ["doc_id"])


@query("WITH c AS (SELECT count(*) FILTER (WHERE event_type = 'error') AS p, count(*) FILTER (WHERE event_type <> 'error') AS q FROM events) SELECT 'positive' AS kind, p AS n FROM c UNION ALL SELECT 'negative', least(q, CAST(floor(p / 0.5) AS BIGINT)) FROM c")
def under_sample(s, d):
    got = sampling.under_sample(T.table(s, d, "events"), F.col("event_type") == "error", 0.5, "event_id")
    return got.groupBy(F.when(F.col("event_type") == "error", "positive").otherwise("negative").alias("kind")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id, event_type, CASE WHEN i <= floor(least(n, 10000) * 0.8) THEN 'train' ELSE 'test' END AS part FROM r")
def class_split(s, d):
    return sampling.class_split(T.table(s, d, "events").select("event_id", "event_type"), "event_type", 10_000, 0.8, "event_id")


@query(WE + "SELECT event_id FROM e WHERE event_type = 'error' UNION ALL SELECT min(event_id) FROM e WHERE event_type <> 'error' GROUP BY user_id, event_type, k")
def dedup_negatives(s, d):
    return sampling.dedup_negatives(E(s, d).select("event_id", "user_id", "event_type", "k"), F.col("event_type") == "error", ["user_id", "event_type", "k"], "event_id").select("event_id")


@query(WE + "SELECT DISTINCT event_type, k FROM e")
def distinct_vals(s, d):
    return E(s, d).select("event_type", "k").distinct()


@query("SELECT event_id FROM events")
def random_shuffle(s, d):
    return T.table(s, d, "events").select("event_id").orderBy(F.xxhash64("event_id", F.lit(4)), "event_id")


@query()
def fraction_sample(s, d):
    return T.table(s, d, "events").where(sampling.fraction("event_id", 0.1, 4)).select("event_id")


@query(WE + "SELECT DISTINCT user_id AS id FROM e WHERE event_type = 'error' INTERSECT SELECT DISTINCT k FROM e")
def set_intersect(s, d):
    e = E(s, d)
    return e.where("event_type = 'error'").select(F.col("user_id").alias("id")).intersect(e.select(F.col("k").cast("bigint").alias("id")))


@query("SELECT DISTINCT user_id AS id FROM events EXCEPT SELECT user_id FROM events WHERE value > 400")
def set_except(s, d):
    e = T.table(s, d, "events")
    return e.select(F.col("user_id").alias("id")).distinct().join(e.where("value > 400").select(F.col("user_id").alias("id")), "id", "left_anti")
