"""Queries for text and URL features, vectors, densities, graphs, encoders, models and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import clean as C
from emberline.functions import text as X
from emberline.functions import url as U
from emberline.functions import vectors as V
from emberline.operators import density, encode, evaluation, graph, models, sequences, statistics
from emberline.plans.durable import written
from emberline.plans.relational import E, FL, FSQL, WE
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


# ---- URLs --------------------------------------------------------------------------------

_URL = r"(?:https?|hxxps?)://[A-Za-z0-9./?=&_#%:-]+"
_SPLIT = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_SUF = ", ".join(f"'{x}'" for x in U.SUFFIXES)
_FAM = ", ".join(f"'{x}'" for x in U.FAMILIES)
USQL = f"""u0 AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_URL}')) AS url FROM documents),
 u1 AS (SELECT doc_id, url, CASE WHEN starts_with(url, 'http') THEN url ELSE 'http://' || url END AS full_url FROM u0),
 u2 AS (SELECT *, trim(regexp_replace(lower(regexp_extract(full_url, '{_SPLIT}', 2)), ':[0-9]*$', ''), '.') AS host, regexp_extract(full_url, '{_SPLIT}', 3) AS path, regexp_extract(full_url, '{_SPLIT}', 4) AS query, regexp_extract(full_url, '{_SPLIT}', 5) AS fragment FROM u1),
 u3 AS (SELECT *, string_split(host, '.') AS labels, len(string_split(host, '.')) AS nl, regexp_matches(host, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') OR len(string_split(host, '.')) < 2 AS whole FROM u2),
 u35 AS (SELECT *, CASE WHEN nl > 2 AND array_to_string(labels[nl - 1 : nl], '.') IN ({_SUF}) THEN 2 ELSE 1 END AS n0 FROM u3),
 u4 AS (SELECT *, n0 + CASE WHEN nl > n0 + 1 AND labels[nl - n0] IN ({_FAM}) THEN 1 ELSE 0 END AS ns FROM u35),
 u AS (SELECT doc_id, url, host, path, query, fragment, CASE WHEN whole THEN host ELSE labels[nl - ns] END AS domain, CASE WHEN whole THEN '' ELSE array_to_string(labels[nl - ns + 1 : nl], '.') END AS suffix, CASE WHEN whole OR nl - ns - 1 <= 0 THEN '' ELSE array_to_string(labels[1 : nl - ns - 1], '.') END AS subdomain FROM u4)"""


def urls(s: SparkSession, d: str) -> DataFrame:
    return T.table(s, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_URL), F.lit(0))).alias("url"))


@query(f"WITH {USQL} SELECT doc_id, url, subdomain, domain, suffix FROM u")
def url_domain(s, d):
    h = U.split_host(U.parts(U.with_scheme(F.col("url")))["host"])
    return urls(s, d).select("doc_id", "url", h.alias("h")).select("doc_id", "url", "h.*")


_RANKED = f"r AS (SELECT domain, suffix, row_number() OVER (ORDER BY count(*) DESC, domain, suffix) AS rank FROM u GROUP BY 1, 2), ur AS (SELECT u.*, CASE WHEN rank <= {U.TOP} THEN 2 WHEN rank <= {U.KNOWN} THEN 1 ELSE 0 END AS domain_in_alexa FROM u LEFT JOIN r USING (domain, suffix))"
_BR = "|".join(U.BRANDS)
_FEATS = f"""domain_in_alexa, CAST(length(domain) AS INTEGER) AS domain_len, CAST(length(regexp_replace(domain, '[^0-9]', '', 'g')) AS INTEGER) AS domain_numbers, CAST(regexp_matches(domain, '^[0-9A-Za-z]+$') AS INTEGER) AS domain_isalnum, CAST(length(subdomain) AS INTEGER) AS subdomain_len, CAST(length(regexp_replace(subdomain, '[^0-9]', '', 'g')) AS INTEGER) AS subdomain_numbers_count, CAST(len(string_split(subdomain, '.')) AS INTEGER) AS subdomain_parts_count, CAST(length(suffix) AS INTEGER) AS tld_len, CAST(len(string_split(suffix, '.')) AS INTEGER) AS tld_parts_count,
 CASE WHEN query = '' THEN 0 ELSE CAST(len(string_split(query, '&')) AS INTEGER) END AS queries_amount, CAST(fragment <> '' AS INTEGER) AS fragments_amount, CAST(length(path) AS INTEGER) AS path_len, CAST(length(path) - length(replace(path, '/', '')) AS INTEGER) AS path_slash_counts, CAST((length(path) - length(replace(path, '//', ''))) // 2 AS INTEGER) AS path_double_slash_counts, CAST(regexp_matches(subdomain, '{_BR}') AS INTEGER) AS brand_in_subdomain, CAST(regexp_matches(path, '{_BR}') AS INTEGER) AS brand_in_path,
 CAST(list_max(list_transform(string_split(trim(regexp_replace(lower(path), '[^0-9a-z]+', ' ', 'g')), ' '), lambda w: length(w))) AS INTEGER) AS path_max_len"""


def _ranked(s: SparkSession, d: str) -> DataFrame:
    """The URLs with the rank of their registered domain, by how often it occurs, from 1 to U.KNOWN."""
    u = urls(s, d).select("doc_id", "url", U.parts(U.with_scheme(F.col("url"))).alias("p")).withColumn("h", U.split_host(F.col("p.host"))).withColumns({"domain": F.col("h.domain"), "suffix": F.col("h.suffix")})
    n = u.groupBy("domain", "suffix").agg(F.count("*").alias("n"))
    top = sequences.numbered(n, [F.desc("n"), F.col("domain"), F.col("suffix")], "rank").where(F.col("rank") < U.KNOWN).select("domain", "suffix", (F.col("rank") + 1).alias("rank"))
    return u.join(top, ["domain", "suffix"], "left")


@query(f"WITH {USQL}, {_RANKED} SELECT doc_id, url, {_FEATS} FROM ur")
def url_features(s, d):
    return _ranked(s, d).select("doc_id", "url", *U.features(F.col("p"), F.col("h"), U.popularity(F.col("rank"))))


@query(f"WITH {USQL}, {_RANKED}, f AS (SELECT doc_id, url, {_FEATS} FROM ur) SELECT doc_id, url, " + ", ".join(f"round((CAST({n} AS DOUBLE) - {lo}) / {hi - lo}, 6) AS {n}" for n, (lo, hi) in U.BOUNDS.items()) + " FROM f")
def url_norm(s, d):
    f = _ranked(s, d).select("doc_id", "url", *U.features(F.col("p"), F.col("h"), U.popularity(F.col("rank"))))
    return f.select("doc_id", "url", *[F.round(U.normalised(n), 6).alias(n) for n in U.BOUNDS])


@query(f"WITH {USQL}, {_RANKED} SELECT doc_id, url, domain_in_alexa AS domain_in_top FROM ur")
def domain_rank(s, d):
    return _ranked(s, d).select("doc_id", "url", U.popularity(F.col("rank")).alias("domain_in_top"))


@query(f"WITH {USQL}, b AS (SELECT doc_id, url, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) WHEN starts_with(url, 'http://') THEN substr(url, 8) ELSE url END AS a FROM u), c AS (SELECT doc_id, url, trim(regexp_replace(lower(CASE WHEN starts_with(a, 'www.') THEN substr(a, 5) ELSE a END), '[^0-9a-z]+', ' ', 'g')) AS t FROM b) SELECT doc_id, url, array_to_string(list_filter(string_split(t, ' '), lambda w: NOT regexp_matches(w, '^[0-9]+$') AND length(w) BETWEEN 2 AND 20), ' ') AS tokens FROM c")
def url_tokens(s, d):
    return urls(s, d).select("doc_id", "url", F.array_join(X.clean_tokens(U.without_prefix(F.col("url"))), " ").alias("tokens"))


# Words of the vocabulary and of a padded URL.
WORDS, WIDTH = 2_000, 500


@query(f"WITH {USQL}, c AS (SELECT doc_id, url, string_split(trim(regexp_replace(lower(url), '[^0-9a-z]+', ' ', 'g')), ' ') AS ws FROM u), v AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM c) GROUP BY 1 ORDER BY n DESC, w LIMIT {WORDS}), l AS (SELECT list(w ORDER BY n DESC, w) AS words FROM v) SELECT doc_id, url, array_to_string(list_resize(list_transform(ws, lambda x: coalesce(list_position(words, x), 0)), {WIDTH}, 0), ',') AS ids FROM c, l")
def word_tokens(s, d):
    """Ids of each URL's words in the vocabulary of the most frequent ones, padded."""
    u = urls(s, d).select("doc_id", "url", F.split(X.clean_alnum(F.col("url")), " ").alias("ws")).withColumn("key", F.struct("doc_id", "url"))
    n = u.select(F.explode("ws").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = sequences.numbered(n, [F.desc("n"), F.col("word")], "id").where(F.col("id") < WORDS).select("word", (F.col("id") + 1).cast("int").alias("id"))
    each = u.select("key", "doc_id", "url", "ws").distinct().select("key", F.posexplode("ws").alias("pos", "word")).join(words, "word", "left")
    ids = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(0)).alias("id")))).alias("a"))  # the words of one URL
    padded = X.padded(F.transform("a", lambda x: x["id"]), WIDTH)
    return u.join(ids, "key").select("doc_id", "url", F.array_join(F.transform(padded, lambda x: x.cast("string")), ",").alias("ids"))


# Fixed value: the characters of a domain name, numbered from 1.
_CHARS = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}


@query(f"WITH {USQL} SELECT doc_id, url, array_to_string(list_resize(list_transform(list_filter(string_split(domain, ''), lambda c: c <> ''), lambda c: strpos('abcdefghijklmnopqrstuvwxyz0123456789', c)), 75, 0), ',') AS ids, array_to_string(string_split(domain, ''), ' ') AS spaced FROM u")
def char_tokens(s, d):
    dom = U.split_host(U.parts(U.with_scheme(F.col("url")))["host"])["domain"]
    u = urls(s, d).select("doc_id", "url", dom.alias("domain"))
    ids = X.vocabulary_ids(X.characters(F.col("domain")), _CHARS, 75)
    return u.select("doc_id", "url", F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"), X.spaced(F.col("domain")).alias("spaced"))


@query(f"WITH {USQL} SELECT doc_id, url, array_to_string(list_resize(list_transform(string_split(substr(host, 1, 100), ''), lambda c: CASE WHEN c = '^' OR c = '' THEN 0 ELSE ord(c) END), 100, 0), ',') AS ids FROM u")
def domain_codepoints(s, d):
    u = urls(s, d).withColumn("host", U.parts(U.with_scheme(F.col("url")))["host"])
    return u.select("doc_id", "url", F.array_join(F.transform(X.code_points(F.col("host"), 100), lambda x: x.cast("string")), ",").alias("ids"))


# ---- text --------------------------------------------------------------------------------

_SH = "CASE WHEN length(p_name) > 4 THEN list_distinct(list_transform(range(1, greatest(length(p_name) - 2, 2)), lambda i: substr(p_name, i, 4))) ELSE list_filter(list_distinct(string_split(p_name, '')), lambda x: x <> '') END"


@query(f"SELECT p_partkey, CAST(len({_SH}) AS INTEGER) AS n, array_to_string(list_sort({_SH}), '|') AS shingles FROM part")
def shingles(s, d):
    p = T.table(s, d, "part").select("p_partkey", X.shingles(F.col("p_name"), 4).alias("x"))
    return p.select("p_partkey", F.size("x").alias("n"), F.array_join(F.array_sort("x"), "|").alias("shingles"))


@query(f"WITH a AS (SELECT p_partkey, {_SH} AS x FROM part), r AS (SELECT arg_min({_SH}, p_partkey) AS y FROM part) SELECT p_partkey, round(1 - len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 6) AS distance FROM a, r")
def jaccard(s, d):
    """Distance of each name's shingle set to that of the part with the lowest key."""
    a = T.table(s, d, "part").select("p_partkey", X.shingles(F.col("p_name"), 4).alias("x"))
    r = a.agg(F.min_by("x", "p_partkey").alias("y"))
    return a.crossJoin(F.broadcast(r)).select("p_partkey", F.round(V.jaccard(F.col("x"), F.col("y")), 6).alias("distance"))  # one row


@query("SELECT o_custkey, CAST(levenshtein(a, b) AS INTEGER) AS distance FROM (SELECT o_custkey, min(o_orderpriority) AS a, max(o_orderpriority) AS b FROM orders GROUP BY 1)")
def levenshtein(s, d):
    o = T.table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderpriority").alias("a"), F.max("o_orderpriority").alias("b"))
    return o.select("o_custkey", F.levenshtein("a", "b").alias("distance"))


@query("SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS digest FROM documents")
def clean_text(s, d):
    return T.table(s, d, "documents").select("doc_id", F.md5(X.collapse(F.col("text"))).alias("digest"))


@query("SELECT source, sha256(source) AS sender, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def sender_hash(s, d):
    return T.table(s, d, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n")).select("source", F.sha2("source", 256).alias("sender"), "n")


@query("SELECT o_orderkey, CAST(round(o_totalprice, 2) AS DOUBLE) AS amount FROM orders")
def money_parse(s, d):
    text = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    return T.table(s, d, "orders").select("o_orderkey", X.money(text).alias("amount"))


@query(WE + "SELECT event_id, CAST(user_id AS VARCHAR) || '_' || event_type AS pid_process, user_id * (SELECT max(k) + 1 FROM e) + k AS card FROM e")
def composite_key(s, d):
    e = E(s, d)
    m = e.agg((F.max("k") + 1).alias("m"))
    return e.crossJoin(F.broadcast(m)).select("event_id", F.concat_ws("_", F.col("user_id").cast("string"), "event_type").alias("pid_process"), (F.col("user_id") * F.col("m") + F.col("k")).alias("card"))  # one row


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS dd, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minute_of_day, CAST(dayofyear(ts) AS INTEGER) AS day_of_year, round((epoch(TIMESTAMP '2024-10-30') - floor(epoch(ts))) / (365.25 * 86400), 6) AS age FROM events")
def date_parts(s, d):
    ts = F.col("ts").cast("timestamp")
    ref = F.unix_timestamp(F.lit("2024-10-30 00:00:00").cast("timestamp"))
    return T.table(s, d, "events").select("event_id", F.year(ts).alias("y"), F.month(ts).alias("m"), F.dayofmonth(ts).alias("dd"), (F.hour(ts) * 60 + F.minute(ts)).alias("minute_of_day"), F.dayofyear(ts).alias("day_of_year"), F.round((ref - F.unix_timestamp(ts)) / (365.25 * 86400), 6).alias("age"))


# ---- vectors and scalings ----------------------------------------------------------------

_HA = "pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)"


@query(f"WITH p AS (SELECT o_orderkey, CAST(o_custkey % 180 - 90 AS DOUBLE) AS lat1, CAST(o_custkey % 360 - 180 AS DOUBLE) AS lon1, CAST(o_orderkey % 180 - 90 AS DOUBLE) AS lat2, CAST(o_orderkey % 360 - 180 AS DOUBLE) AS lon2 FROM orders), a AS (SELECT o_orderkey, {_HA} AS a FROM p) SELECT o_orderkey, round(2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)), 3) AS km FROM a")
def haversine(s, d):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    km = V.haversine_km((c % 180 - 90).cast("double"), (c % 360 - 180).cast("double"), (o % 180 - 90).cast("double"), (o % 360 - 180).cast("double"))
    return T.table(s, d, "orders").select("o_orderkey", F.round(km, 3).alias("km"))


_Z = "list_transform(list_zip(v.embedding, r.embedding), lambda z: {})"
_P, _QQ = "CAST(z[1] AS DOUBLE)", "CAST(z[2] AS DOUBLE)"


@query(f"WITH r AS (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1), x AS (SELECT vec_id, list_sum({_Z.format(f'abs({_P} - {_QQ})')}) AS l1, sqrt(list_sum({_Z.format(f'({_P} - {_QQ}) * ({_P} - {_QQ})')})) AS l2, list_sum({_Z.format(f'{_P} * {_QQ}')}) / (sqrt(list_sum({_Z.format(f'{_P} * {_P}')})) * sqrt(list_sum({_Z.format(f'{_QQ} * {_QQ}')}))) AS c FROM embeddings v JOIN r USING (label)) SELECT vec_id, round(l1, 4) AS l1, round(l2, 4) AS l2, round(c, 4) AS cosine FROM x")
def vec_distance(s, d):
    v = T.table(s, d, "embeddings")
    r = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    a, b = F.col("embedding"), F.col("ref")
    return v.join(r, "label").select("vec_id", F.round(V.l1(a, b), 4).alias("l1"), F.round(V.l2(a, b), 4).alias("l2"), F.round(V.cosine(a, b), 4).alias("cosine"))


@query("WITH t AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events) SELECT event_id, round((value - mu) / (1e-4 + sd), 5) AS z, round((value - lo) / (hi - lo), 5) AS minmax, round((value - b) / (c - a), 5) AS robust FROM events, t")
def scalings(s, d):
    out = statistics.scaled(T.table(s, d, "events"), "value", "event_id")
    return out.select("event_id", *[F.round(c, 5).alias(c) for c in ("z", "minmax", "robust")])


@query("SELECT event_id, round(1 / (1 + exp(-(value - 50) / 100)), 6) AS p FROM events")
def sigmoid(s, d):
    return T.table(s, d, "events").select("event_id", F.round(V.sigmoid((F.col("value") - 50) / 100), 6).alias("p"))


@query(WE + "SELECT event_id, round(10 / 255.0, 6) AS a, round((user_id % 256) / 255.0, 6) AS b, round((k % 256) / 255.0, 6) AS c FROM e")
def ip_octets(s, d):
    ip = F.concat_ws(".", F.lit("10"), (F.col("user_id") % 256).cast("string"), (F.col("k") % 256).cast("string"), F.lit("x"), F.lit("9"))
    return E(s, d).select("event_id", V.ip_octets(ip).alias("o")).select("event_id", *[F.round(F.col("o")[i], 6).alias(n) for i, n in enumerate("abc")])


# ---- densities and projections -----------------------------------------------------------

_KDE = """WITH v AS (SELECT lower(lang) AS lang, CAST(n_chars AS DOUBLE) AS v FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL), s AS (SELECT lang, count(*) AS n, min(v) AS lo, max(v) AS hi, pow(4 * pow(stddev_samp(v), 5) / (3 * count(*)), 0.2) AS h FROM v GROUP BY 1), g AS (SELECT lang, n, lo, hi, h, unnest(range(CASE WHEN hi > lo THEN 50 ELSE 1 END)) AS i FROM s), k AS (SELECT g.lang, CAST(g.i AS INTEGER) AS i, lo + (hi - lo) * g.i / 49 AS x, CASE WHEN max(hi) > max(lo) THEN sum(exp(-pow((lo + (hi - lo) * g.i / 49 - v.v) / h, 2) / 2)) / (max(n) * max(h) * sqrt(2 * pi())) ELSE 1.0 END AS density FROM g JOIN v ON v.lang = g.lang GROUP BY 1, 2, 3)"""


def _lengths(s, d):
    return T.table(s, d, "documents").where("lang IS NOT NULL").select(F.lower("lang").alias("lang"), "n_chars")


@query(_KDE + " SELECT lang, i, round(x, 3) AS x, round(density * 1000, 5) AS density FROM k")
def kde_grid(s, d):
    return density.kde_grid(_lengths(s, d), "lang", "n_chars").select("lang", "i", F.round("x", 3).alias("x"), F.round(F.col("density") * 1000, 5).alias("density"))


@query(_KDE + ", w AS (SELECT *, lag(density) OVER (PARTITION BY lang ORDER BY i) AS p, lead(density) OVER (PARTITION BY lang ORDER BY i) AS q FROM k) SELECT lang, i, CASE WHEN density <= p AND density < q THEN 'min' ELSE 'max' END AS kind FROM w WHERE (density <= p AND density < q) OR (density >= p AND density > q) OR (p IS NULL AND q IS NULL)")
def kde_extrema(s, d):
    return density.extrema(density.kde_grid(_lengths(s, d), "lang", "n_chars"), "lang").select("lang", "i", "kind")


#: Seeded sparse directions over all coordinates of `embeddings`, the same in code and SQL.
_CUTS = density.sparse_cuts(64, 1_000)
_CUT_ROWS = ", ".join(f"({j}, {i + 1}, {_CUTS[j, i]:.17e})" for j, i in zip(*_CUTS.nonzero()))
_LODA = f"""c(cut, i, w) AS (VALUES {_CUT_ROWS}), p AS (SELECT vec_id, cut, sum(w * CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, c GROUP BY 1, 2), n AS (SELECT count(*) AS n, CAST(floor(count(*) / ln(count(*))) AS INTEGER) AS bins FROM embeddings), s AS (SELECT cut, min(v) AS lo, max(v) AS hi FROM p GROUP BY 1), b AS (SELECT vec_id, p.cut, least(floor((v - lo) * bins / (hi - lo)), bins - 1) AS bin FROM p JOIN s USING (cut), n), h AS (SELECT cut, bin, count(*) / max(n) + 1e-12 AS share FROM b, n GROUP BY 1, 2)"""


@query(f"WITH {_LODA} SELECT vec_id, round(sum(-ln(share)) / 1000000, 8) AS score FROM b JOIN h USING (cut, bin) GROUP BY 1")
def loda_score(s, d):
    v = T.table(s, d, "embeddings").select("vec_id", "embedding")
    return density.loda_scores(v, "vec_id", "embedding", _CUTS.tolist()).withColumn("score", F.round("score", 8))


@query(f"WITH {_LODA}, x AS (SELECT vec_id, cut, -ln(share) AS s FROM b JOIN h USING (cut, bin)), f AS (SELECT unnest(range(64)) AS feature), t AS (SELECT vec_id, f.feature, count(*) FILTER (WHERE c.cut IS NOT NULL) AS na, count(*) FILTER (WHERE c.cut IS NULL) AS nb, avg(s) FILTER (WHERE c.cut IS NOT NULL) AS ma, avg(s) FILTER (WHERE c.cut IS NULL) AS mb, var_samp(s) FILTER (WHERE c.cut IS NOT NULL) AS va, var_samp(s) FILTER (WHERE c.cut IS NULL) AS vb FROM x CROSS JOIN f LEFT JOIN c ON c.cut = x.cut AND c.i = f.feature + 1 GROUP BY 1, 2) SELECT vec_id, CAST(feature AS INTEGER) AS feature, round((ma - mb) / sqrt(va / na + vb / nb), 4) AS t FROM t")
def loda_explain(s, d):
    v = T.table(s, d, "embeddings").select("vec_id", "embedding")
    return density.loda_explain(v, "vec_id", "embedding", _CUTS.tolist()).withColumn("t", F.round("t", 4))


@query("WITH p AS (SELECT vec_id, embedding FROM embeddings), l AS (SELECT arg_min(embedding, vec_id) AS l, arg_max(embedding, vec_id) AS r FROM p), d AS (SELECT vec_id, sqrt(list_sum(list_transform(list_zip(embedding, l), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS dl, sqrt(list_sum(list_transform(list_zip(embedding, r), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS dr, sqrt(list_sum(list_transform(list_zip(l, r), lambda z: pow(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))) AS dd FROM p, l) SELECT vec_id, round((dl * dl + dd * dd - dr * dr) / (2 * dd), 4) AS x0 FROM d")
def fastmap_project(s, d):
    v = T.table(s, d, "embeddings").select("vec_id", "embedding")
    p = v.agg(F.min_by("embedding", "vec_id").alias("l"), F.max_by("embedding", "vec_id").alias("r"))
    j = v.crossJoin(F.broadcast(p))  # one row
    e, l, r = F.col("embedding"), F.col("l"), F.col("r")
    return j.select("vec_id", F.round(density.fastmap(V.l2(e, l), V.l2(e, r), V.l2(l, r)), 4).alias("x0"))


@query()
def srg_label(s, d):
    return density.string_groups(T.table(s, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query()
def dbscan_hosts(s, d):
    h = T.table(s, d, "host_aggregates").select(C.name("LogHost").alias("host"), F.col("uname_other_compacnt_login_frac").alias("a"), F.col("uname_that_compacnt_login_frac").alias("b")).where("a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1")
    return density.dbscan(h, "host", ["a", "b"], 0.02, 5)


# ---- encoders ----------------------------------------------------------------------------


@query("WITH t AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS o FROM (SELECT DISTINCT p_brand FROM part)) SELECT p_partkey, " + ", ".join(f"CAST((o >> {i}) & 1 AS INTEGER) AS brand_{5 - i}" for i in range(6)) + " FROM part JOIN t USING (p_brand)")
def binary_encode(s, d):
    p = T.table(s, d, "part").select("p_partkey", "p_brand")
    return encode.binary_encode(p, "p_brand", encode.ordinal_table(p, "p_brand"), 6, "brand").drop("p_brand")


@query("SELECT ch, CAST(row_number() OVER (ORDER BY ch) - 1 AS BIGINT) AS id FROM (SELECT DISTINCT unnest(string_split(p_name, '')) AS ch FROM part) WHERE ch <> ''")
def char_vocab(s, d):
    return encode.char_vocabulary(T.table(s, d, "part"), "p_name")


# ---- evaluation --------------------------------------------------------------------------

_Y = "y AS (SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS y, round(value / 1000, 3) AS score FROM events)"


def _scored(s, d):
    e = T.table(s, d, "events")
    return e.select("event_id", (F.col("event_type") == "error").cast("int").alias("y"), F.round(F.col("value") / 1000, 3).alias("score"))


@query(f"WITH {_Y}, c AS (SELECT count(*) FILTER (WHERE y = 1 AND score > 0.05) AS tp, count(*) FILTER (WHERE y = 0 AND score > 0.05) AS fp, count(*) FILTER (WHERE y = 1 AND score <= 0.05) AS fn, count(*) FILTER (WHERE y = 0 AND score <= 0.05) AS tn FROM y) SELECT tp, fp, fn, tn, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c")
def confusion_metrics(s, d):
    return evaluation.confusion(_scored(s, d).withColumn("p", (F.col("score") > 0.05).cast("int")), "y", "p")


@query("WITH p AS (SELECT o_orderstatus AS y, CASE WHEN o_totalprice > 250000 THEN 'O' WHEN o_totalprice > 100000 THEN 'F' ELSE 'P' END AS p FROM orders), k AS (SELECT y AS c FROM p UNION SELECT p FROM p), b AS (SELECT c, (SELECT count(*) FROM p WHERE y = c) AS s, (SELECT count(*) FROM p WHERE p = c) AS q, (SELECT count(*) FROM p WHERE y = c AND p = c) AS t FROM k), m AS (SELECT *, coalesce(t / nullif(q, 0), 0) AS pr, coalesce(t / nullif(s, 0), 0) AS re, coalesce(2 * t / nullif(s + q, 0), 0) AS f FROM b) SELECT 'micro' AS average, round(sum(t) / sum(q), 6) AS precision, round(sum(t) / sum(s), 6) AS recall, round(sum(t) / sum(s), 6) AS f1 FROM m UNION ALL SELECT 'macro', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6) FROM m UNION ALL SELECT 'weighted', round(sum(pr * s) / sum(s), 6), round(sum(re * s) / sum(s), 6), round(sum(f * s) / sum(s), 6) FROM m")
def multiclass_metrics(s, d):
    o = T.table(s, d, "orders").select(F.col("o_orderstatus").alias("y"), F.when(F.col("o_totalprice") > 250000, "O").when(F.col("o_totalprice") > 100000, "F").otherwise("P").alias("p"))
    out = evaluation.multiclass(o, "y", "p")
    return out.select("average", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_CURVE = f"WITH {_Y}, g AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg FROM y GROUP BY 1), c AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp FROM g WINDOW w AS (ORDER BY score DESC))"


@query(_CURVE + " SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(neg * (tp - pos) + neg * pos / 2.0) / (sum(pos) * sum(neg)), 6) AS auc FROM c")
def roc_auc(s, d):
    return evaluation.roc_auc(evaluation.score_curve(_scored(s, d), "y", "score")).withColumn("auc", F.round("auc", 6))


@query(_CURVE + " SELECT CAST(sum(pos) AS BIGINT) AS n_pos, round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM c")
def avg_precision(s, d):
    return evaluation.average_precision(evaluation.score_curve(_scored(s, d), "y", "score")).withColumn("average_precision", F.round("average_precision", 6))


@query(_CURVE + " SELECT score, pos, neg, tp, fp FROM c")
def cum_curve(s, d):
    return evaluation.score_curve(_scored(s, d), "y", "score")


@query(_CURVE + ", j AS (SELECT score, round(tp / (SELECT sum(pos) FROM c) - fp / (SELECT sum(neg) FROM c), 9) AS j FROM c) SELECT score AS threshold, round(j, 6) AS j FROM j ORDER BY j.j DESC, score DESC LIMIT 1")
def youden(s, d):
    return evaluation.youden(evaluation.score_curve(_scored(s, d), "y", "score")).withColumn("j", F.round("j", 6))


@query(f"WITH {_Y}, t AS (SELECT unnest(range(100)) AS i), c AS (SELECT i, count(*) FILTER (WHERE y = 1 AND round(score * 100, 9) >= i) AS tp, count(*) FILTER (WHERE y = 0 AND round(score * 100, 9) >= i) AS fp, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM t, y GROUP BY 1) SELECT i / 100 AS threshold, tp, fp, p - tp AS fn, round(tp / p, 6) AS recall, round((0.1 * n * tp / p) / nullif(0.1 * n * tp / p + fp, 0), 6) AS precision FROM c")
def threshold_sweep(s, d):
    return evaluation.threshold_sweep(_scored(s, d), "y", "score", 0.1).withColumns({"recall": F.round("recall", 6), "precision": F.round("precision", 6)})


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round((1 / n) / (SELECT sum(1 / n) FROM c), 6) AS weight FROM c")
def class_weights(s, d):
    return evaluation.class_weights(T.table(s, d, "events"), "event_type").withColumn("weight", F.round("weight", 6))


@query("WITH t AS (SELECT label AS a, vec_id % 10 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), x AS (SELECT sum(n) AS n, sum(n * ln(n)) AS xln, sum(n * (n - 1) / 2) AS pairs FROM t), p AS (SELECT sum(r * ln(r)) AS rln, sum(r * (r - 1) / 2) AS pr FROM (SELECT sum(n) AS r FROM t GROUP BY a)), q AS (SELECT sum(c * ln(c)) AS cln, sum(c * (c - 1) / 2) AS pc FROM (SELECT sum(n) AS c FROM t GROUP BY b)) SELECT CAST(n AS BIGINT) AS n, round((xln / n - rln / n - cln / n + ln(n)) / ((2 * ln(n) - rln / n - cln / n) / 2), 6) AS nmi, round((pairs - pr * pc / (n * (n - 1) / 2)) / ((pr + pc) / 2 - pr * pc / (n * (n - 1) / 2)), 6) AS ari FROM x, p, q")
def cluster_agreement(s, d):
    v = T.table(s, d, "embeddings").select("label", (F.col("vec_id") % 10).alias("b"))
    return evaluation.agreement(v, "label", "b").withColumns({"nmi": F.round("nmi", 6), "ari": F.round("ari", 6)})


# ---- graphs ------------------------------------------------------------------------------

_NB = "SELECT src, dst FROM f WHERE src IS NOT NULL AND dst IS NOT NULL"


def _edges(s, d):
    return FL(s, d, "src_device", "dst_device").toDF("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")


@query(f"WITH {FSQL}, x AS (SELECT src AS node, CAST(count(*) AS DOUBLE) AS a, CAST(count(DISTINCT dst) AS DOUBLE) AS b FROM f WHERE src IS NOT NULL GROUP BY 1) SELECT dst, round(avg(a), 4) AS a, round(avg(b), 4) AS b FROM f JOIN x ON x.node = f.src WHERE dst IS NOT NULL GROUP BY 1")
def neighbor_mean(s, d):
    f = written(_flows_named(s, d))
    x = f.where("src IS NOT NULL").groupBy(F.col("src").alias("node")).agg(F.count("*").cast("double").alias("a"), F.count_distinct("dst").cast("double").alias("b"))
    out = statistics.neighbour_mean(f.where("src IS NOT NULL AND dst IS NOT NULL"), x, "src", "dst", "node", ["a", "b"])
    return out.select("dst", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


def _flows_named(s, d):
    return FL(s, d, "src_device", "dst_device").toDF("src", "dst")


@query(f"WITH {FSQL}, n AS (SELECT src, dst, count(*) AS c FROM f WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2) SELECT src, dst, round(c / sum(c) OVER (PARTITION BY src), 6) AS w FROM n")
def adj_norm(s, d):
    return graph.normalised_adjacency(_edges(s, d), "src", "dst").withColumn("w", F.round("w", 6))


@query(f"WITH {FSQL}, e AS (SELECT src, dst FROM f WHERE src <> dst UNION SELECT dst, src FROM f WHERE src <> dst), a AS (SELECT src, dst FROM e UNION SELECT src, src FROM e), g AS (SELECT src, count(*) AS d FROM a GROUP BY 1) SELECT a.src, a.dst, round(1 / (sqrt(x.d) * sqrt(y.d)), 6) AS w FROM a JOIN g x ON x.src = a.src JOIN g y ON y.src = a.dst")
def laplacian(s, d):
    return graph.laplacian(_edges(s, d), "src", "dst").withColumn("w", F.round("w", 6))


_ADJ = "adj AS (SELECT src, dst, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY src) AS w FROM f WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2)"
_NODE = "nodes AS (SELECT DISTINCT n FROM (SELECT src AS n FROM adj UNION ALL SELECT dst FROM adj))"


def _apply(new: str, old: str) -> str:
    return f"{new} AS (SELECT nodes.n, " + ", ".join(f"coalesce(sum(w * {c}), 0) AS {c}" for c in "abcd") + f" FROM nodes LEFT JOIN (SELECT src, w, {', '.join('abcd')} FROM adj JOIN {old} ON {old}.n = adj.dst) j ON j.src = nodes.n GROUP BY nodes.n)"


def _scale(new: str, old: str, d: int) -> str:
    norm = "sqrt(a * a + b * b + c * c + d * d)"
    return f"{new} AS (SELECT n, " + ", ".join(f"{c} / CASE WHEN {norm} = 0 THEN 1 ELSE {norm} END / {d + 1} AS {c}" for c in "abcd") + f" FROM {old})"


def _plus(new: str, x: str, y: str, sign: str) -> str:
    return f"{new} AS (SELECT n, " + ", ".join(f"{x}.{c} {sign} {y}.{c} AS {c}" for c in "abcd") + f" FROM {x} JOIN {y} USING (n))"


@query(f"WITH {FSQL}, {_ADJ}, {_NODE}, raw AS (SELECT n, CAST(length(n) AS DOUBLE) AS a, CAST(ord(substr(n, 1, 1)) AS DOUBLE) AS b, CAST(ord(substr(n, length(n), 1)) AS DOUBLE) AS c, CAST(1 AS DOUBLE) AS d FROM nodes), " + ", ".join([_scale("e0", "raw", 0), _apply("p1", "e0"), _scale("x1", "p1", 1), _apply("p2", "p1"), _apply("r2", "x1"), _plus("y2", "p2", "r2", "-"), _scale("x2", "y2", 2), _apply("p3", "p2"), _plus("s3", "r2", "x2", "+"), _apply("r3", "s3"), _plus("y3", "p3", "r3", "-"), _scale("x3", "y3", 3)]) + " SELECT n AS node, " + ", ".join(f"round(e0.{c} + x1.{c} + x2.{c} + x3.{c}, 4) AS {c}" for c in "abcd") + " FROM e0 JOIN x1 USING (n) JOIN x2 USING (n) JOIN x3 USING (n)")
def khop_embed(s, d):
    adj = written(graph.normalised_adjacency(_edges(s, d), "src", "dst"))
    nodes = adj.select(F.col("src").alias("node")).union(adj.select("dst")).distinct()
    n = F.col("node")
    x = nodes.select("node", F.array(F.length(n).cast("double"), F.ascii(F.substring(n, 1, 1)).cast("double"), F.ascii(F.substring(n, -1, 1)).cast("double"), F.lit(1.0)).alias("x"))
    out = graph.hop_embeddings(adj, x, 4)
    return out.select("node", *[F.round(F.col("embedding")[i], 4).alias(c) for i, c in enumerate("abcd")])


def _tx(s, d):
    return T.table(s, d, "orders").select("o_orderkey", "o_orderdate", (F.col("o_custkey") % 50).alias("merchant"), F.col("o_custkey").alias("user"))


_TX = "t AS (SELECT o_orderkey, o_custkey % 50 AS merchant, o_custkey AS usr, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS BIGINT) AS tx_id FROM orders), m AS (SELECT merchant, CAST(row_number() OVER (ORDER BY merchant) - 1 + (SELECT count(*) FROM t) AS BIGINT) AS merchant_id FROM (SELECT DISTINCT merchant FROM t)), u AS (SELECT usr, CAST(row_number() OVER (ORDER BY usr) - 1 + (SELECT count(*) FROM t) + (SELECT count(*) FROM m) AS BIGINT) AS user_id FROM (SELECT DISTINCT usr FROM t))"


def _graph(s, d):
    return graph.tripartite_ids(_tx(s, d), [F.desc("o_orderdate"), "o_orderkey"], "merchant", "user", "o_orderkey")


@query(f"WITH {_TX} SELECT o_orderkey, tx_id, merchant_id, user_id FROM t JOIN m USING (merchant) JOIN u USING (usr)")
def graph_ids(s, d):
    t, m, u = _graph(s, d)
    return t.join(m, "merchant").join(u, "user").select("o_orderkey", "tx_id", "merchant_id", "user_id")


@query(f"WITH {_TX}, j AS (SELECT tx_id, merchant_id, user_id FROM t JOIN m USING (merchant) JOIN u USING (usr)) SELECT user_id AS src, tx_id AS dst, CAST(0 AS DOUBLE) AS weight FROM j UNION ALL SELECT tx_id, user_id, 0 FROM j UNION ALL SELECT merchant_id, tx_id, 0 FROM j UNION ALL SELECT tx_id, merchant_id, 0 FROM j")
def graph_edges(s, d):
    return graph.tripartite_edges(*_graph(s, d), "merchant", "user")


@query(f"WITH {_TX}, j AS (SELECT t.tx_id, m.merchant_id, u.user_id, o_totalprice AS price, CAST(year(o_orderdate) AS DOUBLE) AS y FROM t JOIN orders USING (o_orderkey) JOIN m USING (merchant) JOIN u USING (usr)) SELECT tx_id AS node, round(price, 2) AS price, y FROM j UNION ALL SELECT merchant_id, 0, arg_min(y, tx_id) FROM j GROUP BY 1 UNION ALL SELECT user_id, round(arg_min(price, tx_id), 2), 0 FROM j GROUP BY 1")
def graph_node_features(s, d):
    """Transactions with their features; a merchant or user spreads the block that belongs to it from its first transaction."""
    t, m, u = _graph(s, d)
    f = T.table(s, d, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("price"), F.year("o_orderdate").cast("double").alias("y"))
    j = written(t.join(f, "o_orderkey").join(m, "merchant").join(u, "user").select("tx_id", "merchant_id", "user_id", "price", "y"))
    a = j.select(F.col("tx_id").alias("node"), "price", "y")
    b = j.groupBy(F.col("merchant_id").alias("node")).agg(F.lit(0.0).alias("price"), F.min_by("y", "tx_id").alias("y"))
    c = j.groupBy(F.col("user_id").alias("node")).agg(F.min_by("price", "tx_id").alias("price"), F.lit(0.0).alias("y"))
    return a.unionByName(b).unionByName(c)


@query(WE + ", x AS (SELECT 'event_id' AS a, 'event_id_user_id' AS t, 'user_id' AS b, CAST(event_id AS VARCHAR) AS s, CAST(user_id AS VARCHAR) AS d FROM e UNION ALL SELECT 'user_id', 'user_id_event_id', 'event_id', CAST(user_id AS VARCHAR), CAST(event_id AS VARCHAR) FROM e UNION ALL SELECT 'event_id', 'event_id_event_type', 'event_type', CAST(event_id AS VARCHAR), event_type FROM e UNION ALL SELECT 'event_type', 'event_type_event_id', 'event_id', event_type, CAST(event_id AS VARCHAR) FROM e UNION ALL SELECT 'event_id', 'event_id_k', 'k', CAST(event_id AS VARCHAR), CAST(k AS VARCHAR) FROM e UNION ALL SELECT 'k', 'k_event_id', 'event_id', CAST(k AS VARCHAR), CAST(event_id AS VARCHAR) FROM e) SELECT a AS src_type, t AS etype, b AS dst_type, s AS src, d AS dst FROM x WHERE s IS NOT NULL AND d IS NOT NULL")
def hetero_edges(s, d):
    return graph.typed_edges(E(s, d), "event_id", ["user_id", "event_type", "k"])


@query(WE + ", r AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn, count(*) OVER () AS n FROM e), g AS (SELECT rn // 100 AS graph_id, rn % 100 AS pos, CAST(user_id AS VARCHAR) AS s, 'k' || CAST(k AS VARCHAR) AS d, value FROM r WHERE rn // 100 < n // 100), i AS (SELECT graph_id, node, CAST(row_number() OVER (PARTITION BY graph_id ORDER BY node) - 1 AS INTEGER) AS id FROM (SELECT DISTINCT graph_id, unnest([s, d]) AS node FROM g)) SELECT g.graph_id, g.pos, a.id AS src_id, b.id AS dst_id, value FROM g JOIN i a ON a.graph_id = g.graph_id AND a.node = s JOIN i b ON b.graph_id = g.graph_id AND b.node = d")
def graph_windows(s, d):
    e = E(s, d).select("ts", "event_id", F.col("user_id").cast("string").alias("s"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("d"), "value")
    return graph.window_graph(e, ["ts", "event_id"], "s", "d", ["value"], 100)


@query()
def fanout_sample(s, d):
    e = _edges(s, d)
    seeds = e.where("src LIKE 'ws-%'").select("src").distinct()
    return graph.fan_out(e, seeds, [4, 3])


@query()
def negative_edges(s, d):
    return graph.negative_edges(_edges(s, d))


# ---- models ------------------------------------------------------------------------------

_HF = ["UserName_cnt", "DomainName_cnt", "Source_cnt", "total_logins_cnt", "accnt_fail_logon_cnt", "total_logoff_cnt", "spl_pvlgs", "logon_type_2", "logon_type_3", "logon_type_5", "logon_type_10"]


@query()
def kmeans_sweep(s, d):
    h = T.table(s, d, "host_aggregates").select(*_HF)
    return s.createDataFrame([(k, float(i), float(q), float(c)) for k, i, q, c in models.sweep(h, _HF, [2, 4, 8])], "k int, inertia double, silhouette double, cosine_silhouette double")


@query()
def pca_hosts(s, d):
    from pyspark.ml.functions import vector_to_array

    h = T.table(s, d, "host_aggregates").select(C.name("LogHost").alias("host"), *_HF)
    model, k = models.pca(h, _HF, 0.9)
    out = model.transform(models.assembled(h, _HF)).select("host", vector_to_array("pca").alias("p"))
    return out.select("host", F.transform(F.slice("p", 1, k), lambda x: F.round(x, 4)).alias("components"))


@query()
def kmeans_hosts(s, d):
    h = T.table(s, d, "host_aggregates").select(C.name("LogHost").alias("host"), *_HF)
    return models.largest_clusters(h, _HF, 8, 5).groupBy("cluster").agg(F.count("*").alias("n"))
