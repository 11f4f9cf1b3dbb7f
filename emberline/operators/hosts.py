"""Per-host features of Windows event logs: 42 counts and 2 shares, in two aggregations.

All counts of a role (the logging host, the source, the destination) are conditional aggregates
of one pass; distinct values are exact. Blocks of input simply add up: there is no state that
could lose an earlier block's counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import clean as C
from emberline.operators.predicates import safe_ratio

# Event ids counted by logging host and by source, and the logon types.
HOST_EVENTS = {"total_logins_cnt": 4624, "accnt_fail_logon_cnt": 4625, "total_logoff_cnt": 4634, "total_user_initi_logoff_cnt": 4647, "logon_explicit_cred_frm_cnt": 4648, "spl_pvlgs": 4672, "domain_ctr_validate_cnt": 4776, "scrnsaver_invok_cnt": 4802, "scrnsaver_dismiss_cnt": 4803}
SOURCE_EVENTS = {"total_logins_src_cnt": 4624, "accnt_fail_logon_src_cnt": 4625, "TGT_req_src_cnt": 4768, "TGS_req_src_cnt": 4769, "domain_ctr_validate_src_cnt": 4776}
LOGON_TYPES = [0, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12]
LOGON_EVENTS = [4624, 4625]
EXPLICIT_CREDENTIALS = 4648


def event_counts(rows: DataFrame, host: str, events: dict[str, int]) -> DataFrame:
    """entity and one count for each listed event id; rows without a host are left out."""
    return rows.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("entity")).agg(*[F.count_if(F.col("event_id") == v).alias(k) for k, v in events.items()])


def _of_type() -> dict[int, Column]:
    on = F.col("event_id").isin(LOGON_EVENTS)
    return {t: on & (F.col("logon_type") == t) for t in LOGON_TYPES}


def logon_types(rows: DataFrame) -> DataFrame:
    """entity, logon_type_T and logon_type_frm_T (with a source) of logon events."""
    own = [F.count_if(c).alias(f"logon_type_{t}") for t, c in _of_type().items()]
    frm = [F.count_if(c & F.col("source").isNotNull()).alias(f"logon_type_frm_{t}") for t, c in _of_type().items()]
    return rows.where("log_host IS NOT NULL").groupBy(F.col("log_host").alias("entity")).agg(*own, *frm)


def distinct_values(rows: DataFrame) -> DataFrame:
    """entity and its numbers of different users, domains and sources, exactly.

    Values are made distinct per (host, kind, value) first, so that a busy host's rows are
    combined where they are read and its values are spread over all tasks."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("v")) for k, c in (("UserName_cnt", "user_name"), ("DomainName_cnt", "domain_name"), ("Source_cnt", "source"))])).alias("x")
    one = rows.where("log_host IS NOT NULL").select(F.col("log_host").alias("entity"), kinds).select("entity", "x.kind", "x.v").where("v IS NOT NULL").distinct()
    return one.groupBy("entity").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("UserName_cnt", "DomainName_cnt", "Source_cnt")])


def host_features(rows: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """One row for each host that logs or is a source: LogHost, 42 counts, 2 shares.

    `rows` come from `tables.records`; numbers of different values don't depend on repeats, so
    they may come from `raw`, the rows before repeats are merged. Each record is taken once, as
    a row of its host, its source and, where that counts, its destination, so all counts are
    one aggregation, combined before its shuffle. A share is a count over total_logins_cnt: -1
    where there are such logins but no total, null where both are 0."""
    roles = F.explode(F.array(F.struct(F.lit("h").alias("role"), F.col("log_host").alias("entity")), F.struct(F.lit("s").alias("role"), F.col("source").alias("entity")), F.struct(F.lit("d").alias("role"), F.when(F.col("event_id") == EXPLICIT_CREDENTIALS, F.col("destination")).alias("entity")))).alias("x")
    each = rows.select("event_id", "logon_type", "source", "log_host", "user_name", roles).select("*", "x.*").where("entity IS NOT NULL")
    host, src = F.col("role") == "h", F.col("role") == "s"
    login = host & (F.col("event_id") == HOST_EVENTS["total_logins_cnt"])
    machine = F.col("user_name").endswith("$")
    own = F.col("user_name") == F.concat("log_host", F.lit("$"))
    counts = {k: host & (F.col("event_id") == v) for k, v in HOST_EVENTS.items()} | {k: src & (F.col("event_id") == v) for k, v in SOURCE_EVENTS.items()} | {"logon_explicit_cred_to_cnt": F.col("role") == "d"}
    counts |= {f"logon_type_{t}": host & c for t, c in _of_type().items()} | {f"logon_type_frm_{t}": host & c & F.col("source").isNotNull() for t, c in _of_type().items()}
    counts |= {"uname_other_compacnt_login_cnt": login & machine & ~own, "uname_that_compacnt_login_cnt": login & own}
    wide = each.groupBy("entity").agg(F.count_if(F.col("role") != "d").alias("__n"), *[F.count_if(c).alias(k) for k, c in counts.items()]).where("__n > 0")
    distinct = ["UserName_cnt", "DomainName_cnt", "Source_cnt"]
    wide = wide.join(distinct_values(rows if raw is None else raw), "entity", "left").na.fill(0, distinct)
    shares = [safe_ratio(F.col(f"uname_{w}_compacnt_login_cnt"), F.col("total_logins_cnt")).alias(f"uname_{w}_compacnt_login_frac") for w in ("other", "that")]
    return wide.select(F.col("entity").alias("LogHost"), *distinct, *counts, *shares)


def session_aggregate(rows: DataFrame, keys: list[str], distinct: list[str], largest: list[str], categories: dict[str, list]) -> DataFrame:
    """Sign-in style aggregate: distinct counts, maxima, and a conditional count for every
    listed category value (the sum of its one-hot column, without making the column)."""
    ones = [F.count_if(F.col(c) == v).alias(f"{c}_{v}") for c, vs in categories.items() for v in vs]
    return rows.groupBy(*keys).agg(*[F.count_distinct(c).alias(f"n_{c}") for c in distinct], *[F.max(c).alias(f"max_{c}") for c in largest], *ones)


def cluster_profile(df: DataFrame, cluster: str, features: list[str]) -> DataFrame:
    """cluster, feature, size, mean and median over its rows and all rows, deviations, shares of non-zero rows.

    Means are over non-zero rows, as are their totals; medians over all rows; percentages of
    non-zero rows inside, overall and among the rest. Unpivoted, so any number of features
    costs the same two aggregations."""
    long = df.select(F.col(cluster).alias("cluster"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), C.finite(f).alias("v")) for f in features])).alias("x")).select("cluster", "x.*")
    nz = F.count_if(F.coalesce(F.col("v"), F.lit(0.0)) != 0)
    own = long.groupBy("cluster", "feature").agg(F.count("*").alias("size"), nz.alias("nz"), F.sum("v").alias("s"), F.median("v").alias("median"))
    total = long.groupBy("feature").agg(F.count("*").alias("n_all"), nz.alias("nz_all"), F.sum("v").alias("s_all"), F.median("v").alias("median_total"))
    j = own.join(total, "feature")
    j = j.withColumns({"mean": C.div("s", "nz"), "mean_total": C.div("s_all", "nz_all")})
    return j.select("cluster", "feature", "size", "mean", "mean_total", F.coalesce(C.div("mean", "mean_total") - 1, F.lit(0.0)).alias("mean_dev"), "median", "median_total", (C.div("median", "median_total") - 1).alias("median_dev"), C.div(F.col("nz") * 100, "size").alias("nz_frac"), C.div(F.col("nz_all") * 100, "n_all").alias("nz_frac_total"), C.div((F.col("nz_all") - F.col("nz")) * 100, F.col("n_all") - F.col("size")).alias("nz_frac_rem"))


def top_deviations(profile: DataFrame, k: int, support: float = 5.0) -> DataFrame:
    """The k features of each cluster whose mean deviates most, among those with more than
    `support` percent of non-zero rows; ties by feature name."""
    r = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.abs("mean_dev")), "feature"))
    return profile.where(F.col("nz_frac") > support).withColumn("rank", r).where(F.col("rank") <= k).select("cluster", "rank", "feature", "mean_dev")
