"""Graphs as edge and node tables: ids, features, normalised adjacency, multi-hop embeddings, sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import vectors as V
from emberline.operators.sequences import numbered
from emberline.plans.durable import written


def tripartite_ids(tx: DataFrame, order: Sequence, merchant: str, user: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node numbers in disjoint ranges: transactions from 0 in the given order, then merchants,
    then users by value. Returns (key, merchant, user, tx_id), (merchant, merchant_id), (user, user_id)."""
    t = written(numbered(tx.select(key, merchant, user, *[c for c in order if isinstance(c, str) and c not in (key, merchant, user)]), order, "tx_id").select(key, merchant, user, "tx_id"))
    n = t.count()
    m = written(numbered(t.select(merchant).where(F.col(merchant).isNotNull()).distinct(), [merchant], "r").select(merchant, (F.col("r") + n).alias("merchant_id")))
    k = m.count()
    u = numbered(t.select(user).where(F.col(user).isNotNull()).distinct(), [user], "r").select(user, (F.col("r") + n + k).alias("user_id"))
    return t, m, u


def tripartite_edges(t: DataFrame, m: DataFrame, u: DataFrame, merchant: str, user: str) -> DataFrame:
    """src, dst, weight: user-transaction and merchant-transaction, both directions, weight 0."""
    full = t.join(m, merchant, "left").join(u, user, "left")
    pair = F.explode(F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("user_id", "tx_id"), ("tx_id", "user_id"), ("merchant_id", "tx_id"), ("tx_id", "merchant_id"))])).alias("e")
    return full.select(pair).select("e.src", "e.dst", F.lit(0.0).alias("weight")).where("src IS NOT NULL AND dst IS NOT NULL")


def typed_edges(df: DataFrame, event: str, entities: Sequence[str]) -> DataFrame:
    """src_type, etype, dst_type, src, dst: for each entity column its relation to the event and back; one pass."""
    rel = []
    for c in entities:
        e, v = F.col(event).cast("string"), F.col(c).cast("string")
        rel += [F.struct(F.lit(event).alias("src_type"), F.lit(f"{event}_{c}").alias("etype"), F.lit(c).alias("dst_type"), e.alias("src"), v.alias("dst")), F.struct(F.lit(c).alias("src_type"), F.lit(f"{c}_{event}").alias("etype"), F.lit(event).alias("dst_type"), v.alias("src"), e.alias("dst"))]
    return df.select(F.inline(F.array(*rel))).where("src IS NOT NULL AND dst IS NOT NULL")


def normalised_adjacency(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """src, dst, w = occurrences of the edge over the occurrences of its source's edges."""
    n = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count("*").alias("c"))
    deg = n.groupBy("src").agg(F.sum("c").alias("d"))
    return n.join(deg, "src").select("src", "dst", (F.col("c").cast("double") / F.col("d")).alias("w"))


def laplacian(edges: DataFrame, a: str, b: str) -> DataFrame:
    """src, dst, w of D^-1/2 (A+I) D^-1/2 for the undirected simple graph of the edges."""
    und = edges.select(F.col(a).alias("src"), F.col(b).alias("dst")).union(edges.select(b, a)).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()
    loops = und.select("src", F.col("src").alias("dst")).distinct()
    every = und.union(loops)
    deg = every.groupBy("src").agg(F.count("*").alias("d"))
    return every.join(deg, "src").join(deg.toDF("dst", "e"), "dst").select("src", "dst", (1 / (F.sqrt("d") * F.sqrt("e"))).alias("w"))


def _propagate(adj: DataFrame, state: DataFrame, dim: int) -> DataFrame:
    """node, x: the weighted sum of the neighbours' vectors, 0 without neighbours. A hub's
    edges are summed where they are; only partial sums are shuffled."""
    j = adj.join(state.select(F.col("node").alias("dst"), "x"), "dst")
    s = j.groupBy("src").agg(*[F.sum(F.col("w") * F.col("x")[i]).alias(f"_{i}") for i in range(dim)])
    return state.select("node").join(s.withColumnRenamed("src", "node"), "node", "left").select("node", F.array(*[F.coalesce(f"_{i}", F.lit(0.0)) for i in range(dim)]).alias("x"))


def hop_embeddings(adj: DataFrame, features: DataFrame, dim: int, hops: int = 3) -> DataFrame:
    """node, embedding: the sum over d = 0..hops of the unit vectors of
    P^d e0 - sum_{0<i<d} P^(d-i) E_i, weighted 1/(d+1), where E_i is hop i after scaling.

    The matrix is never powered: every term is advanced one hop a round, all of them side by
    side in one array, so a round is one join and one aggregation. `features`: node, x."""
    state = features.select("node", V.unit(F.col("x")).alias("x"))
    zero = F.array_repeat(F.lit(0.0), dim)
    # x holds P^d e0 followed by R = sum_{i<d} P^(d-i) E_i; total is the sum of hops so far
    state = state.select("node", F.concat("x", zero).alias("x"), F.col("x").alias("total"), zero.alias("last"))
    for d in range(1, hops + 1):
        carried = state.select("node", F.concat(F.slice("x", 1, dim), F.zip_with(F.slice("x", dim + 1, dim), "last", lambda a, b: a + b)).alias("x"))
        moved = _propagate(adj, carried, 2 * dim)
        j = state.select("node", "total").join(moved, "node")
        e = V.unit(V.combined(F.slice("x", 1, dim), -1.0, F.slice("x", dim + 1, dim)))
        j = j.withColumn("e", F.transform(e, lambda v: v / float(d + 1)))
        state = written(j.select("node", "x", V.combined(F.col("total"), 1.0, F.col("e")).alias("total"), F.col("e").alias("last")))
    return state.select("node", F.col("total").alias("embedding"))


def fan_out(edges: DataFrame, seeds: DataFrame, sizes: Sequence[int], seed: int = 3) -> DataFrame:
    """hop, src, dst: for each hop at most sizes[hop] neighbours of every node reached before, by hash order."""
    adj = edges.select("src", "dst").distinct()
    front, out = seeds.toDF("src").distinct(), None
    for hop, k in enumerate(sizes):
        r = F.row_number().over(Window.partitionBy("src").orderBy(F.xxhash64("src", "dst", F.lit(seed + hop)), "dst"))
        got = front.join(adj, "src").withColumn("r", r).where(F.col("r") <= k).select(F.lit(hop).alias("hop"), "src", "dst")
        out = got if out is None else out.unionByName(got)
        front = got.select(F.col("dst").alias("src")).distinct()
    return out


def negative_edges(edges: DataFrame, per_edge: int = 1, seed: int = 17) -> DataFrame:
    """src, dst pairs that are no edge: each edge's source with the target of another edge drawn by hash."""
    one = edges.select("src", "dst").distinct()
    rows = numbered(one, ["src", "dst"])
    n = max(one.count(), 1)
    draw = rows.select("src", F.explode(F.sequence(F.lit(1), F.lit(per_edge))).alias("i"), "rn").select("src", F.pmod(F.xxhash64("rn", "i", F.lit(seed)), F.lit(n)).alias("at"))
    pairs = draw.join(rows.select(F.col("rn").alias("at"), "dst"), "at").select("src", "dst").where("src <> dst").distinct()
    return pairs.join(one, ["src", "dst"], "left_anti")


def window_graph(df: DataFrame, order: Sequence, src: str, dst: str, attrs: Sequence[str], width: int) -> DataFrame:
    """graph_id, pos, src_id, dst_id and attributes: a graph for each run of `width` rows (full
    runs only), nodes numbered by value within the graph."""
    rows = numbered(df.select(*dict.fromkeys([*[c for c in order if isinstance(c, str)], src, dst, *attrs])), order)
    n = rows.agg(F.coalesce(F.max("rn") + 1, F.lit(0))).first()[0]
    rows = rows.withColumn("graph_id", F.floor(F.col("rn") / width)).where(F.col("graph_id") < n // width)
    ends = rows.select("graph_id", F.explode(F.array(src, dst)).alias("node")).distinct()
    ids = ends.withColumn("id", F.row_number().over(Window.partitionBy("graph_id").orderBy("node")) - 1)  # at most 2*width nodes
    a, b = ids.toDF("graph_id", src, "src_id"), ids.toDF("graph_id", dst, "dst_id")
    return rows.join(a, ["graph_id", src]).join(b, ["graph_id", dst]).select("graph_id", (F.col("rn") % width).alias("pos"), "src_id", "dst_id", *attrs)
