"""Similarity clusters of records by bisecting k-means, down to a compactness limit.

Records are points of the unit square. One aggregation over the cluster sums them up in grid
cells of side limit/PARTS: number, coordinate sums, extremes. There are at most MOST_CELLS
cells however many records there are, and records of one cell are alike, so no cell ever has
to be cut. The sums are all that k-means needs: the node with the largest dispersion is split
by 2-means over its cells' sums, again and again, until every leaf is compact, that is until
its records differ by no more than the limit in each coordinate, which the cells' extremes
tell exactly. 2-means may cut through a group of records that are all alike; leaves that are
compact together are put together again, so the result doesn't depend on where the cuts fell.
A group that is compact as a whole, with no other record within the limit of one of its own,
is settled by that. The others, such as chains of records, are looked at cell by cell: extremes
tell which cells lie within the limit of each other whole, or not at all, and only records of
cells that they leave open are compared with each other. A join of the records with their
cells' clusters ends it.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.plans.durable import written

#: Cells of the grid to the limit's length, cells there may be, and steps of one 2-means.
PARTS, MOST_CELLS, LLOYD_STEPS = 8, 1_200_000, 10


def cells(points: DataFrame, limit: float, parts: int = PARTS) -> DataFrame:
    """i, j and n, first (least id), sx, sy, qx, qy (sums of squares), lx, ly, hx, hy of each grid cell that holds points."""
    side = limit / parts
    if math.floor(1 / side + 1) ** 2 > MOST_CELLS:
        raise ValueError(f"limit {limit} needs more than {MOST_CELLS} grid cells; fewer parts or a larger limit are needed")
    at = [F.floor(F.col(c) / side).cast("int").alias(k) for c, k in (("x", "i"), ("y", "j"))]
    sums = [g(F.col(c) * F.col(c) if a == "q" else F.col(c)).alias(a + c) for a, g in (("s", F.sum), ("q", F.sum), ("l", F.min), ("h", F.max)) for c in ("x", "y")]
    return points.select(*at, "id", "x", "y").groupBy("i", "j").agg(F.count("*").alias("n"), F.min("id").alias("first"), *sums)


def bisect(n: np.ndarray, total: np.ndarray, square: np.ndarray, low: np.ndarray, high: np.ndarray, limit: float) -> np.ndarray:
    """Leaf number of each cell by bisecting k-means. `n` points in a cell, and for each of its
    two coordinates the `total`, the `square` total, the `low`est and `high`est value."""
    leaf = np.zeros(len(n), np.int64)
    mean = total / n[:, None]
    heap, number, count = [], itertools.count(), itertools.count()

    def add(rows: np.ndarray) -> None:
        lo, hi = low[rows].min(0), high[rows].max(0)
        if len(rows) == 1 or (hi - lo <= limit).all():
            leaf[rows] = next(number)
            return
        m, s = n[rows].sum(), total[rows].sum(0)
        spread = np.maximum(square[rows].sum(0) - s * s / m, 0)  # dispersion along each axis
        heapq.heappush(heap, (-float(spread.sum()), next(count), rows, s / m, spread / m, lo, hi))

    if len(n):
        add(np.arange(len(n)))
    while heap:
        _, _, rows, centre, var, lo, hi = heapq.heappop(heap)
        p, w = mean[rows], n[rows]
        axis = int(np.argmax(var))
        c = np.array([centre, centre])
        c[:, axis] += np.array([-1, 1]) * (math.sqrt(var[axis]) or (hi[axis] - lo[axis]) / 2)
        near = None
        for _ in range(LLOYD_STEPS):
            side = ((p - c[1]) ** 2).sum(1) < ((p - c[0]) ** 2).sum(1)
            if side.all() or not side.any() or (near is not None and np.array_equal(side, near)):
                break
            near = side
            c = np.array([total[rows[~side]].sum(0) / w[~side].sum(), total[rows[side]].sum(0) / w[side].sum()])
        if near is None or near.all() or not near.any():
            wide = int(np.argmax(hi - lo))
            near = p[:, wide] > (p[:, wide].min() + p[:, wide].max()) / 2
            if not near.any():  # all means in one place: any cut will do
                near = np.arange(len(rows)) > 0
        add(rows[near])
        add(rows[~near])
    return leaf


def joined(low: np.ndarray, high: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each leaf, and whether the group is settled. Leaves whose records together
    differ by at most `limit` in each coordinate are one group; such leaves have lower corners in
    neighbouring squares of that side, and leaves with records within the limit of each other
    have them in at most the third square, so only those are looked at. A group is settled if it
    is compact as a whole and no other leaf comes within the limit of it: then all its records
    are alike and like no others. Any other group is left to the comparison of cells."""
    at = np.floor(low / limit).astype(np.int64)
    squares = defaultdict(list)
    for k, (i, j) in enumerate(at.tolist()):
        squares[i, j].append(k)
    group, reach = np.arange(len(low)), []
    for k, (i, j) in enumerate(at.tolist()):
        other = np.array([x for a in range(-3, 4) for b in range(-3, 4) for x in squares.get((i + a, j + b), ())])
        together = (np.maximum(high[other], high[k]) - np.minimum(low[other], low[k]) <= limit).all(1)
        group[k] = min(other[together], default=k)
        reach.append(other[(np.maximum(low[other] - high[k], low[k] - high[other]) <= limit).all(1)])
    settled = np.ones(len(low), bool)
    for k, other in enumerate(reach):
        if (group[other] != group[k]).any():
            settled[group[k]] = False
    for g in np.unique(group):
        rows = np.flatnonzero(group == g)
        settled[g] &= (high[rows].max(0) - low[rows].min(0) <= limit).all()
    return group, settled[group]


def around(i: np.ndarray, j: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, limit: float, least: int, parts: int = PARTS) -> tuple[np.ndarray, ...]:
    """For each cell the number of records that lie within the limit of all of its own, and the
    least rank among these (`rank` is that of a cell's first record); and the pairs of cells
    whose records have to be compared, as the cells' extremes don't tell and either the first
    has fewer than `least` records around it so far or the second has a record of lesser rank."""
    r = parts + 1
    grid = np.full((i.max() + 1 + 2 * r, j.max() + 1 + 2 * r), -1)
    grid[i + r, j + r] = np.arange(len(i))
    count, best = np.zeros(len(i), np.int64), np.full(len(i), len(rank))

    def pairs():
        for a, b in itertools.product(range(2 * r + 1), repeat=2):
            other = grid[i + a, j + b]
            cell = np.flatnonzero(other >= 0)
            other = other[cell]
            within = (np.maximum(high[other], high[cell]) - np.minimum(low[other], low[cell]) <= limit).all(1)
            yield cell, other, within, ~within & (np.maximum(low[other] - high[cell], low[cell] - high[other]) <= limit).all(1)

    for cell, other, within, _ in pairs():
        count[cell[within]] += n[other[within]]
        best[cell[within]] = np.minimum(best[cell[within]], rank[other[within]])
    kept = []
    for cell, other, _, partly in pairs():
        partly &= (count[cell] < least) | (rank[other] < best[cell])
        kept.append((cell[partly], other[partly]))
    return count, best, *map(np.concatenate, zip(*kept))


def clusters(points: DataFrame, limit: float, least: int, parts: int = PARTS) -> DataFrame:
    """Cluster of each record that has one: id, x, y, cluster. `points`: id (not null, no
    repeats), and x and y from 0 to 1 (see `unit_points`); rows with other, null or NaN
    coordinates are left out. A record that has at least `least` records, with itself, within
    `limit` in each coordinate is in the cluster named after the least id among these.

    The driver sees the grid cells (bounded by MOST_CELLS, not by the records) and sends each
    cell's cluster back, which is as bounded; records themselves are only scanned and joined.
    Where cells don't tell, records are compared with those of the cells around that may count:
    all of them around cells with few records, otherwise those of a lesser id only."""
    points = points.where(F.col("x").between(0, 1) & F.col("y").between(0, 1))
    t = cells(points, limit, parts).toPandas().sort_values(["i", "j"], ignore_index=True)
    two = lambda a: t[[a + "x", a + "y"]].to_numpy(np.float64).reshape(-1, 2)
    n, low, high, i, j, size = t["n"].to_numpy(np.int64), two("l"), two("h"), t["i"].to_numpy(np.int64), t["j"].to_numpy(np.int64), len(t)
    by_rank = np.array(sorted(range(size), key=t["first"].tolist().__getitem__), np.int64)
    rank = np.argsort(by_rank)
    leaf = bisect(n, two("s"), two("q"), low, high, limit)
    order = np.argsort(leaf, kind="stable")
    begins = np.flatnonzero(np.append(True, np.diff(leaf[order]) != 0)) if size else np.zeros(0, np.int64)
    whole = lambda f, v: f.reduceat(v[order], begins) if size else v
    group, settled = (v[leaf] if size else v for v in joined(whole(np.minimum, low), whole(np.maximum, high), limit))
    count, best = np.zeros(size, np.int64), np.full(size, size)
    np.add.at(count, group, n)
    np.minimum.at(best, group, rank)
    count, best = count[group], best[group]
    rest = np.flatnonzero(~settled)
    asks = rest[:0]
    if len(rest):
        count[rest], best[rest], asks, told = around(i[rest], j[rest], n[rest], low[rest], high[rest], rank[rest], limit, least, parts)
        asks, told = rest[asks], rest[told]
    clear = np.setdiff1d(np.flatnonzero(count >= least), asks)

    spark, kind, side = points.sparkSession, points.schema["id"].dataType.simpleString(), limit / parts
    place = lambda p: p.select("id", "x", "y", F.floor(F.col("x") / side).cast("int").alias("i"), F.floor(F.col("y") / side).cast("int").alias("j"))
    table = spark.createDataFrame(t.loc[clear, ["i", "j"]].assign(number=by_rank[best[clear]]).astype("int32"), "i int, j int, number int")
    used = np.unique(by_rank[best[clear]])
    names = spark.createDataFrame(t.loc[used, ["first"]].assign(number=used.astype("int32"))[["number", "first"]], f"number int, cluster {kind}")
    if len(asks):
        points = written(points)
    at = place(points)
    out = at.join(F.broadcast(table), ["i", "j"]).join(names, "number").select("id", "x", "y", "cluster")  # at most MOST_CELLS rows of 12 bytes
    if not len(asks):
        return out

    first, width = t["first"].to_numpy(object), int(j.max()) + 1
    code = i * width + j
    by = np.argsort(asks, kind="stable")
    own, starts = np.unique(asks[by], return_index=True)
    lists = [v.tolist() for v in np.split(code[told[by]], starts[1:])]
    some = best[own] < size  # a cell wider than the limit may have none that is sure
    base = spark.createDataFrame([(int(a), int(b), int(c), first[by_rank[d]] if s else None, v) for a, b, c, d, s, v in zip(i[own], j[own], count[own], best[own], some, lists)], f"i int, j int, n bigint, m {kind}, to array<int>")
    every, top = np.zeros(size, bool), np.zeros(size, np.int64)
    every[told[count[asks] < least]] = True
    np.maximum.at(top, told, np.minimum(best[asks], size - 1))
    heard = np.unique(told)
    wanted = spark.createDataFrame([(int(code[c]), bool(every[c]), first[by_rank[top[c]]]) for c in heard], f"cell int, every boolean, top {kind}")
    asked = at.join(base, ["i", "j"])
    other = at.select(F.col("id").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("i") * width + F.col("j")).alias("cell")).join(wanted, "cell").where("every OR o < top").select("o", "ox", "oy", "cell")
    near = (F.abs(F.col("x") - F.col("ox")) <= limit) & (F.abs(F.col("y") - F.col("oy")) <= limit) & ((F.col("n") < least) | (F.col("o") < F.col("m")))
    match = asked.select("id", "x", "y", "n", "m", F.explode("to").alias("cell")).join(other, "cell").where(near)
    rows = asked.select("id", "x", "y", "n", "m").unionByName(match.select("id", "x", "y", F.lit(1).cast("bigint").alias("n"), F.col("o").alias("m")))
    compared = rows.groupBy("id", "x", "y").agg(F.sum("n").alias("n"), F.min("m").alias("cluster")).where(F.col("n") >= least)
    return out.unionByName(compared.select("id", "x", "y", "cluster"))


def describe(members: DataFrame, typical: int = 5) -> DataFrame:
    """Size, centre and most typical members (nearest to the centre, ties by id) of each cluster:
    cluster, size, centre_x, centre_y, rank, id, distance."""
    centre = members.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("x").alias("centre_x"), F.avg("y").alias("centre_y"))
    far = members.join(centre, "cluster").withColumn("distance", F.sqrt(F.pow(F.col("x") - F.col("centre_x"), 2) + F.pow(F.col("y") - F.col("centre_y"), 2)))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("distance", "id"))
    return far.withColumn("rank", rank).where(F.col("rank") <= typical).select("cluster", "size", "centre_x", "centre_y", "rank", "id", "distance")


def unit_points(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """One point for each key: rows with a null key or a coordinate that is null, NaN or
    outside 0 to 1 are left out; a repeated key takes its least row (by x, then y)."""
    ok = F.col(x).between(0, 1) & F.col(y).between(0, 1) & ~F.isnan(x) & ~F.isnan(y)
    one = df.where(F.col(key).isNotNull() & ok).groupBy(F.col(key).alias("id")).agg(F.min(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).alias("p"))
    return one.select("id", "p.x", "p.y")
