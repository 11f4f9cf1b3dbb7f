"""Sessions from a Cartesian tree over the gaps between an entity's events.

The tree over consecutive gaps has the longest gap at its root. Each node stands for a
maximal stretch of events whose inner gaps are no longer than the node's own gap, and knows
the gap that encloses it (its parent's). A session at threshold t is then any node with
`gap <= t < parent_gap`, so one stored tree answers every threshold with a filter.

The tree is built in two rounds. Round one sees an entity's events of one day at a time, at
most one row per second, and emits every node that lies clear of the chunk's ends: its parent
is the smaller of the two gaps beside it, both inside the chunk, so no later chunk can change
it. What is left of a chunk is its spine, the gaps that are longest so far from either end,
with the stretches between them. Round two strings an entity's spines together and builds
the remaining nodes from them in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.plans.durable import written

#: Parent gap of a root: no threshold reaches it.
NO_PARENT = 2**62
TREE = "entity string, start_time bigint, end_time bigint, n_records bigint, gap bigint, parent_gap bigint"
_PART = TREE + ", open boolean, known boolean"


_KINDS = [pa.string(), *[pa.int64()] * 5, pa.bool_(), pa.bool_()]
_NAMES = ["entity", "start_time", "end_time", "n_records", "gap", "parent_gap", "open", "known"]


def _batch(entity: pa.Array, at: np.ndarray, *cols: np.ndarray) -> pa.RecordBatch:
    """Rows with the entity names at the places `at`."""
    values = [entity.take(pa.array(at)), *cols]
    return pa.RecordBatch.from_arrays([pa.array(v, t) if isinstance(v, np.ndarray) else v for v, t in zip(values, _KINDS)], names=_NAMES[: len(values)])


def _nearest(g: np.ndarray, step: int, equal_stops: bool = False) -> np.ndarray:
    """For each place below NO_PARENT the nearest one before (step -1) or after (1) it with a larger
    value, or one at least as large. All places jump at once, each over what its neighbour has
    jumped over already, so it takes about log(longest run) rounds."""
    to = np.arange(len(g)) + step
    todo = np.flatnonzero(g < NO_PARENT)
    while todo.size:
        there = g[to[todo]]
        todo = todo[there < g[todo] if equal_stops else there <= g[todo]]
        to[todo] = to[to[todo]]
    return to


def _nodes(g: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tree nodes over elements with the gaps g: g[e] before element e, g[e + 1] after it,
    NO_PARENT where a chunk begins or ends. Returns the gap at the top of each node and the two
    gaps that enclose it; a node holds the elements from the first of these to before the second.
    Equal gaps without a longer one between them are one node, that of the first."""
    left, right = _nearest(g, -1), _nearest(g, 1)
    top = np.flatnonzero((g <= longest) & (_nearest(g, -1, True) == left))
    return top, left[top], right[top]


class _Held:
    """Batches as whole groups: rows of the last group wait for the next batch."""

    def __init__(self, keys: int, width: int):
        self.keys, self.width, self.parts = keys, width, []

    def _edges(self, cols: list[pa.Array]) -> np.ndarray:
        code = [c.dictionary_encode().indices if pa.types.is_string(c.type) else c for c in cols[: self.keys]]
        code = [c.to_numpy(zero_copy_only=False) for c in code]
        return np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in code])) + 1

    def whole(self, batch: pa.RecordBatch | None) -> tuple[list[pa.Array], np.ndarray] | None:
        """Columns of the groups that are complete, and where each begins; without a batch all that is left."""
        if batch is not None:
            new = [batch.column(i) for i in range(self.width)]
            goes_on = self.parts and all(a[len(a) - 1].as_py() == b[0].as_py() for a, b in zip(self.parts[-1][: self.keys], new))
            self.parts.append(new)
            if goes_on and not self._edges(new).size:
                return None
        if not self.parts:
            return None
        cols = [pa.concat_arrays(c) for c in zip(*self.parts)]
        edge = self._edges(cols)
        cut = len(cols[0]) if batch is None else int(edge[-1]) if edge.size else 0
        self.parts = [[c.slice(cut) for c in cols]] if batch is not None else []
        return ([c.slice(0, cut) for c in cols], np.append(0, edge[edge < cut])) if cut else None


def _groups(batches: Iterator[pa.RecordBatch], keys: int, width: int) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    held = _Held(keys, width)
    for batch in chain((b for b in batches if b.num_rows), [None]):
        if (got := held.whole(batch)) is not None:
            yield got


def _round_one(shortest: int, longest: int):
    """(entity, chunk, second, events), sorted, to closed nodes and open spine stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (entity, _, t, n), begins in _groups(batches, 2, 4):
            t, n = t.to_numpy(zero_copy_only=False), n.to_numpy(zero_copy_only=False)
            gap = np.append(NO_PARENT, t[1:] - t[:-1])
            gap[begins] = NO_PARENT
            at = np.flatnonzero(gap > shortest)  # elements: events no more than `shortest` apart
            inside = np.where(gap > shortest, 0, gap)
            start, end = t[at], t[np.append(at[1:], len(t)) - 1]
            count, inner = np.add.reduceat(n, at), np.maximum.reduceat(inside, at)
            g = np.append(gap[at], NO_PARENT)
            upto = np.append(0, np.cumsum(count))
            outer = g >= NO_PARENT
            top, left, right = _nodes(g, longest)
            clear = ~outer[left] & ~outer[right]
            top, left, right = top[clear], left[clear], right[clear]
            single = np.flatnonzero(~outer[:-1] & ~outer[1:])
            no, yes = np.zeros(len(single) + len(top), bool), np.ones(len(single) + len(top), bool)
            yield _batch(entity, np.append(at[single], at[left]), np.append(start[single], start[left]), np.append(end[single], end[right - 1]), np.append(count[single], upto[right] - upto[left]), np.append(inner[single], g[top]), np.append(np.minimum(g[single], g[single + 1]), np.minimum(g[left], g[right])), no, yes)
            # the spine: gaps with no longer one before them in the chunk, or none after
            spine = np.flatnonzero(outer | outer[_nearest(g, -1)] | outer[np.minimum(_nearest(g, 1), len(g) - 1)])
            x, y = spine[:-1], spine[1:]  # a stretch holds the elements x to y - 1
            widest = np.where(y - x == 1, inner[x], np.maximum.reduceat(np.where(np.isin(np.arange(len(g)), spine), 0, g), x))
            ends = outer[x] | outer[y]  # its parent isn't known yet
            yield _batch(entity, at[x], start[x], end[y - 1], upto[y] - upto[x], widest, np.full(len(x), NO_PARENT), np.ones(len(x), bool), ~ends)

    return run


def _round_two(longest: int):
    """Spine stretches of whole entities, sorted, to the nodes that round one left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, begins in _groups(batches, 1, 8):
            entity = cols[0]
            start, end, count, inner, _, _, known = (c.to_numpy(zero_copy_only=False) for c in cols[1:])
            g = np.concatenate([[NO_PARENT], start[1:] - end[:-1], [NO_PARENT]])
            g[begins] = NO_PARENT
            upto = np.append(0, np.cumsum(count))
            top, left, right = _nodes(g, longest)
            new = np.flatnonzero(~known.astype(bool))
            yield _batch(entity, np.append(new, left), np.append(start[new], start[left]), np.append(end[new], end[right - 1]), np.append(count[new], upto[right] - upto[left]), np.append(inner[new], g[top]), np.append(np.minimum(g[new], g[new + 1]), np.minimum(g[left], g[right])))

    return run


def session_tree(df: DataFrame, entity: str, time_s: str, shortest: int = 60, longest: int = 86_400, chunk_s: int = 86_400) -> DataFrame:
    """The gap tree of each entity, good for every session threshold from `shortest` to `longest` seconds.

    Rows without entity or time are left out; an entity with one event is one node of gap 0.
    Events of one second are one element with a count. Result: entity, start_time, end_time,
    n_records, gap, parent_gap (2**62 at the root). The two bounds go with the tree, as metadata
    of `gap`, also into a stored table, and `sessions_at` holds thresholds against them.

    The first shuffle is by (entity, second) with map-side combining, so no entity gathers;
    the second by (entity, chunk) moves at most `chunk_s` rows for each; the third by entity
    moves spines only, whose length is logarithmic for gaps in no particular order.
    """
    seconds = df.select(F.col(entity).alias("entity"), F.col(time_s).cast("bigint").alias("t")).where("entity IS NOT NULL AND t IS NOT NULL").groupBy("entity", "t").agg(F.count("*").alias("n"))
    chunks = seconds.select("entity", F.floor(F.col("t") / chunk_s).alias("chunk"), "t", "n").repartition("entity", "chunk").sortWithinPartitions("entity", "chunk", "t")
    part = written(chunks.mapInArrow(_round_one(shortest, longest), _PART))
    spines = part.where("open").repartition("entity").sortWithinPartitions("entity", "start_time")
    rest = spines.mapInArrow(_round_two(longest), TREE)
    return part.where("NOT open").drop("open", "known").union(rest).withMetadata("gap", {"shortest": shortest, "longest": longest})


def _within(tree: DataFrame, gap: int) -> int:
    """`gap`, if the tree is good for it: below its bounds sessions have been merged, above
    them they have not been built."""
    bounds = tree.schema["gap"].metadata
    if "shortest" not in bounds:
        raise ValueError("not a tree of session_tree: `gap` has no bounds")
    if not bounds["shortest"] <= gap <= bounds["longest"]:
        raise ValueError(f"threshold {gap} lies outside the tree's bounds {bounds['shortest']} to {bounds['longest']}")
    return int(gap)


def sessions_at(tree: DataFrame, gap: int) -> DataFrame:
    """Sessions at threshold `gap`: an event more than `gap` seconds after the one before it
    starts a new session, one exactly `gap` after does not. A threshold outside the tree's
    bounds raises. Result: entity, start_time, end_time, duration (seconds), n_records."""
    gap = _within(tree, gap)
    cut = tree.where((F.col("gap") <= gap) & (F.col("parent_gap") > gap))
    return cut.select("entity", "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"), "n_records")


def sessions_for(tree: DataFrame, gaps: list[int]) -> DataFrame:
    """Sessions of each of several thresholds from one tree, with the column `gap_s`; one outside
    the tree's bounds raises."""
    gaps = [_within(tree, g) for g in gaps]
    each = F.explode(F.filter(F.array(*[F.lit(g) for g in gaps]), lambda g: (F.col("gap") <= g) & (F.col("parent_gap") > g))).alias("gap_s")
    return tree.select("entity", each, "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"), "n_records")
