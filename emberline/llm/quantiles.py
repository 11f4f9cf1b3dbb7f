"""Percentiles of very large numeric columns from mergeable sketches with bounded rank error.

A sketch of n values holds at most k of them. Up to k values it is exact. Beyond, its sorted
values are collapsed into k slots of n/k neighbouring ranks (sizes differ by one at most), and
the middle value of each slot stands for the slot, so that every element carries the same
weight and the pair (n, values) says all. Merging concatenates weighted buffers, sorts them
and collapses again. A collapse moves no rank by more than half a slot; the bounds of all
collapses on the way up the tree add up in `err`, which is the sketch's guaranteed rank error.

The first buffers are made where the rows are: a partition's rows are sorted by group and
streamed into buffers, one for each group and partition, so a group with very many rows leaves
a partition as k values and only small groups travel as they are. Nothing is random: the same
rows in the same partitions give the same sketch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Elements of a sketch; one collapse costs at most 1/(2k) of the ranks.
K = 2_048
#: Sketches of one group merged by one call.
FAN_IN = 96


def measure(c: str) -> Column:
    """Usable values as double: null, NaN, infinite and negative ones are left out."""
    d = F.col(c).cast("double")
    return F.when((d >= 0) & ~F.isnan(d) & (d < F.lit(float("inf"))), d)


def _half_slot(n, k):
    return -(-(-(-n // k)) // 2)


def _collapsed(v: np.ndarray, k: int) -> tuple[int, np.ndarray, int]:
    """(n, values, err) of sorted single values: themselves, or the middle of each of k slots of equal rank width."""
    n = len(v)
    if n <= k:
        return n, v, 0
    edge = np.arange(k + 1) * n // k
    return n, v[(edge[:-1] + 1 + edge[1:]) // 2 - 1], _half_slot(n, k)


def _edges(cols: list[pa.Array]) -> np.ndarray:
    """Where a row differs from the one before it in any column; nulls are equal to each other."""
    out = []
    for c in cols:
        ok = c.is_valid().to_numpy(zero_copy_only=False)
        v = c.dictionary_encode().indices if pa.types.is_string(c.type) else c
        v = v.fill_null(0).to_numpy(zero_copy_only=False)
        out.append((v[1:] != v[:-1]) | (ok[1:] != ok[:-1]))
    return np.append(0, np.flatnonzero(np.logical_or.reduce(out)) + 1) if out else np.zeros(1, np.int64)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    off = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(values) if values else np.empty(0)))


def _level_zero(keys: int, fields: int, k: int, fan_in: int, kinds: list[pa.DataType], names: list[str]):
    """Rows sorted by group (keys, then fields) to buffers; a group's rows may come in many batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        group, held = None, []  # the open group and, for each field, its buffers so far

        def rows(key_cols: list[pa.Array], sketches: list[list[tuple]]) -> pa.RecordBatch:
            m = len(sketches[0])
            cols = [*[c.cast(t) for c, t in zip(key_cols, kinds)], pa.array(np.full(m, part, np.int32))]
            for each in sketches:
                cols += [pa.array([n for n, _, _ in each], pa.int64()), _lists([v for _, v, _ in each]), pa.array([e for _, _, e in each], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=names)

        def put_together(buffers: list[tuple]) -> tuple:
            return buffers[0] if len(buffers) == 1 else merge_buffers(np.array([n for n, _, _ in buffers]), [v for _, v, _ in buffers], np.array([e for _, _, e in buffers]), k)

        def close() -> pa.RecordBatch:
            return rows([pa.array([g], t) for g, t in zip(group, kinds)], [[put_together(h)] for h in held])

        for b in batches:
            if not b.num_rows:
                continue
            at = _edges([b.column(i) for i in range(keys)])
            m = len(at)
            of = np.zeros(b.num_rows, np.int64)
            of[at[1:]] = 1
            of = np.cumsum(of)
            sketches = []
            for f in range(fields):
                v = b.column(keys + f).to_numpy(zero_copy_only=False).astype(np.float64)
                ok = ~np.isnan(v)
                g, v = of[ok], v[ok]
                v = v[np.lexsort((v, g))]
                off = np.append(0, np.cumsum(np.bincount(g, minlength=m)))
                sketches.append([_collapsed(v[x:y], k) for x, y in zip(off[:-1].tolist(), off[1:].tolist())])
            first = [b.column(i)[0].as_py() for i in range(keys)]
            lo = 0
            if group is not None and group == first:
                for h, s in zip(held, sketches):
                    h.append(s[0])
                    if len(h) >= fan_in:
                        h[:] = [put_together(h)]
                lo = 1
            if m > lo:
                if group is not None:
                    yield close()
                if m - 1 > lo:
                    yield rows([b.column(i).take(pa.array(at[lo : m - 1])) for i in range(keys)], [s[lo : m - 1] for s in sketches])
                group, held = [b.column(i)[int(at[m - 1])].as_py() for i in range(keys)], [[s[m - 1]] for s in sketches]
        if group is not None:
            yield close()

    return run


def base_sketches(df: DataFrame, keys: Sequence[str], fields: Sequence[str], k: int = K, fan_in: int = FAN_IN) -> tuple[DataFrame, int]:
    """First-level sketches: for each combination of `keys` (null is a value like any other),
    each partition and each field f the columns n_f, v_f, e_f (count, sorted values, rank
    error), plus `part`, the partition.

    There is no exchange: rows are sketched in the partitions they come in. If they come from a
    shuffle it should be one that spreads a hot group, as that of `tables.flows` does. Within a
    partition a group is streamed, so no task holds a hot one. Equal rows count each. Returns
    the sketches and how many of one group there are at most, as far as the session tells."""
    spark = df.sparkSession
    rows = df.select(*keys, *[measure(f).alias(f) for f in fields], F.xxhash64(*df.columns).alias("__h")).where(F.coalesce(*fields).isNotNull())
    rows = rows.sortWithinPartitions(*keys, "__h").drop("__h")
    cols = [c for f in fields for c in (f"n_{f}", f"v_{f}", f"e_{f}")]
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys], "part int", *[f"`n_{f}` bigint, `v_{f}` array<double>, `e_{f}` bigint" for f in fields]])
    kinds = [to_arrow_type(df.schema[c].dataType) for c in keys]
    most = max(int(spark.conf.get(c, None) or 1) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"))
    return rows.mapInArrow(_level_zero(len(keys), len(fields), k, fan_in, kinds, [*keys, "part", *cols]), schema), most


def merge_buffers(ns: np.ndarray, values: list[np.ndarray], errs: np.ndarray, k: int) -> tuple[int, np.ndarray, int]:
    """(n, values, err) of all the given sketches together."""
    n, err = int(ns.sum()), int(errs.sum())
    v = np.concatenate(values) if values else np.empty(0)
    if n <= k and n == len(v):
        return n, np.sort(v), err
    w = np.concatenate([np.ones(len(x), np.int64) if len(x) == m else np.diff(np.arange(len(x) + 1) * m // len(x)) for m, x in zip(ns.tolist(), values)])
    order = np.argsort(v, kind="stable")
    v, upto = v[order], np.cumsum(w[order])
    edge = np.arange(k + 1) * n // k
    at = np.searchsorted(upto, (edge[:-1] + 1 + edge[1:]) // 2)
    return n, v[at], err + _half_slot(n, k)


def _merge(keys: int, fields: int, k: int, names: list[str], kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = [b.column(i).cast(kinds[i]) for i in range(keys)]
            for f in range(fields):
                n_col, v_col, e_col = (b.column(keys + 3 * f + i) for i in range(3))
                n_off, n_val = n_col.offsets.to_numpy(), n_col.values.to_numpy()
                e_val = e_col.values.to_numpy()
                v_off, inner = v_col.offsets.to_numpy(), v_col.values
                i_off, val = inner.offsets.to_numpy(), inner.values.to_numpy(zero_copy_only=False)
                ns, vs, es = [], [], []
                for r in range(b.num_rows):
                    lo, hi = v_off[r], v_off[r + 1]
                    m = n_val[n_off[r] : n_off[r + 1]]
                    e = e_val[n_off[r] : n_off[r + 1]]
                    total = int(m.sum())
                    flat = val[i_off[lo] : i_off[hi]]
                    if total <= k and total == len(flat):
                        n, v, err = total, np.sort(flat), int(e.sum())
                    else:
                        n, v, err = merge_buffers(m, [val[i_off[i] : i_off[i + 1]] for i in range(lo, hi)], e, k)
                    ns.append(n), vs.append(v), es.append(err)
                off = np.append(0, np.cumsum([len(v) for v in vs])).astype(np.int32)
                out += [pa.array(ns, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(vs))), pa.array(es, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def merge_sketches(sketches: DataFrame, keys: Sequence[str], fields: Sequence[str], most_parts: int, k: int = K, fan_in: int = FAN_IN) -> DataFrame:
    """Sketches of coarser groups: all sketches with the same `keys` put together.

    With more than `fan_in` of them to a group the merge goes up a tree of that fan-in, so
    neither a task nor the error bound sees more than logarithmically many at once.
    """
    cols = [c for f in fields for c in (f"n_{f}", f"v_{f}", f"e_{f}")]
    kinds = [sketches.schema[c].dataType for c in keys]
    spread = [c for c in sketches.columns if c not in keys and c not in cols]
    state = sketches.withColumn("__leaf", F.xxhash64(*spread) if spread else F.lit(0))
    groups = most_parts
    while True:
        groups = -(-groups // fan_in)
        by = [*keys] if groups == 1 else [*keys, "__leaf"]
        if groups > 1:
            state = state.withColumn("__leaf", F.pmod(F.col("__leaf"), F.lit(groups)))
        state = state.groupBy(*by).agg(*[F.collect_list(c).alias(c) for c in cols]).select(*by, *cols)
        schema = ", ".join([f"`{c}` {sketches.schema[c].dataType.simpleString()}" for c in keys] + (["__leaf bigint"] if groups > 1 else []) + [f"`n_{f}` bigint, `v_{f}` array<double>, `e_{f}` bigint" for f in fields])
        arrow = [to_arrow_type(t) for t in kinds] + ([pa.int64()] if groups > 1 else [])
        state = state.mapInArrow(_merge(len(by), len(fields), k, [*by, *cols], arrow), schema)
        if groups == 1:
            return state


def percentiles(sketches: DataFrame, keys: Sequence[str], fields: Sequence[str], percents: Sequence[int]) -> DataFrame:
    """One row per group and field with values: keys, field, n, p<q> for each q, rank_error.

    The q-th percentile is the value at rank ceil(q*n/100); the returned value's true rank is
    within `rank_error` of it (0: exact). Groups without values have no row."""
    def at(q: int) -> Column:
        rank = F.ceil(F.col("s.n") * q / 100)
        return F.element_at("s.v", F.greatest(F.ceil(rank * F.size("s.v") / F.col("s.n")), F.lit(1)).cast("int")).alias(f"p{q}")

    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{f}").alias("n"), F.col(f"v_{f}").alias("v"), F.col(f"e_{f}").alias("e")) for f in fields])).alias("s")
    rows = sketches.select(*keys, each).where("s.n > 0")
    return rows.select(*keys, F.col("s.field").alias("field"), F.col("s.n").alias("n"), *[at(q) for q in percents], F.col("s.e").alias("rank_error"))
