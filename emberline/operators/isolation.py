"""Isolation forest: rows that random cuts set apart early are odd."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import clean as C

#: Trees, and rows that each of them is grown on.
TREES, ROWS = 100, 256
#: Rows drawn for all trees together; every tree takes its ROWS from these.
DRAWN = TREES * ROWS


def _usual_depth(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree as arrays: feature (-1 for a leaf), cut, left child (the right one is the next),
    and for leaves the depth with what the rows left in it would add."""
    feature, cut, child, depth = [-1], [0.0], [0], [0.0]
    most = math.ceil(math.log2(max(len(x), 2)))
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        at, rows, d = todo.pop()
        lo, hi = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
        wide = np.flatnonzero(hi > lo)
        if d >= most or not len(wide):
            depth[at] = d + _usual_depth(len(rows))
            continue
        f = int(rng.choice(wide))
        c = rng.uniform(lo[f], hi[f])
        feature[at], cut[at], child[at] = f, c, len(feature)
        left = x[rows, f] < c
        for side in (rows[left], rows[~left]):
            todo.append((len(feature), side, d + 1))
            feature.append(-1), cut.append(0.0), child.append(0), depth.append(0.0)
    return np.array(feature), np.array(cut), np.array(child), np.array(depth)


def fit(df: DataFrame, cols: Sequence[str], key: str, trees: int = TREES, rows: int = ROWS, seed: int = 1) -> tuple[list, float]:
    """(trees, usual depth). Grown on a sample of at most DRAWN rows, those of the least seeded
    hash of `key`: the bound is the method's own, however many rows there are, and its sample
    is all the driver sees. Null, NaN and infinite values are 0."""
    clean = [F.coalesce(C.finite(c), F.lit(0.0)).alias(f"__x{i}") for i, c in enumerate(cols)]
    x = df.select(F.xxhash64(key, F.lit(seed)).alias("__h"), *clean).orderBy("__h", *[f"__x{i}" for i in range(len(cols))]).limit(min(DRAWN, trees * rows)).toPandas().drop(columns="__h").to_numpy(np.float64)
    rng = np.random.default_rng(seed)
    n = min(rows, len(x))
    return [grow(x[rng.choice(len(x), n, replace=False)], rng) for _ in range(trees)] if n else [], _usual_depth(n)


def scores(df: DataFrame, cols: Sequence[str], key: str, model: tuple[list, float]) -> DataFrame:
    """key, score from 0 to 1: 2^(-depth / usual depth), about 0.5 for usual rows and near 1 for odd
    ones, for every row of `df`, where it is. Without trees scores are null."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    clean = [F.coalesce(C.finite(c), F.lit(0.0)).alias(f"__x{i}") for i, c in enumerate(cols)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, usual = shared.value
        for b in batches:
            x = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(cols))]) if b.num_rows else np.zeros((0, len(cols)))
            total, every = np.zeros(len(x)), np.arange(len(x))
            for feature, cut, child, depth in forest:
                at = np.zeros(len(x), np.int64)
                while (inner := feature[at] >= 0).any():
                    go = every[inner]
                    here = at[go]
                    at[go] = child[here] + (x[go, feature[here]] >= cut[here])
                total += depth[at]
            s = 2.0 ** (-total / len(forest) / usual) if forest and usual else np.full(len(x), np.nan)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, mask=np.isnan(s))], names=[key, "score"])

    return df.select(key, *clean).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, score double")
