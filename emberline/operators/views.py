"""Plane views of vectors by t-SNE, for pictures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a view is laid out from, and neighbours that place the others.
MOST, NEAR = 500, 5


def _affinities(x: np.ndarray, perplexity: float) -> np.ndarray:
    """Symmetric neighbour probabilities; each row's width gives the wanted perplexity."""
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    lo, hi, beta = np.zeros(len(x)), np.full(len(x), np.inf), np.ones(len(x)) / max(np.median(d[np.isfinite(d)]), 1e-12)
    for _ in range(60):
        p = np.exp(-(d - d.min(1, keepdims=True)) * beta[:, None])
        p /= p.sum(1, keepdims=True)
        entropy = -np.where(p > 0, p * np.log(np.maximum(p, 1e-300)), 0).sum(1)
        wide = entropy > np.log(perplexity)
        lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    return (p + p.T) / (2 * len(x))


def layout(x: np.ndarray, perplexity: float = 30.0, steps: int = 350, seed: int = 1) -> np.ndarray:
    """Places in the plane by gradient descent on the divergence of neighbour probabilities."""
    n = len(x)
    if n < 3:
        return np.column_stack([np.arange(n, dtype=float), np.zeros(n)])
    p = np.maximum(_affinities(x, min(perplexity, (n - 1) / 3)), 1e-12)
    y, move, gain = np.random.default_rng(seed).normal(0, 1e-2, (n, 2)), np.zeros((n, 2)), np.ones((n, 2))
    for step in range(steps):
        w = 1 / (1 + ((y[:, None] - y) ** 2).sum(2))
        np.fill_diagonal(w, 0)
        f = ((12.0 if step < 100 else 1.0) * p - np.maximum(w / w.sum(), 1e-12)) * w
        slope = 4 * (f.sum(1)[:, None] * y - f @ y)
        gain = np.maximum(np.where(np.sign(slope) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = (0.5 if step < 100 else 0.8) * move - max(n / 12, 50.0) * gain * slope
        y = y + move - (y + move).mean(0)
    return y


def tsne(df: DataFrame, key: str, vec: str, perplexity: float = 30.0, most: int = MOST, seed: int = 1) -> DataFrame:
    """key, x, y of every row with a vector without nulls and NaN.

    At most `most` rows, those of the least seeded hash, are laid out by t-SNE on the driver,
    which takes every pair of them; each other row goes to the mean place of its NEAR nearest
    among them, where it is. A view shows who lies near whom, its distances mean nothing."""
    ok = df.where(F.col(vec).isNotNull() & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v.cast("double")))).select(key, F.transform(vec, lambda v: v.cast("double")).alias("__v"))
    drawn = ok.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(most).toPandas()
    x = np.stack(drawn["__v"].map(np.asarray)) if len(drawn) else np.zeros((0, 1))
    shared = df.sparkSession.sparkContext.broadcast((x, layout(x, perplexity, seed=seed)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = shared.value
        for b in batches:
            v = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            d = (v * v).sum(1)[:, None] - 2 * v @ x.T + (x * x).sum(1)
            near = np.argsort(d, 1, kind="stable")[:, :NEAR]
            own = d[np.arange(len(v)), near[:, 0]] <= 1e-9 * (1 + (v * v).sum(1))  # a drawn row keeps its place
            at = np.where(own[:, None], y[near[:, 0]], y[near].mean(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at[:, 0]), pa.array(at[:, 1])], names=[key, "x", "y"])

    return ok.mapInArrow(place, f"`{key}` {df.schema[key].dataType.simpleString()}, x double, y double")
