"""Anomaly scores from histograms of sparse random projections: fitted, stored, scored, explained."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans.durable import written
from emberline.sources import sinks

#: Bins there may be, and entries of all histograms together that are sent to every task; larger
#: histograms are joined instead.
MOST_BINS, MOST_SENT = 1_000_000, 4_000_000
FLOOR = 1e-12


def sparse_cuts(dim: int, cuts: int, seed: int = 1) -> np.ndarray:
    """Sparse Gaussian directions: each with floor(sqrt(dim)) coordinates that aren't 0."""
    rng = np.random.default_rng(seed)
    w = np.zeros((cuts, dim))
    for row in w:
        on = rng.choice(dim, max(1, math.isqrt(dim)), replace=False)
        row[on] = rng.standard_normal(len(on))
    return w


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that can be used, their vectors): a null vector, one of another length and one with
    a null or NaN coordinate can't."""
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    off = column.offsets.to_numpy()
    rows = rows[off[rows + 1] - off[rows] == dim]
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat[off[rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    ok = ~np.isnan(m).any(1)
    return rows[ok], m[ok]


def _bins(p: np.ndarray, lo: np.ndarray, hi: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each projection; values beyond the fitted range go to the outermost bins."""
    width = np.where(hi > lo, hi - lo, 1.0)
    return np.clip(np.floor((p - lo) * bins / width), 0, bins - 1).astype(np.int64)


class Loda:
    """Fitted histograms. `shares` has cut, bin, share of the bins that held rows."""

    def __init__(self, cuts: np.ndarray, lo: np.ndarray, hi: np.ndarray, bins: int, n: int, shares: DataFrame):
        self.cuts, self.lo, self.hi, self.bins, self.n, self.shares = cuts, lo, hi, bins, n, shares

    def save(self, path: str) -> None:
        meta = {"cuts": self.cuts.tolist(), "lo": self.lo.tolist(), "hi": self.hi.tolist(), "bins": self.bins, "n": self.n}
        sinks.save_table_model(self.shares.sparkSession, path, meta, shares=self.shares)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Loda:
        meta, tables = sinks.load_table_model(spark, path, "shares")
        return Loda(*(np.array(meta[k], np.float64) for k in ("cuts", "lo", "hi")), meta["bins"], meta["n"], tables["shares"])

    def _mapped(self, df: DataFrame, key: str, vec: str, schema: str, names: list[str], work: Callable[[np.ndarray], list[pa.Array]]) -> DataFrame:
        """`key` and what `work` makes of the rows' scores per cut (-ln of the bin's share), in place."""
        table = np.full((len(self.cuts), self.bins), FLOOR)
        t = self.shares.toPandas()  # at most MOST_SENT rows
        table[t["cut"].to_numpy(), t["bin"].to_numpy()] += t["share"].to_numpy()
        shared = df.sparkSession.sparkContext.broadcast((self.cuts.T.copy(), self.lo, self.hi, -np.log(table)))
        bins, dim = self.bins, self.cuts.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, lo, hi, score = shared.value
            cut = np.arange(len(lo))
            for b in batches:
                for first in range(0, b.num_rows, 1_000):
                    part = b.slice(first, 1_000)
                    rows, m = _matrix(pa.concat_arrays([part.column(1)]), dim)
                    s = score[cut, _bins(m @ w, lo, hi, bins)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), *work(s)], names=[key, *names])

        return df.select(key, vec).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {schema}")

    def _joined(self, df: DataFrame, key: str, vec: str) -> DataFrame:
        """key, cut, s by a join with the histograms, for any size of them."""
        rows = _binned(df, [key], vec, self.cuts, self.lo, self.hi, self.bins)
        return rows.join(self.shares, ["cut", "bin"], "left").select(key, "cut", (-F.log(F.coalesce("share", F.lit(0.0)) + FLOOR)).alias("s"))

    @property
    def sent(self) -> bool:
        return len(self.cuts) * self.bins <= MOST_SENT

    def score(self, df: DataFrame, key: str, vec: str) -> DataFrame:
        """key, score: mean over the cuts of -ln of the share of the row's bin (+1e-12), once more
        divided by the number of cuts. Rows whose vector can't be used have no score.

        Histograms of bounded size are sent to the tasks, and rows are scored where they are."""
        k = len(self.cuts)
        if self.sent:
            return self._mapped(df, key, vec, "score double", ["score"], lambda s: [pa.array(s.sum(1) / k**2)])
        return self._joined(df, key, vec).groupBy(key).agg((F.sum("s") / k**2).alias("score"))

    def explain(self, df: DataFrame, key: str, vec: str) -> DataFrame:
        """key, feature, t: Welch's t between the scores of the cuts that use a feature and of
        those that don't; large where the feature makes the row stand out. Null with fewer than
        two cuts on a side, or without any variance."""
        use = (self.cuts != 0).astype(np.float64)
        n, k = use.sum(0), len(self.cuts)

        def t(s: np.ndarray) -> np.ndarray:
            mean = s.mean(1, keepdims=True)
            c = s - mean  # about the mean, so that squares don't swallow the variance
            a, aa = c @ use, (c * c) @ use
            b, bb = -a, (c * c).sum(1, keepdims=True) - aa
            with np.errstate(all="ignore"):
                va, vb = (aa - a * a / n) / (n - 1), (bb - b * b / (k - n)) / (k - n - 1)
                out = (a / n - b / (k - n)) / np.sqrt(np.maximum(va, 0) / n + np.maximum(vb, 0) / (k - n))
            return np.where((n > 1) & (k - n > 1) & np.isfinite(out), out, np.nan)

        if self.sent:
            def lists(s: np.ndarray) -> list[pa.Array]:
                v = t(s)
                return [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel(), mask=np.isnan(v.ravel())))]

            wide = self._mapped(df, key, vec, "t array<double>", ["t"], lists)
            return wide.select(key, F.posexplode("t").alias("feature", "t"))
        # the same sums per row and feature, from rows of (key, cut)
        uses = F.from_json(F.lit(str([np.flatnonzero(c).tolist() for c in use])), "array<array<int>>")
        rows = self._joined(df, key, vec)
        total = rows.groupBy(key).agg(F.sum("s").alias("ts"), F.sum(F.col("s") * F.col("s")).alias("tss"))
        per = rows.select(key, "s", F.explode(F.get(uses, F.col("cut"))).alias("feature")).groupBy(key, "feature").agg(F.count("*").alias("n"), F.sum("s").alias("a"), F.sum(F.col("s") * F.col("s")).alias("aa"))
        every = total.withColumn("feature", F.explode(F.sequence(F.lit(0), F.lit(use.shape[1] - 1))))
        j = every.join(per, [key, "feature"], "left").na.fill(0, ["n", "a", "aa"]).withColumns({"m": F.lit(k) - F.col("n"), "b": F.col("ts") - F.col("a"), "bb": F.col("tss") - F.col("aa")})
        var = lambda s, ss, c: F.greatest(F.try_divide(F.col(ss) - F.try_divide(F.col(s) * F.col(s), F.col(c)), F.col(c) - 1.0), F.lit(0.0))
        welch = F.try_divide(F.try_divide("a", "n") - F.try_divide("b", "m"), F.sqrt(F.try_divide(var("a", "aa", "n"), F.col("n")) + F.try_divide(var("b", "bb", "m"), F.col("m"))))
        return j.select(key, "feature", F.when((F.col("n") > 1) & (F.col("m") > 1), welch).alias("t"))


def _projected(df: DataFrame, keys: Sequence[str], vec: str, cuts: np.ndarray) -> DataFrame:
    """keys and p, the array of the row's projections; rows that can't be used drop out."""
    shared = df.sparkSession.sparkContext.broadcast(cuts.T.copy())
    m, dim = len(keys), cuts.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 1_000):
                part = b.slice(first, 1_000)
                rows, x = _matrix(pa.concat_arrays([part.column(m)]), dim)
                p = x @ shared.value
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(pa.array(rows)) for i in range(m)], lists], names=[*keys, "p"])

    return df.select(*keys, vec).mapInArrow(run, ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys], "p array<double>"]))


def _binned(df: DataFrame, keys: Sequence[str], vec: str, cuts: np.ndarray, lo: np.ndarray, hi: np.ndarray, bins: int) -> DataFrame:
    """keys, cut, bin of every usable row and cut."""
    limits = F.array(*[F.lit(float(x)) for x in lo]), F.array(*[F.lit(float(x)) for x in hi])
    rows = _projected(df, keys, vec, cuts).select(*keys, F.posexplode("p").alias("cut", "p"))
    a, b = (F.get(x, F.col("cut")) for x in limits)
    at = F.floor(F.coalesce(F.try_divide((F.col("p") - a) * bins, b - a), F.lit(0.0)))
    return rows.select(*keys, "cut", F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))


def fit(df: DataFrame, vec: str, cuts: np.ndarray, bins: int | None = None) -> Loda:
    """Histograms of the usable rows' projections: per cut `bins` bins of equal width over the
    range. Bins default to floor(n / ln n), at most MOST_BINS, n counting usable rows only.
    Without usable rows every share is 0.

    Two passes over the rows: their number and the range of each cut (one row per cut), then
    the number of rows per cut and bin, combined in each task before the shuffle."""
    cuts = np.asarray(cuts, np.float64)
    span = _projected(df, [], vec, cuts).select(F.posexplode("p").alias("cut", "p")).groupBy("cut").agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).collect()
    lo, hi = np.zeros(len(cuts)), np.zeros(len(cuts))
    for r in span:
        lo[r.cut], hi[r.cut] = r.lo, r.hi
    n = span[0].n if span else 0
    bins = bins or max(1, min(MOST_BINS, int(n / math.log(n)) if n > 2 else 1))
    counts = _binned(df, [], vec, cuts, lo, hi, bins).groupBy("cut", "bin").agg((F.count("*") / float(max(n, 1))).alias("share"))
    return Loda(cuts, lo, hi, bins, n, written(counts))
