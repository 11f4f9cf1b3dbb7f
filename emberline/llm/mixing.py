"""Mixing sources to target weights by balanced sampling with the cube method.

For a mixture of N tokens, source s with share w and T tokens at hand needs w*N/T copies of
each of its documents: the whole part for all of them, the fraction as an inclusion
probability. The cube method turns the fractions into 0 and 1 while it keeps two totals, the
number of documents and the number of tokens: three undecided documents at a time move along
the null space of the two constraints until one of them is decided (flight). Three short ones
can't make up for a long one, so long documents go first, each against all that are undecided;
then the others by falling length. Blocks of documents fly in parallel and each leaves at most
two undecided; these fly again in fewer blocks, until one block per source is left.

That last block keeps LANDING documents of well-spaced lengths out of the flight and decides
them together with the two that the flight leaves. Of the ways to decide them that keep the
number of documents to within one, those that miss the token total by least, or by no more
than half the shortest document, are weighed by their probability under the documents'
fractions, and one is drawn.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.plans.durable import written

EPS = 1e-9
#: Documents of one flight. Which documents are chosen depends on it: with other blocks other
#: triples fly together. The totals hold for any.
BLOCK = 20_000
#: A document of more than so many mean lengths of the undecided flies against all of them.
LONG = 2.0
#: Documents of a source kept for landing, and how many of them are the shortest there are.
LANDING, SHORTEST = 32, 4


def mixture_size(tokens: Mapping[str, float], share: Mapping[str, float], repeats: Mapping[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens that each source gives.

    Without `total`: the largest mixture in which every source that has documents makes up its
    share of what the present sources together are meant to be. With `total`: sources that
    would exceed their cap give the cap, the rest is shared out by weight among the others.
    A source without tokens, without a positive share or without repeats gives 0.
    """
    cap = {s: tokens.get(s, 0) * max(int(repeats.get(s) or 0), 0) for s in share}
    live = {s: float(w) for s, w in share.items() if w and w > 0 and cap[s] > 0}
    if not live:
        return {s: 0.0 for s in share}
    weight = sum(live.values())
    if total is None:
        total = min(cap[s] / w for s, w in live.items()) * weight
    give, left, open_ = {}, float(total), dict(live)
    while open_:
        weight = sum(open_.values())
        over = [s for s, w in open_.items() if left * w / weight > cap[s] * (1 + 1e-12)]
        if not over:
            give |= {s: left * w / weight for s, w in open_.items()}
            break
        for s in over:
            give[s] = cap[s]
            left -= cap[s]
            del open_[s]
    return {s: give.get(s, 0.0) for s in share}


def long_flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the long documents' flight; `size` falls. The longest undecided one
    moves along its projection onto the null space of the two totals over all undecided, so
    that a long document shifts many short ones by little, until none is long."""
    p = prob.copy()
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    while len(open_) > 3 and size[open_[0]] > LONG * size[open_].mean():
        q, c = p[open_], size[open_] - size[open_].mean()
        u = -1 / len(open_) - c * (c[0] / (c @ c))
        u[0] += 1
        up = np.min(np.where(u > 0, 1 - q, q)[u != 0] / np.abs(u[u != 0]))
        down = np.min(np.where(u > 0, q, 1 - q)[u != 0] / np.abs(u[u != 0]))
        q = q + u * (up if rng.random() * (up + down) < down else -down)
        p[open_] = np.where(q < EPS, 0.0, np.where(q > 1 - EPS, 1.0, q))
        open_ = open_[(q >= EPS) & (q <= 1 - EPS)]
    return p


def flight(prob: list[float], size: list[float], draws: np.ndarray) -> list[float]:
    """Probabilities after the flight: all but two at most are 0 or 1; sums of probabilities
    and of probability times size stay as they were."""
    p, active, used = list(prob), [], 0
    for nxt in range(len(p)):
        if not EPS < p[nxt] < 1 - EPS:
            p[nxt] = float(round(p[nxt]))
            continue
        active.append(nxt)
        if len(active) < 3:
            continue
        i, j, k = active
        u = (size[k] - size[j], size[i] - size[k], size[j] - size[i])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[a]) / v if v > 0 else p[a] / -v for a, v in zip(active, u) if v)
        down = min(p[a] / v if v > 0 else (1 - p[a]) / -v for a, v in zip(active, u) if v)
        step = up if draws[used] * (up + down) < down else -down
        used += 1
        for a, v in zip(active, u):
            q = p[a] + step * v
            p[a] = 0.0 if q < EPS else 1.0 if q > 1 - EPS else q
        active = [a for a in active if 0 < p[a] < 1]
    return p


def reserve(size: list[float], undecided: list[int], n: int = LANDING) -> list[int]:
    """Of the `undecided`, at most n kept for landing: the shortest, and then always the longest
    that is no longer than those kept so far together (if there is none, the shortest longer
    one), so that their sums leave no gaps."""
    rest = sorted(undecided, key=lambda i: (size[i], i))
    kept, total = rest[:SHORTEST], sum(size[i] for i in rest[:SHORTEST])
    rest = rest[SHORTEST:]
    lengths = [size[i] for i in rest]
    while rest and len(kept) < n:
        at = bisect.bisect_right(lengths, total + 1) - 1
        if at < 0 or lengths[at] <= 0:
            at = min(bisect.bisect_right(lengths, max(total, 0)), len(rest) - 1)
        total += lengths.pop(at)
        kept.append(rest.pop(at))
    return kept


def landing(prob: list[float], size: list[float], rng: np.random.Generator) -> list[float]:
    """0 or 1 for the few that are left, see the head of the module.

    The documents are split into two halves; for each way to decide the first half, the nearest
    ways for the second are found among those of the fitting number by binary search."""
    m = len(prob)
    if not m:
        return []
    order = rng.permutation(m)  # equal documents land alike
    p, s = np.clip(np.array(prob)[order], EPS, 1 - EPS), np.array(size, float)[order]
    sides = []
    for q, t in ((p[: m // 2], s[: m // 2]), (p[m // 2 :], s[m // 2 :])):
        ways = (np.arange(2 ** len(q))[:, None] >> np.arange(len(q))) & 1
        sides.append((ways, ways.sum(1), ways @ t, np.log(np.where(ways == 1, q, 1 - q)).sum(1)))
    (_, n1, t1, w1), (_, n2, t2, w2) = sides
    docs, goal = p.sum(), p @ s
    found = []
    for n in {math.floor(docs), math.ceil(docs)}:
        for k in range(m - m // 2 + 1):
            a, b = np.flatnonzero(n1 == n - k), np.flatnonzero(n2 == k)
            if len(a) and len(b):
                b = b[np.argsort(t2[b], kind="stable")]
                at = np.searchsorted(t2[b], goal - t1[a])
                found += [(a, b[np.clip(at - 1, 0, len(b) - 1)]), (a, b[np.clip(at, 0, len(b) - 1)])]
    a, b = (np.concatenate(x) for x in zip(*found))
    miss = np.abs(t1[a] + t2[b] - goal)
    good = np.flatnonzero(miss <= max(miss.min() + EPS, s.min() / 2))
    weight = w1[a[good]] + w2[b[good]]
    share = np.cumsum(np.exp(weight - weight.max()))
    got = good[min(np.searchsorted(share, rng.random() * share[-1], "right"), len(good) - 1)]
    out = np.empty(m)
    out[order] = np.concatenate([sides[0][0][a[got]], sides[1][0][b[got]]])
    return out.tolist()


def _fly(seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id"], ascending=[False, True], ignore_index=True)  # short ones stay open longest
        source, block = pdf["source"].iloc[0], int(pdf["block"].iloc[0])
        rng = np.random.default_rng([seed, zlib.crc32(source.encode()), block])
        size, p = pdf["n_tokens"].astype(float).tolist(), pdf["prob"].tolist()
        kept = set(reserve(size, [i for i, x in enumerate(p) if EPS < x < 1 - EPS])) if last else set()
        flying = [i for i in range(len(p)) if i not in kept]
        flown = long_flight(np.array([p[i] for i in flying]), np.array([size[i] for i in flying]), rng)
        for i, x in zip(flying, flight(flown.tolist(), [size[i] for i in flying], rng.random(len(p)))):
            p[i] = x
        if last:
            rest = [i for i, x in enumerate(p) if 0 < x < 1]
            for i, x in zip(rest, landing([p[i] for i in rest], [size[i] for i in rest], rng)):
                p[i] = x
        return pdf.assign(prob=p)[["doc_id", "source", "n_tokens", "prob", "block"]]

    return run


def balanced_sample(docs: DataFrame, rows: Mapping[str, int], seed: int = 7, block: int = BLOCK) -> DataFrame:
    """Decides the inclusion probabilities of `docs` (doc_id, source, n_tokens, prob).

    `rows` gives the documents of each source, to size the blocks; a source with most of the
    documents simply has more blocks. Result: doc_id, source, n_tokens, prob in {0, 1}.
    The result depends on the rows and the seed only, not on partitions.
    """
    spark = docs.sparkSession
    blocks = {s: max(1, math.ceil(n / block)) for s, n in rows.items()}
    out: list[DataFrame] = []
    state = docs
    first = True
    while True:
        table = spark.createDataFrame([(s, b) for s, b in blocks.items()], "source string, blocks int")  # as long as the list of sources
        spread = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")) if first else F.pmod(F.col("block"), F.col("blocks"))
        state = state.join(F.broadcast(table), "source").withColumn("block", spread.cast("int")).select("doc_id", "source", "n_tokens", "prob", "block")
        last = all(b == 1 for b in blocks.values())
        flown = written(state.groupBy("source", "block").applyInPandas(_fly(seed, last), "doc_id bigint, source string, n_tokens bigint, prob double, block int"))
        if last:
            out.append(flown)
            break
        decided = (F.col("prob") == 0) | (F.col("prob") == 1)
        out.append(flown.where(decided))
        state, first = flown.where(~decided), False
        blocks = {s: max(1, math.ceil(2 * b / block)) for s, b in blocks.items()}
    got = out[0]
    for d in out[1:]:
        got = got.union(d)
    return got.select("doc_id", "source", "n_tokens", "prob")


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7) -> tuple[DataFrame, list[dict]]:
    """The mixture and its report.

    `docs`: doc_id, source, n_tokens; a null source or one that `targets` doesn't list takes no
    part. `targets`: source, target_share, max_repeats, a short list (one row per source;
    rows with a null source are left out, of repeated ones the first by share counts).
    Returns the chosen documents (doc_id, source, n_tokens, copies >= 1) and one record per
    target: source, target_share, max_repeats, n_docs, n_tokens, goal_tokens, copies a document.
    """
    spec = {}
    for r in targets.where("source IS NOT NULL").select("source", "target_share", "max_repeats").orderBy("source", F.desc("target_share")).collect():
        spec.setdefault(r.source, r)
    names = docs.sparkSession.createDataFrame([(s,) for s in spec] or [("",)], "source string")
    docs = docs.join(F.broadcast(names), "source", "left_semi")  # as long as the list of targets
    have = {r.source: r for r in docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    tokens = {s: (have[s].t or 0) if s in have else 0 for s in spec}
    give = mixture_size(tokens, {s: r.target_share or 0.0 for s, r in spec.items()}, {s: r.max_repeats or 0 for s, r in spec.items()}, total)
    report = []
    for s, r in spec.items():
        each = min(give[s] / tokens[s], float(r.max_repeats or 0)) if tokens[s] else 0.0
        whole = math.floor(each + EPS)
        report.append({"source": s, "target_share": r.target_share, "max_repeats": r.max_repeats, "n_docs": have[s].n if s in have else 0, "n_tokens": tokens[s], "goal_tokens": give[s], "each": each, "whole": whole, "prob": max(0.0, each - whole)})
    plan = docs.sparkSession.createDataFrame([(x["source"], x["whole"], float(x["prob"])) for x in report] or [("", 0, 0.0)], "source string, whole int, prob double")
    sampled = balanced_sample(docs.join(F.broadcast(plan.select("source", "prob")), "source").select("doc_id", "source", "n_tokens", "prob"), {x["source"]: x["n_docs"] for x in report}, seed)
    copies = sampled.join(F.broadcast(plan.select("source", "whole")), "source").withColumn("copies", (F.col("whole") + F.col("prob")).cast("int"))
    return copies.where("copies > 0").select("doc_id", "source", "n_tokens", "copies"), report
