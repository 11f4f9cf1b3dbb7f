"""Evaluation of scores, labels and clusterings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from emberline.functions import clean as C
from emberline.operators.sequences import prefix_sums


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1 of 0/1 columns; undefined ones are null."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    one = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    return one.select("*", C.div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"), C.div("tp", F.col("tp") + F.col("fp")).alias("precision"), C.div("tp", F.col("tp") + F.col("fn")).alias("recall"), C.div(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn")).alias("f1"))


def multiclass(df: DataFrame, label: str, pred: str) -> DataFrame:
    """average (micro, macro, weighted), precision, recall, f1; an undefined class value counts as 0."""
    pairs = df.groupBy(F.col(label).alias("y"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    by = pairs.select(F.explode(F.array(F.struct(F.col("y").alias("c"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("q"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("t")), F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("q"), F.lit(0).cast("bigint").alias("t")))).alias("x")).select("x.*")
    by = by.groupBy("c").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("t").alias("t"))
    z = F.lit(0.0)
    by = by.select("*", F.coalesce(C.div("t", "q"), z).alias("pr"), F.coalesce(C.div("t", "s"), z).alias("re"), F.coalesce(C.div(F.col("t") * 2, F.col("s") + F.col("q")), z).alias("f"))
    one = by.agg(*[F.avg(c).alias(f"m_{c}") for c in ("pr", "re", "f")], *[F.try_divide(F.sum(F.col(c) * F.col("s")), F.sum("s").cast("double")).alias(f"w_{c}") for c in ("pr", "re", "f")], C.div(F.sum("t"), F.sum("s")).alias("acc"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("average"), F.col(x).alias("precision"), F.col(y).alias("recall"), F.col(f).alias("f1")) for a, x, y, f in (("micro", "acc", "acc", "acc"), ("macro", "m_pr", "m_re", "m_f"), ("weighted", "w_pr", "w_re", "w_f"))])))


def score_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """score, pos, neg, tp, fp: for each different score the rows at it and at or above it.

    Rows are counted per score first, so the running totals run over scores, in range
    partitions with offsets; no task sorts all rows."""
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    return prefix_sums(per, [F.desc("score")], {"tp": "pos", "fp": "neg"})


def roc_auc(curve: DataFrame) -> DataFrame:
    """n_pos, n_neg, auc by rank sums, a tie counting half; null with one class only."""
    one = curve.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") / 2).alias("s"))
    return one.select("n_pos", "n_neg", C.div("s", F.col("n_pos") * F.col("n_neg")).alias("auc"))


def average_precision(curve: DataFrame) -> DataFrame:
    one = curve.agg(F.sum("pos").alias("n_pos"), F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("s"))
    return one.select("n_pos", C.div("s", "n_pos").alias("average_precision"))


def youden(curve: DataFrame) -> DataFrame:
    """threshold, j: the highest score with the largest tpr - fpr."""
    total = curve.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    j = curve.crossJoin(F.broadcast(total)).select("score", F.round(C.div("tp", "p") - C.div("fp", "q"), 9).alias("j"))  # one row
    return j.where("j IS NOT NULL").agg(F.max(F.struct("j", "score")).alias("x")).select(F.col("x.score").alias("threshold"), "x.j").where("threshold IS NOT NULL")


def threshold_sweep(df: DataFrame, label: str, score: str, ratio: float, steps: int = 100) -> DataFrame:
    """threshold (i/steps), tp, fp, fn, recall, precision as it would be at `ratio` positives per negative.

    A row is counted once, in the last step it passes; counts per step then add up from above."""
    step = F.least(F.floor(F.round(F.col(score) * steps, 9)).cast("int"), F.lit(steps - 1))
    per = df.where(F.col(score).isNotNull()).groupBy(step.alias("i")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("q"))
    spark = df.sparkSession
    grid = spark.range(steps).select(F.col("id").cast("int").alias("i")).join(per, "i", "left").na.fill(0)
    up = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over `steps` rows
    every = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = grid.select("i", F.sum("p").over(up).alias("tp"), F.sum("q").over(up).alias("fp"), F.sum("p").over(every).alias("n_pos"), F.sum("q").over(every).alias("n_neg"))
    rec = C.div("tp", "n_pos")
    adj = F.lit(ratio) * F.col("n_neg") * rec
    return c.select((F.col("i") / float(steps)).alias("threshold"), "tp", "fp", (F.col("n_pos") - F.col("tp")).alias("fn"), rec.alias("recall"), F.try_divide(adj, adj + F.col("fp")).alias("precision"))


def precision_at_k(df: DataFrame, day: str, who: str, score: str, label: str, k: int) -> DataFrame:
    """day, precision: share of labelled among the k entities of the day with the highest maximum score."""
    top = df.groupBy(day, who).agg(F.max(score).alias("s"), F.max(F.col(label).cast("int")).alias("y"))
    r = F.row_number().over(Window.partitionBy(day).orderBy(F.desc("s"), who))
    return top.withColumn("r", r).where(F.col("r") <= k).groupBy(day).agg(F.avg("y").alias("precision"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight: rows over the class's rows, scaled to sum to 1."""
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum(1 / F.col("n")).alias("s"))
    return n.crossJoin(F.broadcast(total)).select(label, "n", (1 / F.col("n") / F.col("s")).alias("weight"))  # one row


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, nmi (arithmetic mean), ari of two labelings, from their contingency table.

    Two labelings that are both all one class, or both all different, agree fully: ari 1."""
    t = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    ra, rb = t.groupBy(a).agg(F.sum("n").alias("r")), t.groupBy(b).agg(F.sum("n").alias("c"))
    n_all = t.agg(F.sum("n").alias("n"))
    d = lambda c: F.col(c).cast("double")
    x = t.agg(F.sum(d("n") * F.log("n")).alias("xln"), F.sum(d("n") * (d("n") - 1) / 2).alias("pairs"))
    p = ra.agg(F.sum(d("r") * F.log("r")).alias("rln"), F.sum(d("r") * (d("r") - 1) / 2).alias("pr"))
    q = rb.agg(F.sum(d("c") * F.log("c")).alias("cln"), F.sum(d("c") * (d("c") - 1) / 2).alias("pc"))
    one = n_all.crossJoin(x).crossJoin(p).crossJoin(q)  # single rows
    n, ln = d("n"), F.log(d("n"))
    ha, hb = ln - F.col("rln") / n, ln - F.col("cln") / n
    mi = F.col("xln") / n - F.col("rln") / n - F.col("cln") / n + ln
    want = F.try_divide(F.col("pr") * F.col("pc"), n * (n - 1) / 2)
    return one.select("n", F.try_divide(mi, (ha + hb) / 2).alias("nmi"), F.coalesce(F.try_divide(F.col("pairs") - want, (F.col("pr") + F.col("pc")) / 2 - want), F.when(n > 0, F.lit(1.0))).alias("ari"))


#: Labels or clusters that an assignment may have.
MOST_CLASSES = 1_000


def silhouette(df: DataFrame, key: str, vec: str, cluster: str, asked: Column, metric: str = "l2") -> DataFrame:
    """key, cluster, a, b, silhouette of the rows where `asked` holds, against all rows: the mean
    distance a to its own cluster's other rows, the least mean distance b to another cluster's,
    and (b - a) / max(a, b). 0 for a row alone in its cluster, null with one cluster only.

    `metric` is l1, l2 or cosine (distance 1 - similarity). The asked rows (at most MOST_ASKED,
    more raise) go to every task; a task adds up their distances by cluster, so what is
    shuffled is one row per asked row, cluster and task, never a pair of rows."""
    rows = df.where(F.col(vec).isNotNull() & F.col(cluster).isNotNull())
    q = rows.where(asked).select(key, cluster, F.transform(vec, lambda x: x.cast("double")).alias("v")).limit(MOST_ASKED + 1).toPandas()
    if len(q) > MOST_ASKED:
        raise ValueError(f"more than {MOST_ASKED} rows are asked for")
    spark = df.sparkSession
    key_type, cluster_type = (df.schema[c].dataType.simpleString() for c in (key, cluster))
    table = spark.createDataFrame([(i, k, c) for i, (k, c) in enumerate(zip(q[key].tolist(), q[cluster].tolist()))], f"q int, `{key}` {key_type}, `{cluster}` {cluster_type}")
    shared = spark.sparkContext.broadcast(np.stack([np.asarray(v, np.float64) for v in q["v"]]) if len(q) else np.zeros((0, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        sums: dict = {}
        for b in batches:
            if not b.num_rows or not len(asked):
                continue
            x = np.stack([np.asarray(v, np.float64) for v in b.column(1).to_pylist()])
            labels = b.column(0).dictionary_encode()
            code = labels.indices.to_numpy(zero_copy_only=False)
            for lo in range(0, len(x), 256):
                y = x[lo : lo + 256]
                if metric == "cosine":
                    n = np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(y, axis=1)
                    d = 1 - np.divide(asked @ y.T, n, out=np.zeros((len(asked), len(y))), where=n > 0)
                elif metric == "l1":
                    d = np.abs(asked[:, None] - y).sum(2)
                else:
                    d = np.sqrt(((asked[:, None] - y) ** 2).sum(2))
                for c in np.unique(code[lo : lo + 256]):
                    on = code[lo : lo + 256] == c
                    have = sums.setdefault(labels.dictionary[int(c)].as_py(), [np.zeros(len(asked)), 0])
                    have[0] += d[:, on].sum(1)
                    have[1] += int(on.sum())
        for c, (d, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(d), dtype=np.int32)), pa.array([c] * len(d), kind), pa.array(d), pa.array(np.full(len(d), n, np.int64))], names=["q", "other", "d", "n"])

    kind = to_arrow_type(df.schema[cluster].dataType)
    per = rows.select(cluster, vec).mapInArrow(run, f"q int, other {cluster_type}, d double, n bigint").groupBy("q", "other").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    own = F.col("other") == F.col(cluster)
    j = per.join(F.broadcast(table), "q").groupBy("q", key, cluster).agg(F.max(F.when(own, F.try_divide("d", F.col("n") - 1))).alias("a"), F.max(F.when(own, F.col("n"))).alias("__n"), F.min(F.when(~own, F.try_divide("d", "n"))).alias("b"))
    s = F.when(F.col("b").isNull(), None).when(F.col("__n") == 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return j.select(key, cluster, "a", "b", s.alias("silhouette"))


#: Rows whose silhouette can be asked for at once.
MOST_ASKED = 20_000


def matched_accuracy(df: DataFrame, truth: str, cluster: str) -> float | None:
    """Accuracy under the best one-to-one assignment of clusters to labels (Hungarian method on
    the contingency table). None without rows; more than MOST_CLASSES labels or clusters raise,
    as the assignment is solved by the driver."""
    pairs = df.where(F.col(truth).isNotNull() & F.col(cluster).isNotNull()).groupBy(truth, cluster).count()
    sizes = pairs.agg(F.count_distinct(truth).alias("a"), F.count_distinct(cluster).alias("b")).first()
    if max(sizes.a, sizes.b) > MOST_CLASSES:
        raise ValueError(f"{sizes.a} labels and {sizes.b} clusters are more than {MOST_CLASSES}")
    t = pairs.collect()
    if not t:
        return None
    rows, cols = sorted({r[0] for r in t}), sorted({r[1] for r in t})
    n = max(len(rows), len(cols))
    cost = [[0.0] * n for _ in range(n)]
    for r in t:
        cost[rows.index(r[0])][cols.index(r[1])] = -float(r[2])
    return -_assign(cost) / sum(r[2] for r in t)


def _assign(cost: list[list[float]]) -> float:
    """Least total of a square assignment by shortest augmenting paths."""
    n, inf = len(cost), float("inf")
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = [inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], inf, 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not match[j0]:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return sum(cost[match[j] - 1][j - 1] for j in range(1, n + 1))
