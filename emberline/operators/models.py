"""Fitted models on Spark ML, and the scoring adapter for exported networks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import clean as C
from emberline.operators import evaluation, sampling
from emberline.plans.durable import written


def assembled(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """`df` with a vector of `cols`; null, NaN and infinite values are 0."""
    clean = df.withColumns({f"__v_{c}": F.coalesce(C.finite(c), F.lit(0.0)) for c in cols})
    return VectorAssembler(inputCols=[f"__v_{c}" for c in cols], outputCol=out).transform(clean).drop(*[f"__v_{c}" for c in cols])


def pca(df: DataFrame, cols: Sequence[str], variance: float, most: int = 32, inclusive: bool = False):
    """(model, k): as many components as stay below the cumulated variance (up to and including
    it with `inclusive`), at least one. The model is fitted once and kept for new data."""
    model = PCA(k=min(most, len(cols)), inputCol="features", outputCol="pca").fit(assembled(df, cols))
    total, k = 0.0, 0
    for v in model.explainedVariance:
        total += v
        if total > variance or (total == variance and not inclusive):
            break
        k += 1
    return model, max(k, 1)


def _kmeans(data: DataFrame, k: int, seed: int, starts: int, steps: int):
    """The fit of least inertia from several starts; ties go to the first."""
    fits = [KMeans(k=k, seed=seed + i, maxIter=steps, initMode="k-means||").fit(data) for i in range(starts)]
    return min(fits, key=lambda m: m.summary.trainingCost)


def kmeans(df: DataFrame, cols: Sequence[str], k: int, seed: int = 1, steps: int = 300, starts: int = 3):
    """(rows with `prediction`, inertia); the best of several parallel k-means++ starts."""
    data = written(assembled(df, cols))
    model = _kmeans(data, k, seed, starts, steps)
    return model.transform(data), model.summary.trainingCost


def largest_clusters(df: DataFrame, cols: Sequence[str], k: int, keep: int, seed: int = 1, steps: int = 300, starts: int = 3) -> DataFrame:
    """Rows with `cluster`: fitted with k centres, then every row goes to the nearest of the
    `keep` centres that have most rows."""
    data = written(assembled(df, cols))
    model = _kmeans(data, k, seed, starts, steps)
    size = model.summary.clusterSizes
    top = sorted(range(len(size)), key=lambda i: (-size[i], i))[:keep]
    dist = [F.struct(F.aggregate(F.zip_with(vector_to_array("features"), F.array(*[F.lit(float(x)) for x in model.clusterCenters()[i]]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"), F.lit(n).alias("c")) for n, i in enumerate(top)]
    return data.withColumn("cluster", F.array_min(F.array(*dist))["c"]).drop("features")


def sweep(df: DataFrame, cols: Sequence[str], ks: Sequence[int], seed: int = 1, steps: int = 300, starts: int = 3) -> list[tuple[int, float, float, float]]:
    """(k, inertia, silhouette by squared distance, silhouette by cosine) for each number of clusters."""
    out = []
    data = written(assembled(df, cols))
    for k in ks:
        model = _kmeans(data, k, seed, starts, steps)
        rows = model.transform(data)
        by = [ClusteringEvaluator(featuresCol="features", distanceMeasure=m).evaluate(rows) if m == "squaredEuclidean" or rows.where(F.forall(vector_to_array("features"), lambda x: x == 0)).isEmpty() else float("nan") for m in ("squaredEuclidean", "cosine")]
        out.append((k, model.summary.trainingCost, *by))
    return out


def held_out(key: str, share: float, seed: int = 21) -> Column:
    """True for a seeded share of the keys."""
    return sampling.fraction(key, share, seed)


def boosted_trees(df: DataFrame, cols: Sequence[str], label: str, depth: int = 5, rounds: int = 20, seed: int = 1, rate: float = 0.1, stop: str | None = None, tolerance: float = 0.01):
    """Gradient-boosted trees for a 0/1 label. With `stop`, a boolean column, the rows where it
    holds aren't trained on: boosting ends when their error no longer falls by `tolerance`."""
    gbt = GBTClassifier(labelCol=label, maxDepth=depth, maxIter=rounds, seed=seed, stepSize=rate)
    if stop:
        gbt = gbt.setParams(validationIndicatorCol=stop, validationTol=tolerance)
    return gbt.fit(assembled(df, cols))


#: Depth, learning rate, rounds, least gain of a split.
TREE_GRID = [(d, r, n, g) for d in (5, 6) for r in (0.3, 0.4, 0.45) for n in (100, 150) for g in (0.0, 0.1)]


def search_trees(df: DataFrame, cols: Sequence[str], label: str, key: str, grid: Sequence[tuple[int, float, int, float]] = tuple(TREE_GRID), stop_share: float = 0.15, test_share: float = 0.2, seed: int = 1):
    """(best model, rows): for each combination of `grid` a dict of depth, rate, rounds, gain,
    trees (how many there are after early stopping) and auc on the held-out rows.

    The key's hash splits the rows into training, stopping and test rows, the same for every
    combination; the best is the one of the highest auc, the first on a tie."""
    part = F.when(held_out(key, test_share, seed), "test").when(held_out(key, stop_share / (1 - test_share), seed + 1), "stop").otherwise("train")
    data = written(assembled(df, cols).select(key, label, "features", part.alias("__part")))
    fit, test = data.where("__part <> 'test'").withColumn("__stop", F.col("__part") == "stop"), data.where("__part = 'test'")
    best, out = None, []
    for depth, rate, rounds, gain in grid:
        gbt = GBTClassifier(labelCol=label, maxDepth=depth, maxIter=rounds, stepSize=rate, minInfoGain=gain, seed=seed, validationIndicatorCol="__stop", validationTol=0.01)
        model = gbt.fit(fit)
        scored = model.transform(test).select(F.col(label).cast("int").alias("y"), vector_to_array("probability")[1].alias("s"))
        auc = evaluation.roc_auc(evaluation.score_curve(scored, "y", "s")).first().auc
        out.append({"depth": depth, "rate": rate, "rounds": rounds, "gain": gain, "trees": model.getNumTrees, "auc": auc})
        if best is None or (auc or 0) > best[0]:
            best = (auc or 0, model)
    return best[1], out


def forest(df: DataFrame, cols: Sequence[str], label: str, trees: int = 30, depth: int = 6, seed: int = 1):
    """Random forest for any number of classes, numbered from 0."""
    return RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(assembled(df, cols))


def logistic(df: DataFrame, cols: Sequence[str], label: str):
    return LogisticRegression(labelCol=label, maxIter=50, regParam=1e-4).fit(assembled(df, cols))


def perceptron(df: DataFrame, cols: Sequence[str], label: str, hidden: Sequence[int] = (8,), steps: int = 60, seed: int = 1):
    """A network of sigmoid layers for a 0/1 label; `networks.from_perceptron` exports it."""
    return MultilayerPerceptronClassifier(labelCol=label, layers=[len(cols), *hidden, 2], maxIter=steps, seed=seed).fit(assembled(df, cols))


def probability(model, df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """`keep` and `score`, the probability of class 1."""
    return model.transform(assembled(df, cols)).select(*keep, vector_to_array("probability")[1].alias("score"))


#: Rows that one task of the word vectors' training takes.
ROWS_A_TASK = 500_000


def word2vec(df: DataFrame, tokens: str, size: int = 8, least: int = 1, seed: int = 1, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """word, vector array. Training runs in as many tasks as the rows need; their vectors are averaged."""
    tasks = max(1, math.ceil(df.count() / rows_a_task))
    m = Word2Vec(vectorSize=size, minCount=least, inputCol=tokens, outputCol="v", seed=seed, numPartitions=tasks).fit(df)
    return m.getVectors().select("word", vector_to_array("vector").alias("vector"))


def sample_next(counts: DataFrame, draws: DataFrame, temperature: float = 1.0, k: int | None = None, seed: int = 29) -> DataFrame:
    """`draws` with `second`, drawn after its `first` from the followers in `counts` (first,
    second, n) with probability in proportion to n^(1/temperature), of the k most frequent
    only. `draws` has a unique `key`. Without followers `second` is null.

    The largest of log-weight plus Gumbel noise is a draw from the softmax; the noise is a hash
    of key and follower, so a draw is one aggregation and the same every time."""
    if k:
        r = F.row_number().over(Window.partitionBy("first").orderBy(F.desc("n"), "second"))
        counts = counts.withColumn("__r", r).where(F.col("__r") <= k).drop("__r")  # ranks are cut before the shuffle as well
    u = (F.pmod(F.xxhash64("key", "second", F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    gumbel = F.log(F.col("n").cast("double")) / temperature - F.log(-F.log(u))
    got = draws.join(counts.where("n > 0"), "first").groupBy("key").agg(F.max_by("second", gumbel).alias("second"))
    return draws.join(got, "key", "left")


#: Items that windows may be corrupted with.
MOST_ITEMS = 5_000


def vocabulary(windows: DataFrame, items: str) -> list[str]:
    """The different items of all windows, in order; more than MOST_ITEMS raise."""
    got = [r[0] for r in windows.select(F.explode(F.array_distinct(items)).alias("x")).where("x IS NOT NULL").distinct().limit(MOST_ITEMS + 1).collect()]
    if len(got) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} different items")
    return sorted(got)


def corrupted_windows(windows: DataFrame, key: str, items: str, vocabulary: Sequence[str], followers: DataFrame, seed: int = 9) -> DataFrame:
    """key, items: each window with one place, drawn by hash, filled with an item that is not
    known to follow the item before it; windows that exist as they are drop out.

    `followers`: first, seconds (array). `vocabulary` is a list of
    at most MOST_ITEMS items."""
    words = F.array(*[F.lit(w) for w in vocabulary])
    n = F.size(items)
    at = F.pmod(F.xxhash64(key, F.lit(seed)), F.greatest(n - 1, F.lit(1))).cast("int") + 2
    j = windows.where(n >= 2).withColumn("at", at).withColumn("first", F.element_at(items, F.col("at") - 1)).join(followers, "first", "left")
    free = F.array_except(words, F.coalesce("seconds", F.array().cast("array<string>")))
    drawn = F.try_element_at(free, (F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.greatest(F.size(free), F.lit(1))) + 1).cast("int"))
    out = j.withColumn("w", drawn).where("w IS NOT NULL").select(key, F.transform(items, lambda x, i: F.when(i == F.col("at") - 1, F.col("w")).otherwise(x)).alias(items))
    return out.join(windows.select(items).distinct(), items, "left_anti").select(key, items)


def score_onnx(df: DataFrame, model: bytes, inputs: dict[str, list[str]], keep: Sequence[str], sigmoid: bool = True, outputs: dict[str, str] | None = None, batch: int = 1_024) -> DataFrame:
    """`keep` and the scores of an exported network, one column for each of `outputs` (the
    network's name to the column's; by default its first output as `score`), passed through
    the sigmoid if they are logits. `inputs` maps each input name to the columns of its matrix,
    or to one array column. Null and NaN inputs are 0.

    The model is sent to the tasks once; a session lives as long as its task and sees at most
    `batch` rows at a time, or fewer where the model's own first dimension says so. A model
    that lacks an input or has another width raises before any row is scored."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    session = _session(model)
    names = outputs or {session.get_outputs()[0].name: "score"}
    arrays = {c for cs in inputs.values() for c in cs if df.schema[c].dataType.typeName() == "array"}
    have = {i.name: i.shape for i in session.get_inputs()}
    if have.keys() != inputs.keys():
        raise ValueError(f"the network's inputs are {sorted(have)}, not {sorted(inputs)}")
    if missing := set(names) - {o.name for o in session.get_outputs()}:
        raise ValueError(f"the network has no outputs {sorted(missing)}")
    for n, cs in inputs.items():
        if len(have[n]) > 1 and isinstance(have[n][1], int) and cs[0] not in arrays and have[n][1] != len(cs):
            raise ValueError(f"input {n} takes {have[n][1]} columns, not {len(cs)}")
    fixed = [s[0] for s in have.values() if s and isinstance(s[0], int)]
    most = min([batch, *fixed])
    cols = list(dict.fromkeys([*keep, *[c for cs in inputs.values() for c in cs]]))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session = _session(shared.value)
        kinds = {i.name: np.int64 if "int64" in i.type else np.int32 if "int32" in i.type else np.float64 if "double" in i.type else np.float32 for i in session.get_inputs()}

        def matrix(p: pd.DataFrame, n: str) -> np.ndarray:
            cs = inputs[n]
            m = np.stack([np.asarray(v) for v in p[cs[0]]]) if cs[0] in arrays else p[cs].to_numpy(np.float64)
            m = np.nan_to_num(m.astype(np.float64) if kinds[n] in (np.float32, np.float64) else m)
            short = (most - len(m) if fixed else 0) or 0  # a fixed batch is filled up
            return np.concatenate([m, np.zeros((short, *m.shape[1:]))]).astype(kinds[n])

        for p in parts:
            for lo in range(0, len(p), most):
                q = p.iloc[lo : lo + most]
                got = session.run(list(names), {n: matrix(q, n) for n in inputs})
                out = {c: v.reshape(len(v), -1)[: len(q), 0].astype(float) for c, v in zip(names.values(), got)}
                yield q[list(keep)].assign(**{c: 1 / (1 + np.exp(-v)) if sigmoid else v for c, v in out.items()})

    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], *[f"`{c}` double" for c in names.values()]])
    return df.select(*cols).mapInPandas(run, schema)


def _session(model: bytes):
    import onnxruntime as ort

    options = ort.SessionOptions()
    options.intra_op_num_threads = 1  # a task has one core
    return ort.InferenceSession(model, options, providers=["CPUExecutionProvider"])
