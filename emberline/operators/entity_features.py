"""One wide row per entity from sorted runs of (entity, type) events."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.plans.durable import written

#: Rows of one entity above which its rows are spread over several streams by actor.
SPLIT_ROWS = 4_000_000


#: Hot entities that are sent to every task.
MOST_SENT = 100_000
#: Latest time of a run without times.
NEVER = -(2**62)


def _changes(a: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; nulls are equal to each other."""
    if pa.types.is_string(a.type):
        v = a.dictionary_encode().indices
    else:
        v = a
    ok = v.is_valid().to_numpy(zero_copy_only=False)
    v = v.fill_null(0).to_numpy(zero_copy_only=False)
    return (v[1:] != v[:-1]) | (ok[1:] != ok[:-1])


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list, list, list]]:
    """(entity, split, type, n, latest, actors) of each run, as lists; sorted input, any batching.
    An actor may have several rows in a run, one after the other."""
    held: list | None = None
    actor = None  # of the row before the batch
    for b in batches:
        if not b.num_rows:
            continue
        run = _changes(b.column(0)) | _changes(b.column(1)) | _changes(b.column(2))
        at = np.append(0, np.flatnonzero(run) + 1)
        n = np.add.reduceat(b.column(4).to_numpy(zero_copy_only=False), at).tolist()
        latest = np.maximum.reduceat(b.column(5).fill_null(NEVER).to_numpy(zero_copy_only=False), at).tolist()
        fresh = b.column(3).is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        fresh[1:] *= run | _changes(b.column(3))
        actors = np.add.reduceat(fresh, at).tolist()
        idx = pa.array(at)
        keys = [b.column(k).take(idx).to_pylist() for k in range(3)]
        rows = [*keys, n, latest, actors]
        if held is not None:
            if all(held[k] == rows[k][0] for k in range(3)):
                rows[3][0] += held[3]
                rows[4][0] = max(rows[4][0], held[4])
                rows[5][0] += held[5] - (fresh[0] and b.column(3)[0].as_py() == actor)
            else:
                rows = [[h, *r] for h, r in zip(held, rows)]
        actor = b.column(3)[b.num_rows - 1].as_py()
        held = [r.pop() for r in rows]
        if rows[0]:
            yield tuple(rows)
    if held is not None:
        yield tuple([h] for h in held)


LONG = "entity string, type bigint, n bigint, latest bigint, n_actors bigint"


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for e, _, t, n, latest, actors in _run_rows(batches):
        seen = pa.array(latest, pa.int64(), mask=np.array(latest) == NEVER)
        yield pa.RecordBatch.from_arrays([pa.array(e, pa.string()), pa.array(t, pa.int64()), pa.array(n, pa.int64()), seen, pa.array(actors, pa.int64())], names=["entity", "type", "n", "latest", "n_actors"])


def event_pairs(df: DataFrame, entity: str, kind: str, actor: str, time_s: str, row_key: Sequence[str] = (), splits: DataFrame | None = None) -> DataFrame:
    """Rows per (entity, type, actor) with count and latest time.

    Rows without entity or type are left out; rows without an actor count as one null actor,
    and rows without a time count but have no latest. With `row_key`, rows that agree in it
    and in the other columns are copies and count once.

    Copies have entity, type and actor in common, so one shuffle by these serves both for
    dropping them and for the counts: there is no exchange between the two aggregations. An
    entity listed in `splits` (see `split_table`) is spread further, by its copies' key, and
    may then have several rows for one actor. Without `row_key` rows are combined before they
    are shuffled. Result: entity, type, actor, n, latest."""
    rows = df.select(F.col(entity).alias("entity"), F.col(kind).cast("bigint").alias("type"), F.col(actor).alias("actor"), F.col(time_s).cast("bigint").alias("t"), *[F.col(c).alias(f"__k{i}") for i, c in enumerate(row_key)])
    rows = rows.where("entity IS NOT NULL AND type IS NOT NULL")
    by = ["entity", "type", "actor"]
    if row_key:
        own = [f"__k{i}" for i in range(len(row_key))]
        if splits is not None:
            rows = rows.join(splits, "entity", "left").withColumn("salt", F.pmod(F.xxhash64(*own), F.coalesce("splits", F.lit(1))).cast("int"))
            by.append("salt")
        rows = rows.repartition(*by).groupBy(*by, *own).agg(F.max("t").alias("t"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("t").alias("latest")).select("entity", "type", "actor", "n", "latest")


def _bucketed(pairs: DataFrame, splits: DataFrame | None) -> DataFrame:
    if splits is None:
        rows = pairs.withColumn("split", F.lit(0))
    else:
        rows = pairs.join(splits, "entity", "left").withColumn("split", F.pmod(F.xxhash64("actor"), F.coalesce("splits", F.lit(1))).cast("int"))
    return rows.select("entity", "split", "type", "actor", "n", "latest").repartition("entity", "split").sortWithinPartitions("entity", "split", "type", "actor")


def split_table(df: DataFrame, entity: str, split_rows: int = SPLIT_ROWS) -> DataFrame | None:
    """Entities with more than `split_rows` rows and the number of streams each gets; None if there are none.

    There is at most one such entity to `split_rows` rows of the table. Up to MOST_SENT of them
    are marked to be sent to every task, so that rows needn't move to learn whether their
    entity is one; more are left to the planner."""
    hot = df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("entity")).agg(F.count("*").alias("c")).where(F.col("c") > split_rows)
    hot = written(hot.select("entity", F.ceil(F.col("c") / split_rows).alias("splits")))
    n = hot.count()
    return None if not n else F.broadcast(hot) if n <= MOST_SENT else hot


def event_runs(pairs: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """Per entity and type: number of events, latest time, number of different actors.

    `pairs` (from `event_pairs`) are bucketed by entity and sorted by type and actor; runs are
    streamed into counters with constant memory. An entity listed in `splits` is spread by
    actor over several streams; since a split holds whole actors, its counters add up.
    Result: entity, type, n, latest, n_actors.
    """
    runs = _bucketed(pairs, splits).mapInArrow(_long, LONG)
    if splits is None:
        return runs
    hot = runs.join(splits.select("entity"), "entity", "left_semi").groupBy("entity", "type").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"), F.sum("n_actors").alias("n_actors"))
    return runs.join(splits.select("entity"), "entity", "left_anti").unionByName(hot)


def wide_schema(types: Sequence[int]) -> str:
    return ", ".join(["entity string", *[f"{p}_{t} bigint" for p in ("cnt", "age", "users") for t in types]])


def _wide(types: Sequence[int], as_of: int):
    where = {t: i for i, t in enumerate(types)}
    k = len(types)
    names = ["entity", *[f"{p}_{t}" for p in ("cnt", "age", "users") for t in types]]

    def batch(entities: list, rows: list[tuple]) -> pa.RecordBatch:
        cnt, age, users = np.zeros((k, len(entities)), np.int64), np.full((k, len(entities)), -1, np.int64), np.zeros((k, len(entities)), np.int64)
        for i, j, n, latest, actors in rows:
            cnt[j, i] += n
            if latest != NEVER:
                age[j, i] = as_of - latest if age[j, i] < 0 else min(age[j, i], as_of - latest)
            users[j, i] += actors
        cols = [pa.array(entities, pa.string()), *[pa.array(c) for c in cnt], *[pa.array(c, mask=c < 0) for c in age], *[pa.array(c) for c in users]]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entities: list = []
        rows: list[tuple] = []
        for es, _, ts, ns, ls, us in _run_rows(batches):
            for e, t, n, latest, u in zip(es, ts, ns, ls, us):
                if not entities or entities[-1] != e:
                    if len(entities) >= 2000:
                        yield batch(entities, rows)
                        entities, rows = [], []
                    entities.append(e)
                if (j := where.get(t)) is not None:
                    rows.append((len(entities) - 1, j, n, latest, u))
        if entities:
            yield batch(entities, rows)

    return run


def wide_features(pairs: DataFrame, types: Sequence[int], as_of: int, splits: DataFrame | None = None) -> DataFrame:
    """One row per entity: cnt_T, age_T and users_T for every type T of `types`.

    cnt_T and users_T are 0 and age_T (seconds from the latest event to `as_of`) is null where
    the entity has no event of the type (age_T also where none has a time); an entity whose types are all unlisted still has a row.
    The rows leave the sorted streams as they are; only entities listed in `splits` are added
    up from several partial rows. `types` is the fixed catalogue of event types.
    """
    rows = _bucketed(pairs, splits).mapInArrow(_wide(list(types), as_of), wide_schema(types))
    if splits is None:
        return rows
    if not types:
        return rows.distinct()
    aggs = [(F.sum if p != "age" else F.min)(f"{p}_{t}").alias(f"{p}_{t}") for p in ("cnt", "age", "users") for t in types]
    keys = splits.select("entity")
    return rows.join(keys, "entity", "left_anti").unionByName(rows.join(keys, "entity", "left_semi").groupBy("entity").agg(*aggs))
