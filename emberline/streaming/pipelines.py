"""Structured Streaming: directory sources, linear pipelines, event-time windows, keyed state."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int = 100, glob: str | None = None) -> DataFrame:
    """A directory as a stream; `files_per_batch` bounds a micro-batch and gives back-pressure."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (r.option("pathGlobFilter", glob) if glob else r).format(fmt).load(path)


def pipeline(source: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Source through the stages in order; one query, so a stage costs no hand-over."""
    for s in stages:
        source = source.transform(s)
    return source


def _started(w, watch: bool, every: str = "10 seconds") -> StreamingQuery:
    return (w.trigger(processingTime=every) if watch else w.trigger(availableNow=True)).start()


def run(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", mode: str = "append", watch: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Start the query into a file sink. Without `watch` it works off what is there and ends;
    with it, it looks for new files every so often until it is stopped."""
    return _started(df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode), watch, every)


def per_batch(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", watch: bool = False) -> StreamingQuery:
    """Each micro-batch with its number, for graphs built per batch and sinks of several tables.

    A batch that is repeated after a failure comes with the same number: write under it."""
    return _started(df.writeStream.foreachBatch(work).outputMode(mode).option("checkpointLocation", checkpoint), watch)


def into_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "complete", watch: bool = False) -> StreamingQuery:
    """Start the query into the in-memory table `name` of the session. The driver holds all
    rows, so it is for aggregates of a known size and for looking on."""
    return _started(df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint), watch)


def window_counts(df: DataFrame, window: Column, keys: Sequence[str], ts: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, window_end, keys, n per window. With `late`, rows more than that behind the
    latest `ts` may be left out, which lets a stream close windows and forget them. Batch or stream."""
    if late:
        df = df.withWatermark(ts, late)
    return df.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


def tumbling_counts(df: DataFrame, ts: str, width: str, keys: Sequence[str], late: str | None = None) -> DataFrame:
    """Counts per window of fixed width, one after the other, see `window_counts`."""
    return window_counts(df, F.window(ts, width), keys, ts, late)


def sliding_counts(df: DataFrame, ts: str, width: str, step: str, keys: Sequence[str], late: str | None = None) -> DataFrame:
    """Counts per window of fixed width, one every `step`: a row is in several."""
    return window_counts(df, F.window(ts, width, step), keys, ts, late)


def session_counts(df: DataFrame, ts: str, gap: str, keys: Sequence[str], late: str | None = None) -> DataFrame:
    """Counts per session of the keys: it ends `gap` after its last row. A row exactly that much
    later starts a new one."""
    return window_counts(df, F.session_window(ts, gap), keys, ts, late)


def running_moments(df: DataFrame, who: str, ts: str, order: str, value: str) -> DataFrame:
    """who, order key, n, mean, m2 of the entity's earlier values (Welford), as keyed state.

    Within a micro-batch rows are taken in (ts, order) sequence; the state of an entity is
    three numbers, so it doesn't grow with its rows. Equal to the batch window over earlier
    rows when rows arrive in order of time."""
    kind = df.schema[who].dataType.simpleString()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(parts)).sort_values([ts, order])
        out = []
        for o, v in zip(rows[order], rows[value]):
            out.append((key[0], o, n, mean if n else None, m2 if n else None))
            if pd.notna(v):
                n += 1
                d = float(v) - mean
                mean += d / n
                m2 += d * (float(v) - mean)
        state.update((n, mean, m2))
        yield pd.DataFrame(out, columns=[who, order, "n_before", "mean_before", "m2_before"])

    schema = f"{who} {kind}, {order} {df.schema[order].dataType.simpleString()}, n_before bigint, mean_before double, m2_before double"
    return df.select(who, ts, order, value).groupBy(who).applyInPandasWithState(step, schema, "n bigint, mean double, m2 double", "append", GroupStateTimeout.NoTimeout)


class Throughput(StreamingQueryListener):
    """Rows and rate of every finished micro-batch, and what ended a query.

    `closed` is called once for each query that ends, with its id and its error or None: the
    place to close clients and files."""

    def __init__(self, closed: Callable[[str, str | None], None] | None = None) -> None:
        self.batches: list[tuple[str, int, int, float]] = []
        self.ended: dict[str, str | None] = {}
        self.closed = closed

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches.append((str(p.id), p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.id)] = event.exception
        if self.closed:
            self.closed(str(event.id), event.exception)

    def wait(self, query_id: str, seconds: float = 30.0) -> None:
        """Until the end of the query has been reported; events come a little later than the end itself."""
        limit = time.time() + seconds
        while query_id not in self.ended:
            if time.time() > limit:
                raise TimeoutError(f"no event of the end of query {query_id}")
            time.sleep(0.05)

    def rows(self, query_id: str) -> dict[int, int]:
        """Input rows of each micro-batch."""
        return {b: n for q, b, n, _ in self.batches if q == query_id and n}
