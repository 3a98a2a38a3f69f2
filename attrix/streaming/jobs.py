"""Structured Streaming forms of scoring, drift, reuse and dashboards (M1-M5).

Every job reads a file source with ``readStream`` and keeps its checkpoint in
the shared folder named by ``spark.checkpoint.dir``, so a restarted query (after
executor or driver loss) resumes from its last committed micro-batch. State is
bounded by watermarks; nothing uses an unbounded ``dropDuplicates``.

Update-mode aggregates are written by ``foreachBatch`` as (key, value, batch_id)
rows; the current answer is ``max_by(value, batch_id)`` per key, which makes the
sink idempotent under micro-batch replay.
"""

from __future__ import annotations

import bisect
import contextlib
import os
import sys
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import risk_level
from ..operators.score import risk_score
from ..sources.files import scratch_path
from ..sources.keyed import KeyedTable

#: The TTL dedupe: event times of a key sorted at once, read again at once from a sorted run, and emitted at once.
RUN_ROWS = 1 << 20
BLOCK_ROWS = 512
EMITTED_ROWS = 10_000


def run(q: StreamingQuery, limit_s: float | None = None) -> None:
    """Wait until the query has read all its input; beyond a limit the query is stopped and the call fails."""
    ended = q.awaitTermination(limit_s) if limit_s is not None else q.awaitTermination() is None
    if not ended:
        q.stop()
        raise TimeoutError(f"the stream has not ended within {limit_s} s; its output is incomplete")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stage_source(df: DataFrame, name: str) -> str:
    """Copy a batch table to a file folder that a stream can read, in the partitions that the table has."""
    path = scratch_path(df.sparkSession, f"src-{name}")
    df.write.parquet(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a static table once into the shared scratch folder and read it back, so a
    stream-static join scans stored rows instead of recomputing their lineage per batch."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over a folder; without ``files_per_trigger`` one micro-batch takes all files there are."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP (with time zone); wall-clock columns are read as UTC."""
    if dict(df.dtypes).get(ts) == "timestamp_ntz":
        return df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df


def score_stream(stream: DataFrame, logit: Callable[[], object], out: str, checkpoint: str) -> StreamingQuery:
    """M1: stateless scoring of a stream of customer rows (E1-E3), appended to parquet."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit()))
    scored = stream.withColumn("p", p).withColumn("risk_score", risk_score("p")) \
        .withColumn("risk_level", risk_level("risk_score"))
    return (scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def _upsert_sink(out: str, keys: list[str]):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out)
    return write


def latest_state(spark: SparkSession, out: str, keys: list[str], values: list[str]) -> DataFrame:
    """Current value per key of an update-mode sink: ``max_by(value, batch_id)``."""
    t = spark.read.parquet(out)
    if "window_start" in t.columns:       # report windows as UTC wall-clock time
        t = t.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return t.groupBy(*keys).agg(*[F.max_by(v, "batch_id").alias(v) for v in values])


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], window: str, watermark: str,
                    out: str, checkpoint: str) -> StreamingQuery:
    """M2/M4 building block: ``count`` per (tumbling window, keys) in update mode, late rows
    (beyond the watermark) dropped by the stateful aggregation."""
    agg = (event_time(stream, ts).withWatermark(ts, watermark)
           .groupBy(F.window(ts, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
           .select(F.col("w.start").alias("window_start"), *keys, "n"))
    return (agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(_upsert_sink(out, ["window_start"])).trigger(availableNow=True).start())


class _Run:
    """Ascending times: a block of them in memory, those after it, up to the place ``end``, in a file."""

    def __init__(self, block: np.ndarray, at: int = 0, end: int = 0, fd: int = -1):
        self.block, self.at, self.end, self.fd = block, at, end, fd

    def first_after(self, bound: int) -> int | None:
        """The least time greater than the bound; bounds of later calls are not smaller."""
        if self.at < self.end and not (len(self.block) and self.block[-1] > bound):
            rest = range(self.at, self.end)
            self.at += bisect.bisect_right(rest, bound, key=lambda i: int.from_bytes(os.pread(self.fd, 8, 8 * i), sys.byteorder, signed=True))
            self.block = np.frombuffer(os.pread(self.fd, 8 * min(BLOCK_ROWS, self.end - self.at), 8 * self.at), "int64")
            self.at += len(self.block)
        i = int(np.searchsorted(self.block, bound, "right"))
        return int(self.block[i]) if i < len(self.block) else None


def kept_times(frames: Iterable, last: int | None, step: int, rows: int = RUN_ROWS) -> Iterator[np.ndarray]:
    """Times ``us`` of the frames, taken in time order, that lie more than ``step`` after the one kept before.

    Frames are read once, in any order: runs of bounded size are sorted, freed of repeats and, unless there is one only,
    put into one file of the worker's temp folder. The next time kept is the least that a search finds in the runs, so
    memory has one run and a small block of every other, however many rows the frames have.
    """
    with contextlib.ExitStack() as stack:
        file, ends, block, held = None, [0], [], 0

        def write() -> None:
            run = np.unique(np.concatenate(block))
            run.tofile(file)
            ends.append(ends[-1] + len(run))
            block.clear()

        for frame in frames:
            us = frame["us"].dropna().to_numpy("int64")
            for start in range(0, len(us), rows):
                if held >= rows:
                    file = file or stack.enter_context(tempfile.TemporaryFile())
                    write()
                    held = 0
                block.append(us[start : start + rows].copy())
                held += len(block[-1])
        if file:
            write()
            file.flush()
            runs = [_Run(np.empty(0, "int64"), lo, hi, file.fileno()) for lo, hi in zip(ends, ends[1:])]
        else:
            runs = [_Run(np.unique(np.concatenate(block)))] if block else []
        kept: list[int] = []
        while True:
            bound = -(1 << 63) if last is None else last + step
            last = min((t for t in (r.first_after(bound) for r in runs) if t is not None), default=None)
            if kept and (last is None or len(kept) == EMITTED_ROWS):
                yield np.array(kept, "int64")
                kept = []
            if last is None:
                return
            kept.append(last)


def dedupe_within_ttl(stream: DataFrame, key: str, ts: str, ttl_seconds: int, out: str, checkpoint: str) -> StreamingQuery:
    """M3: emit an event unless its key was emitted at most ``ttl_seconds`` earlier; (key, ts) rows.

    Keyed state holds the time of the last emission, an event-time timer drops it when it is too old to matter. Events of a
    micro-batch are taken in time order, so the result does not depend on the size of the batches as long as files
    arrive in time order within the watermark. A key's events of a micro-batch are read as a stream of frames and sorted
    outside memory (``kept_times``), so a key may have any number of them.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    step = ttl_seconds * 1_000_000

    def emit(k, frames, state):
        last = state.get[0] if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        import pandas as pd
        for kept in kept_times(frames, last, step):
            last = int(kept[-1])
            yield pd.DataFrame({key: [k[0]] * len(kept), "us": kept})
        state.update((last,))
        expires = (last + step) // 1000 + 1
        if expires > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(expires)
        else:
            state.remove()

    kind = stream.schema[key].dataType.simpleString()
    d = (event_time(stream, ts).where(F.col(key).isNotNull()).withWatermark(ts, f"{ttl_seconds} seconds").select(key, ts, F.unix_micros(ts).alias("us")).groupBy(key)
         .applyInPandasWithState(emit, f"{key} {kind}, us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
         .select(key, F.timestamp_micros("us").alias(ts)))
    return (d.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def idempotent_append(stream: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """M5: each micro-batch appends only rows whose key is not yet in the keyed table at ``target``.

    It reads the keys of the buckets that its own rows hit; a replayed batch adds nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(batch.sparkSession, target, batch.schema, key).append(batch)
    return (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
            .trigger(availableNow=True).start())
