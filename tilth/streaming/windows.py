"""Sliding levels, sticky verdicts and idempotent keyed delivery."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.sources.store import KeyedStore


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """A timestamp without zone becomes event time in UTC with a watermark."""
    utc = F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})"))
    return df.withColumn(column, utc).withWatermark(column, delay)


def sliding_levels(samples: DataFrame, at_us: Column, keys: list[str], value: str, width_us: int, step_us: int, least: int = 1) -> DataFrame:
    """Windows aligned to the epoch that hold at least ``least`` samples: window_start (microseconds), n, rms."""
    first = F.floor((at_us - width_us) / step_us) + 1
    starts = F.sequence(first, F.floor(at_us / step_us))
    spread = samples.select(*keys, F.col(value).cast("double").alias("_x"), F.explode(starts).alias("_k"))
    return spread.groupBy(*keys, (F.col("_k") * step_us).alias("window_start")).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("_x") * F.col("_x"))).alias("rms")).where(F.col("n") >= least)


def level_stream(samples: DataFrame, at: str, keys: list[str], value: str, width: str, step: str) -> DataFrame:
    """The same over an event-time stream, emitted when the watermark passes a window."""
    x = F.col(value).cast("double")
    return samples.groupBy(F.window(at, width, step), *keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(x * x)).alias("rms"))


def sticky_verdicts(rounds: DataFrame, keys: list[str], seq: str, ok: Column, verdict: str) -> DataFrame:
    """Per key the verdict of the last ok round, else of the last round: once ok, never worse."""
    best = rounds.groupBy(*keys).agg(F.max(F.struct(ok.alias("ok"), F.col(seq).alias("seq"), F.col(verdict).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias(verdict), F.col("b.ok").alias("content_ok"))


def keyed_batches(target: str, keys: list[str], order: list[str], retries: int = 3, backoff: float = 1.0, wait=time.sleep, stream: str = "stream", buckets: int = 64, keep: int = 10):
    """A ``foreachBatch`` function that upserts each batch into a ``KeyedStore``, last row per key winning; a repeated batch changes nothing.

    A batch rewrites the buckets that it touches, and of the versions the last ``keep`` stay. A failing write is tried
    ``retries`` times, after ``backoff`` seconds times the tries so far; then the batch fails and the stream with it, so that a
    restart repeats it from the checkpoint. Streams that share a table have names of their own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store = KeyedStore(batch.sparkSession, target, keys, buckets)
        for attempt in range(1, retries + 1):
            try:
                store.upsert(batch, order, stream, batch_id)
                break
            except Exception:
                if attempt == retries:
                    raise
                wait(backoff * attempt)
        if batch_id % keep == keep - 1:
            store.expire(keep)

    return write


def recent_levels(samples: DataFrame, key: str, at: str, value: str, width_ms: int, delay: str = "10 seconds") -> DataFrame:
    """Level of the last ``width_ms`` of each key's samples after every batch that brings some: key, at_ms, n, rms.

    The state per key is a bounded buffer: samples of the last two windows before its latest one,
    older ones are dropped, late ones too.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, loud = state.get if state.exists else ([], [])
        new = [f for f in frames]
        t = np.concatenate([np.asarray(times, dtype=np.int64), *[f["_at"].to_numpy(dtype=np.int64) for f in new]])
        x = np.concatenate([np.asarray(loud, dtype=float), *[f["_x"].to_numpy(dtype=float) for f in new]])
        order = np.lexsort((x, t))
        t, x = t[order], x[order]
        last = int(t[-1])
        keep, now = t > last - 2 * width_ms, t > last - width_ms
        state.update((t[keep].tolist(), x[keep].tolist()))
        yield pd.DataFrame([(key_[0], last, int(now.sum()), float(np.sqrt(np.mean(x[now] ** 2))))], columns=[key, "at_ms", "n", "rms"])

    kind = samples.schema[key].dataType.simpleString()
    ready = samples.where(F.col(value).isNotNull() & F.col(at).isNotNull()).withWatermark(at, delay).select(key, F.unix_millis(at).alias("_at"), F.col(value).cast("double").alias("_x"))
    return ready.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at_ms long, n int, rms double", "times array<long>, loud array<double>", "append", GroupStateTimeout.NoTimeout)


def start_ticks(stream: DataFrame, write, checkpoint: str, every: str):
    """Start ``write(batch, id)`` at most once per ``every``: ticks that pass while a batch is at work are skipped, their rows go into the next batch."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
