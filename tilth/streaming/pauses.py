"""Cutting a stream of loudness samples into segments at pauses, in batch and as a stateful stream.

A sample speaks above ``speech``. A segment is cut after ``longest`` milliseconds if it has any
speech, else at a silence of ``pause`` once it is ``shortest`` long; never before speech.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PauseConfig:
    speech: float = 0.02
    pause: int = 700
    shortest: int = 1200
    longest: int = 4000


def segments(samples: DataFrame, keys: list[str], order: list[str], at: str, rms: str, config: PauseConfig, flush: bool = False) -> DataFrame:
    """Cuts per key in order: segment_start, segment_end, n_samples. What remains at the end is kept only if ``flush``."""
    zero = F.expr("named_struct('spoke', false, 'quiet', cast(null as long), 'start', cast(null as long), 'n', 0, 'last', 0L, 'cuts', cast(array() as array<struct<segment_start: long, segment_end: long, n_samples: int>>))")

    def step(s: Column, x: Column) -> Column:
        now, speaking = x["at"], x["rms"] > config.speech
        start = F.coalesce(s["start"], now)
        length = now - start
        quiet = F.when(~speaking & s["spoke"], F.coalesce(s["quiet"], now))
        forced = (length >= config.longest) & (s["spoke"] | speaking)
        paused = s["spoke"] & ~speaking & (now - quiet >= config.pause) & (length >= config.shortest)
        cut = forced | F.coalesce(paused, F.lit(False))
        piece = F.struct(start.alias("segment_start"), now.alias("segment_end"), (s["n"] + 1).alias("n_samples"))
        return F.struct(
            F.when(cut, False).otherwise(s["spoke"] | speaking).alias("spoke"), F.when(cut, F.lit(None)).otherwise(quiet).alias("quiet"), F.when(cut, now).otherwise(start).alias("start"),
            F.when(cut, 0).otherwise(s["n"] + 1).alias("n"), now.alias("last"), F.when(cut, F.concat(s["cuts"], F.array(piece))).otherwise(s["cuts"]).alias("cuts"),
        )

    events = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(order)], F.col(at).cast("long").alias("at"), F.col(rms).cast("double").alias("rms")))).alias("_x"))
    s = events.select(*keys, F.aggregate("_x", zero, step).alias("s"))
    rest = F.array(F.struct(F.col("s.start").alias("segment_start"), F.col("s.last").alias("segment_end"), F.col("s.n").alias("n_samples")))
    found = F.when(F.col("s.spoke") & F.lit(flush), F.concat("s.cuts", rest)).otherwise(F.col("s.cuts"))
    return s.select(*keys, F.explode(found).alias("c")).select(*keys, "c.*")


def segment_stream(samples: DataFrame, key: str, at: str, rms: str, config: PauseConfig, delay: str = "10 seconds", mark_late: bool = False) -> DataFrame:
    """The same cuts from a stream: ``samples`` with an event-time column, ordered per key within each batch.

    State per key is five numbers; samples of a batch are sorted by time. A sample before the state's last is never
    merged; with ``mark_late`` it comes out as a row of its own, with column ``late``, its time as start and end and
    one sample (see ``late.observed`` and ``late.apart``).
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spoke, quiet, start, n, last = state.get if state.exists else (False, -1, -1, 0, -1)
        cuts = []
        for now, loud in sorted((int(t), float(r)) for f in frames for t, r in zip(f["_at"], f["_rms"], strict=True)):
            if now < last:
                if mark_late:
                    cuts.append((key_[0], now, now, 1, True))
                continue
            last, start, speaking = now, (start if start >= 0 else now), loud > config.speech
            quiet = -1 if speaking or not spoke else (quiet if quiet >= 0 else now)
            n += 1
            forced = now - start >= config.longest and (spoke or speaking)
            if forced or (spoke and not speaking and now - quiet >= config.pause and now - start >= config.shortest):
                cuts.append((key_[0], start, now, n, False))
                spoke, quiet, start, n = False, -1, now, 0
            else:
                spoke = spoke or speaking
        state.update((spoke, quiet, start, n, last))
        if cuts:
            found = pd.DataFrame(cuts, columns=[key, "segment_start", "segment_end", "n_samples", "late"])
            yield found if mark_late else found.drop(columns="late")

    late = ", late boolean" if mark_late else ""
    kind = samples.schema[key].dataType.simpleString()
    ready = samples.withWatermark(at, delay).select(key, F.unix_millis(at).alias("_at"), F.col(rms).cast("double").alias("_rms"))
    return ready.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, segment_start long, segment_end long, n_samples int{late}", "spoke boolean, quiet long, start long, n int, last long", "append", GroupStateTimeout.NoTimeout)
