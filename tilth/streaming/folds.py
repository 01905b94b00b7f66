"""Ordered folds over event streams with event-time timers: the slot ledger and the guided chunk.

Events of a key may come out of order within the watermark's delay. They wait in the state until the
watermark has passed them; a timer at their time then hands them to the fold in order, so the results are those of
the batch folds in ``operators.progress`` over the same events. Timers also act where no event comes: a
slot opens again when its cooling is over, an abandoned chunk closes. A key without anything left to
remember has no state. Events older than the watermark are dropped by Spark, which counts them
(``late.LateRows``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructType

from tilth.operators.progress import BLIND_TARGET, COOLDOWN_US, FALLBACK_AFTER, SLOTS


def fields(**kinds) -> StructType:
    out = StructType()
    for name, kind in kinds.items():
        out.add(name, kind)
    return out


def due_ms(at_us: int) -> int:
    """The first whole millisecond that isn't before a time in microseconds: timers count in those."""
    return -(-at_us // 1000)


class OrderedFold(StatefulProcessor):
    """Buffers events until the watermark passes them, then folds them in order with what falls due between them.

    A subclass gives ``STATE`` and ``EVENT`` schemas, ``start()``, ``step(state, at, event)`` and ``wake(state, at)`` ->
    (state, rows), ``next_due(state)`` -> microseconds or None, ``is_empty(state)``.
    """

    STATE = EVENT = OUT = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)
        self.waiting = handle.getListState("waiting", self.EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        names = [f"event_{f.name}" for f in self.EVENT]
        events = [tuple(x.item() if hasattr(x, "item") else x for x in e) for frame in rows for e in frame[names].itertuples(index=False, name=None)]
        if events:
            self.waiting.appendList(events)
            for at in {due_ms(e[0]) for e in events}:
                self.handle.registerTimer(at)
        yield pd.DataFrame(columns=[f.split()[0] for f in self.OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        upto = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        ready, rest = sorted(e for e in waiting if due_ms(e[0]) <= upto), [e for e in waiting if due_ms(e[0]) > upto]
        state = self.state.get() if self.state.exists() else None
        state = self.load(state) if state is not None else self.start()
        out = []
        for event in [*ready, None]:
            until = event[0] if event else upto * 1000
            while (due := self.next_due(state)) is not None and (due <= until if event else due_ms(due) <= upto):
                state, rows = self.wake(state, due)
                out += rows
            if event:
                state, rows = self.step(state, event[0], event)
                out += rows
        if ready and rest:
            self.waiting.put(rest)
        elif ready:
            self.waiting.clear()
        due = self.next_due(state)
        if due is not None:
            self.handle.registerTimer(due_ms(due))
        if self.is_empty(state):
            self.state.clear()
        else:
            self.state.update(self.store(state))
        if out:
            yield pd.DataFrame([(*key, *r) for r in out], columns=[f.split()[0] for f in self.OUT.split(", ")])

    def close(self) -> None:
        pass

    def load(self, state):
        return state

    def store(self, state):
        return state


def folded(events: DataFrame, key: str, at: str, columns: list[str], fold: type[OrderedFold]) -> DataFrame:
    """``events`` with a watermark on ``at`` through a fold: one row per change. Rows with a null in any column are left out."""
    kind = events.schema[key].dataType.simpleString()

    class Named(fold):
        OUT = f"{key} {kind}, {fold.OUT}"

    names = [f"event_{f.name}" for f in fold.EVENT]
    ready = events.select(F.col(key), F.col(at), *[c.alias(n) for c, n in zip((F.unix_micros(at), *columns), names, strict=True)]).dropna()
    return ready.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Named(), outputStructType=Named.OUT, outputMode="Append", timeMode="EventTime"
    )


class SlotLedger(OrderedFold):
    """Claims, steps back and releases of a learner; a freed slot cools for 72 hours and then opens by itself."""

    STATE = fields(active=ArrayType(LongType()), cooling=ArrayType(LongType()), refused=IntegerType())
    EVENT = fields(at=LongType(), seq=LongType(), op=StringType(), item=LongType())
    OUT = "at bigint, change string, item bigint, active string, n_refused int, n_cooling int, next_opens bigint"

    def start(self):
        return (), (), 0

    def load(self, state):
        active, cooling, refused = state
        return tuple(int(x) for x in active), tuple(int(x) for x in cooling), int(refused)

    def store(self, state):
        return list(state[0]), list(state[1]), state[2]

    def row(self, state, at, change, item):
        active, cooling, refused = state
        return at, change, item, ",".join(map(str, sorted(active))), refused, len(cooling), min(cooling, default=None)

    def step(self, state, at, event):
        active, cooling, refused = state
        op, item = event[2], event[3]
        change = op
        if op == "claim":
            if item in active:
                change = "held"
            elif len(active) + len(cooling) >= SLOTS:
                change, refused = "refused", refused + 1
            else:
                active = (*active, item)
        elif op in ("step_back", "release"):
            active = tuple(x for x in active if x != item)
            if op == "step_back":
                cooling = (*cooling, at + COOLDOWN_US)
        state = active, cooling, refused
        return state, [self.row(state, at, change, item)]

    def wake(self, state, at):
        active, cooling, refused = state
        state = active, tuple(c for c in cooling if c > at), refused
        return state, [self.row(state, at, "opens", None)]

    def next_due(self, state):
        return min(state[1], default=None)

    def is_empty(self, state):
        return state == ((), (), 0)


def slot_stream(events: DataFrame, key: str, at: str, seq: str, op: str, item: str) -> DataFrame:
    """The slot ledger of a stream with a watermark on ``at``: a row per event and per slot that opens, in order per key.

    key, at (microseconds), change (claim, held, refused, step_back, release, opens), item, active (sorted items, comma-joined), n_refused, n_cooling,
    next_opens (null if nothing cools). A key's last row is what ``progress.slot_ledger`` gives for the events up to there, with
    slots opened that opened since. Events of one instant are taken by ``seq``.
    """
    columns = [F.col(seq).cast("long").alias("seq"), F.col(op).cast("string").alias("op"), F.col(item).cast("long").alias("item")]
    return folded(events, key, at, columns, SlotLedger)


def chunk_fold(idle_us: int) -> type[OrderedFold]:
    class GuidedChunk(OrderedFold):
        """Attempts at a chunk through echo, recall and blind; closed as abandoned after ``idle_us`` without an attempt."""

        STATE = fields(stage=StringType(), run=IntegerType(), fails=IntegerType(), back=BooleanType(), n=IntegerType(), last=LongType())
        EVENT = fields(at=LongType(), seq=LongType(), ok=BooleanType())
        OUT = "at bigint, stage string, n_attempts int, n_blind_fails int, fell_back boolean, quality int"

        def start(self):
            return "echo", 0, 0, False, 0, None

        def load(self, state):
            stage, run, fails, back, n, last = state
            return stage, int(run), int(fails), bool(back), int(n), int(last)

        def step(self, state, at, event):
            stage, run, fails, back, n, _ = state
            if stage == "done":
                return (stage, run, fails, back, n, at), []
            ok = bool(event[2])
            if stage == "blind":
                run, fails = (run + 1, fails) if ok else (0, fails + 1)
                if ok and run >= BLIND_TARGET:
                    stage = "done"
                elif not ok and fails >= FALLBACK_AFTER:
                    stage, back = "recall", True
            elif ok:
                stage = "recall" if stage == "echo" else "blind"
            state = stage, run, fails, back, n + 1, at
            return state, [self.row(state, at, stage)]

        def row(self, state, at, stage):
            _, _, fails, back, n, _ = state
            quality = None if stage != "done" else 2 if back or fails >= FALLBACK_AFTER else 4 if fails else 5
            return at, stage, n, fails, back, quality

        def wake(self, state, at):
            return self.start(), [] if state[0] == "done" else [self.row(state, at, "abandoned")]

        def next_due(self, state):
            return None if state[5] is None else state[5] + idle_us

        def is_empty(self, state):
            return state[5] is None

    return GuidedChunk


def chunk_stream(attempts: DataFrame, key: str, at: str, seq: str, passed: str, decoded: str, idle: int = 3600) -> DataFrame:
    """The guided chunk of a stream with a watermark on ``at``: a row per attempt that counts, and one when a chunk is abandoned.

    key, at (microseconds), stage, n_attempts, n_blind_fails, fell_back, quality (when done), as ``progress.guided_chunks``
    counts them. After ``idle`` seconds without an attempt the key starts anew; its state is gone.
    """
    real = attempts.where(F.length(F.trim(decoded)) >= 3)
    return folded(real, key, at, [F.col(seq).cast("long").alias("seq"), F.coalesce(F.col(passed), F.lit(False)).alias("ok")], chunk_fold(idle * 1_000_000))
