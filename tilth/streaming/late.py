"""Re-delivered and late rows of streams: the first are dropped within the watermark, the second counted and kept apart."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def once(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Rows of ``keys`` that come again within ``delay`` of the first are dropped, also in later batches.

    The state holds a key until the watermark passes its first row by ``delay``, so it is bounded by the keys of that time.
    A stream that has a watermark keeps it.
    """
    marked = stream if any(f.metadata.get("spark.watermarkDelayMs") is not None for f in stream.schema) else stream.withWatermark(at, delay)
    return marked.dropDuplicatesWithinWatermark(keys)


class LateRows(StreamingQueryListener):
    """Counts per query, by name or id, the rows that stateful operators dropped behind the watermark and rows that ``observed`` marks.

    ``spark.streams.addListener`` starts it. Progress arrives some time after its batch; ``wait_for`` waits.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.marked: dict[str, int] = {}
        self.batches: dict[str, int] = {}
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        name = p.get("name") or p["id"]
        with self._changed:
            self.dropped[name] = self.dropped.get(name, 0) + sum(s.get("numRowsDroppedByWatermark", 0) for s in p.get("stateOperators", []))
            seen = p.get("observedMetrics", {}).get("late_rows", {})
            self.marked[name] = self.marked.get(name, 0) + int(seen.get("n_late") or 0)
            self.batches[name] = max(self.batches.get(name, -1), p["batchId"])
            self._changed.notify_all()

    def onQueryTerminated(self, event) -> None:
        pass

    def wait_for(self, name: str, batch_id: int, seconds: float = 30) -> bool:
        """Whether the progress of ``batch_id`` has arrived."""
        with self._changed:
            return self._changed.wait_for(lambda: self.batches.get(name, -1) >= batch_id, seconds)


def observed(rows: DataFrame, late: str = "late") -> DataFrame:
    """``rows`` whose marked ones appear as ``late_rows.n_late`` in the query's progress."""
    return rows.observe("late_rows", F.count_if(F.col(late)).alias("n_late"), F.count(F.lit(1)).alias("n"))


def apart(write, side_table: str, late: str = "late"):
    """A ``foreachBatch`` function: rows marked as late are written to ``side_table`` as JSON lines, under the batch's id, the others go to ``write``.

    A batch that is repeated replaces its own late rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            kept.where(F.col(late)).drop(late).write.mode("overwrite").json(f"{side_table}/batch={batch_id}")
            write(kept.where(~F.col(late)).drop(late), batch_id)
        finally:
            kept.unpersist()

    return run
