"""Stateful streams against the batch folds: timers, late rows, restarts, re-delivery."""

import random

import pytest
from pyspark.sql import functions as F

from tilth.operators import progress
from tilth.streaming import folds, late, pauses

HOUR = 3_600_000_000
FAR = 10_000 * HOUR


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


class Feed:
    """A file stream that gets one file a batch."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, path, schema, 0
        path.mkdir()

    def put(self, rows):
        part = self.spark.createDataFrame(rows, self.schema).coalesce(1)
        tmp = self.path.parent / f"tmp{self.n}"
        part.write.parquet(str(tmp))
        (file,) = tmp.glob("*.parquet")
        file.rename(self.path / f"{self.n:04d}.parquet")
        self.n += 1

    def stream(self):
        schema = self.spark.createDataFrame([], self.schema).schema
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(self.path))


EVENTS = "user string, us long, seq long, op string, item long"


def slot_events(seed, n=120):
    rng, rows, at = random.Random(seed), [], 0
    for seq in range(n):
        at += rng.choice([0, 1, HOUR, 20 * HOUR])
        rows.append((rng.choice("ab"), at, seq, rng.choice(["claim", "claim", "claim", "step_back", "release"]), rng.randrange(9)))
    return rows


def start(frame, name, path):
    return frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(path)).outputMode("append").start()


def test_slots_equal_the_batch_fold_over_restarts(rocks, tmp_path):
    rows = slot_events(3)
    feed = Feed(rocks, tmp_path / "in", EVENTS)
    chunks = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    for c in chunks:
        random.Random(1).shuffle(c)  # within a batch, and so within the watermark, any order

    def frame():
        events = feed.stream().withColumn("at", F.timestamp_micros("us")).withWatermark("at", "1 hour")
        return folds.slot_stream(events, "user", "at", "seq", "op", "item")

    got = []
    for i, c in enumerate([*chunks, [("z", FAR, 0, "release", 0)], [("z", FAR + 100 * HOUR, 1, "release", 0)]]):
        feed.put(c)
        q = frame().writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()  # every batch a run of its own, from the checkpoint
        q.stop()
    for user in "ab":
        mine = [r for r in got if r["user"] == user]
        assert [r["at"] for r in mine] == sorted(r["at"] for r in mine)
        assert len([r for r in mine if r["change"] != "opens"]) == sum(r[0] == user for r in rows)
        assert len([r for r in mine if r["change"] == "opens"]) == len({r[1] for r in rows if r[0] == user and r[3] == "step_back"})
        for upto in (30, 77, 119):
            part = [r for r in rows[: upto + 1] if r[0] == user]
            want = progress.slot_ledger(rocks.createDataFrame(part, EVENTS), ["user"], ["us", "seq"], "us", "op", "item").first()
            last = [r for r in mine if r["change"] != "opens"][len(part) - 1]
            assert (last["active"], last["n_refused"], last["n_cooling"], last["next_opens"]) == (",".join(map(str, want["active"])), want["n_refused"], len(want["cooling_until"]), want["next_opens"])


def test_slot_opens_without_a_new_event_and_state_goes(rocks, tmp_path):
    feed = Feed(rocks, tmp_path / "in", EVENTS)
    events = feed.stream().withColumn("at", F.timestamp_micros("us")).withWatermark("at", "0 seconds")
    q = start(folds.slot_stream(events, "user", "at", "seq", "op", "item"), "opens", tmp_path / "cp")
    for i, rows in enumerate([[("a", HOUR, 0, "claim", 4), ("a", 2 * HOUR, 1, "step_back", 4)], [("b", 74 * HOUR - 1, 2, "claim", 1)], [("b", 74 * HOUR + 1000, 3, "release", 1)], [("c", 200 * HOUR, 4, "release", 9)]]):
        feed.put(rows)
        q.processAllAvailable()
        opened = [(r["at"], r["n_cooling"]) for r in rocks.table("opens").where("user = 'a' and change = 'opens'").collect()]
        assert opened == ([] if i < 2 else [(74 * HOUR, 0)])
    held = q.lastProgress["stateOperators"][0]
    q.stop()
    assert held["numRowsTotal"] <= 12  # only the last, unfinished key is left


def test_chunks_equal_the_batch_fold(rocks, tmp_path):
    schema = "chunk string, us long, seq long, ok boolean, decoded string"
    rng = random.Random(5)
    rows = [(rng.choice("abcd"), 60_000_000 * i, i, rng.random() < 0.6, rng.choice(["text", "text", "x"])) for i in range(160)]
    feed = Feed(rocks, tmp_path / "in", schema)
    stream = feed.stream().withColumn("at", F.timestamp_micros("us")).withWatermark("at", "10 minutes")
    q = start(folds.chunk_stream(stream, "chunk", "at", "seq", "ok", "decoded", idle=86_400), "chunks", tmp_path / "cp")
    for c in [rows[:70], rows[70:100], rows[100:], [("z", FAR, 999, True, "text")], [("z", FAR + HOUR, 1000, True, "text")]]:
        feed.put(c)
        q.processAllAvailable()
    q.stop()
    got = rocks.table("chunks").collect()
    want = progress.guided_chunks(rocks.createDataFrame(rows, schema), ["chunk"], ["us", "seq"], "ok", "decoded").collect()
    for w in want:
        mine = sorted((r for r in got if r["chunk"] == w["chunk"] and r["stage"] != "abandoned"), key=lambda r: r["n_attempts"])
        last = mine[-1]
        assert (last["stage"], last["n_attempts"], last["n_blind_fails"], last["fell_back"], last["quality"]) == tuple(w[c] for c in ("stage", "n_attempts", "n_blind_fails", "fell_back", "quality"))
    assert {r["chunk"] for r in got if r["stage"] == "abandoned"} == {w["chunk"] for w in want if w["stage"] != "done"}


def test_late_rows_of_a_watermark_are_counted(rocks, tmp_path):
    feed = Feed(rocks, tmp_path / "in", EVENTS)
    seen = late.LateRows()
    rocks.streams.addListener(seen)
    try:
        events = feed.stream().withColumn("at", F.timestamp_micros("us")).withWatermark("at", "1 hour")
        q = start(folds.slot_stream(events, "user", "at", "seq", "op", "item"), "tardy", tmp_path / "cp")
        for rows in [[("a", 100 * HOUR, 0, "claim", 1)], [("a", 101 * HOUR, 1, "claim", 2)], [("a", 5 * HOUR, 2, "claim", 3), ("b", 6 * HOUR, 3, "claim", 3), ("a", 102 * HOUR, 4, "claim", 5)], [("a", 300 * HOUR, 5, "release", 9)]]:
            feed.put(rows)
            q.processAllAvailable()
        last = q.lastProgress["batchId"]
        q.stop()
        assert seen.wait_for("tardy", last) and seen.dropped["tardy"] == 2
        assert {r["item"] for r in rocks.table("tardy").where("change = 'claim'").collect()} == {1, 2, 5}
    finally:
        rocks.streams.removeListener(seen)


def test_late_samples_are_marked_counted_and_kept_apart(spark, tmp_path):
    schema = "k string, ms long, rms double"
    feed = Feed(spark, tmp_path / "in", schema)
    seen, kept = late.LateRows(), []
    spark.streams.addListener(seen)
    try:
        samples = feed.stream().select("k", F.timestamp_millis("ms").alias("at"), "rms")
        marked = late.observed(pauses.segment_stream(samples, "k", "at", "rms", pauses.PauseConfig(), mark_late=True))
        write = late.apart(lambda b, _: kept.extend(b.collect()), str(tmp_path / "side"))
        q = marked.writeStream.queryName("samples").foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).start()
        for rows in [[("a", t, 0.1) for t in range(1000, 6000, 100)], [("a", 200, 0.1), ("a", 5950, 0.0), ("b", 10, 0.1)], [("a", 300, 0.0), ("a", 400, 0.0), ("b", 5, 0.1)]]:
            feed.put(rows)
            q.processAllAvailable()
        last = q.lastProgress["batchId"]
        q.stop()
        assert seen.wait_for("samples", last) and seen.marked["samples"] == 4
        side = spark.read.json(str(tmp_path / "side"))
        assert sorted((r["k"], r["segment_start"]) for r in side.collect()) == [("a", 200), ("a", 300), ("a", 400), ("b", 5)]
        assert [(r["k"], r["segment_start"], r["segment_end"]) for r in kept] == [("a", 1000, 5000)]
    finally:
        spark.streams.removeListener(seen)


def test_redelivered_rows_are_dropped_and_state_is_bounded(rocks, tmp_path):
    feed = Feed(rocks, tmp_path / "in", "id long, us long")
    stream = feed.stream().withColumn("at", F.timestamp_micros("us"))
    q = start(late.once(stream, ["id"], "at", "2 hours"), "once", tmp_path / "cp")
    most = 0
    for hour in range(0, 40, 2):
        batch = [(100 * hour + i, hour * HOUR) for i in range(10)]
        feed.put(batch + batch[:5] + ([(100 * (hour - 2) + i, hour * HOUR) for i in range(10)] if hour else []))
        q.processAllAvailable()
        most = max(most, q.lastProgress["stateOperators"][0]["numRowsTotal"])
    q.stop()
    assert rocks.table("once").count() == rocks.table("once").select("id").distinct().count() == 200
    assert most <= 60
