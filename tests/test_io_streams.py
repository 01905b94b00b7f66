"""Readers, sinks and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tilth.sources import readers, sinks, store
from tilth.streaming import pauses, windows


def test_verse_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text("﻿1|1|first \n\n1|2\nx|1|bad\n1|3|a|b\n1|1|again\n2|1| other\n", encoding="utf-8")
    got = {(r["surah"], r["ayah"]): r["text"] for r in readers.read_verses(spark, str(tmp_path / "t.txt")).collect()}
    assert got == {(1, 1): "again", (2, 1): "other"}
    (tmp_path / "e.txt").write_text("nothing\n")
    with pytest.raises(Exception, match="no verses"):
        readers.read_verses(spark, str(tmp_path / "e.txt")).collect()


def test_annotations_and_maps(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"surah": 1, "ayah": 2, "annotations": [{"start": 0, "end": 3, "rule": "madd_2"}, {"start": 4, "end": 5, "rule": "iqlab"}]}, {"surah": 1, "ayah": 3, "annotations": []}]))
    assert readers.read_annotations(spark, str(tmp_path / "a.json")).count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"multi_reciter": True, "map": {"r1": {"1:1": "a.mp3", "bad": "x", "1:2": ""}, "r2": {"2:3": "b.mp3"}}}))
    got = sorted((r["reciter"], r["surah"], r["ayah"], r["audio_path"]) for r in readers.read_audio_index(spark, str(tmp_path / "m.json")).collect())
    assert got == [("r1", 1, 1, "a.mp3"), ("r2", 2, 3, "b.mp3")]
    (tmp_path / "f.json").write_text(json.dumps({"multi_reciter": False, "map": {"1:1": "a.mp3"}}))
    assert readers.read_audio_index(spark, str(tmp_path / "f.json")).first()["reciter"] == "default"
    (tmp_path / "n.json").write_text("{}")
    with pytest.raises(Exception, match="no map"):
        readers.read_audio_index(spark, str(tmp_path / "n.json")).collect()
    (tmp_path / "s.json").write_text(json.dumps({"1": {"surah_name_ar": " x ", "surah_name_en": "Opening", "surah_name_tr": "t", "ayahs": {"1": {"ayah_en": "In", "ayah_tr": None}}}}))
    assert readers.read_surahs(spark, str(tmp_path / "s.json")).first()["ayah_count"] == 0
    assert readers.read_translations(spark, str(tmp_path / "s.json")).first()["transliteration"] == ""


def test_listing(spark, tmp_path):
    (tmp_path / "r").mkdir()
    for n in ("r/001001.mp3", "r/notes.txt", "002255.MP3"):
        (tmp_path / n).write_bytes(b"x" * 7)
    got = readers.list_files(spark, str(tmp_path))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in got.collect()) == ["001001.mp3", "002255.MP3"]
    assert got.agg(F.sum("length")).first()[0] == 14


def test_upsert_and_replay(spark, tmp_path):
    target, keys = str(tmp_path / "t"), ["surah", "ayah"]
    rows = lambda x: spark.createDataFrame(x, "surah int, ayah int, text string, ts string")
    sinks.upsert(spark, rows([(1, 1, "a", "1"), (1, 1, "b", "2"), (1, 2, "c", "1")]), target, keys, ["ts"])
    path = sinks.upsert(spark, rows([(1, 2, "d", "3")]), target, keys, ["ts"])
    assert {(r["surah"], r["ayah"], r["text"]) for r in spark.read.parquet(path).collect()} == {(1, 1, "b"), (1, 2, "d")}
    good, bad = sinks.split_valid(rows([(1, 1, "a", "1"), (0, 1, "x", "1"), (None, 1, "y", "1")]), F.col("surah").between(1, 114), F.lit("surah"))
    assert good.count() == 1 and bad.count() == 2
    letters = str(tmp_path / "dead")
    sinks.dead_letters(rows([(3, 3, "late", "9")]), "verses", letters, "2024-01-01T00:00:00Z")
    sinks.dead_letters(bad.drop("reason"), "_input", letters, "2024-01-01T00:00:00Z")
    (tmp_path / "dead" / "junk.json").write_text("not json\n{}\n")
    counts = sinks.replay(spark, letters, str(tmp_path / "rest"), str(tmp_path / "db"), {"verses": "surah int, ayah int, text string"})
    assert counts == {"verses": 1} and spark.read.text(str(tmp_path / "rest")).count() == 4
    with pytest.raises(ValueError):
        sinks.replay(spark, letters, letters, target, {})
    with pytest.raises(ValueError):
        sinks.conflict_keys("nope")


def plain_cuts(samples, c):
    spoke, quiet, start, n, cuts = False, None, None, 0, []
    for now, rms in samples:
        start = now if start is None else start
        n, speaking = n + 1, rms > c.speech
        quiet = None if speaking or not spoke else (now if quiet is None else quiet)
        if (now - start >= c.longest and (spoke or speaking)) or (spoke and not speaking and now - quiet >= c.pause and now - start >= c.shortest):
            cuts.append((start, now, n))
            spoke, quiet, start, n = False, None, now, 0
        else:
            spoke = spoke or speaking
    return cuts


def noise():
    import random

    rng = random.Random(8)
    return [(k, t * 100, rng.choice([0.0, 0.0, 0.1]) if (t // 15) % 2 else 0.1) for k in ("a", "b") for t in range(200)]


def test_pauses_batch(spark):
    c = pauses.PauseConfig()
    got = pauses.segments(spark.createDataFrame(noise(), "k string, t long, rms double"), ["k"], ["t"], "t", "rms", c).collect()
    for key in ("a", "b"):
        assert sorted((r["segment_start"], r["segment_end"], r["n_samples"]) for r in got if r["k"] == key) == plain_cuts([x[1:] for x in noise() if x[0] == key], c)


def test_pauses_stream_equals_batch(spark, tmp_path):
    c = pauses.PauseConfig()
    data = spark.createDataFrame(noise(), "k string, t long, rms double").withColumn("at", F.timestamp_millis("t")).drop("t")
    for i, (lo, hi) in enumerate(((0, 7), (7, 13), (13, 99))):
        data.where(f"unix_millis(at) >= {lo * 1000} and unix_millis(at) < {hi * 1000}").coalesce(1).write.parquet(str(tmp_path / f"in/b{i}"))
    import os

    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(3):
        part = next(p for p in (tmp_path / f"in/b{i}").iterdir() if p.suffix == ".parquet")
        os.rename(part, flat / f"{i}.parquet")
        os.utime(flat / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(flat))
    q = pauses.segment_stream(stream, "k", "at", "rms", c).writeStream.format("memory").queryName("cuts").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("cuts").collect()
    for key in ("a", "b"):
        assert sorted((r["segment_start"], r["segment_end"], r["n_samples"]) for r in got if r["k"] == key) == plain_cuts([x[1:] for x in noise() if x[0] == key], c)


def test_level_stream_and_keyed_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "event_type", "event_id", "ts", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windows.event_time(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "1 hour")
    target = str(tmp_path / "latest")
    q = stream.writeStream.foreachBatch(windows.keyed_batches(target, ["user_id", "event_type"], ["ts", "event_id"])).option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    q.awaitTermination()
    latest = store.KeyedStore(spark, target, ["user_id", "event_type"]).read()
    assert latest.count() == events.select("user_id", "event_type").distinct().count()
    q = windows.level_stream(windows.event_time(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "1 hour"), "ts", ["event_type"], "value", "3200 seconds", "1600 seconds")
    q = q.writeStream.format("memory").queryName("levels").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    n = spark.table("levels").agg(F.sum("n")).first()[0]
    assert n == 2 * events.count()


def test_sticky(spark):
    rows = [("w", 1, "green"), ("w", 2, "red"), ("v", 1, "red"), ("v", 2, "red")]
    got = windows.sticky_verdicts(spark.createDataFrame(rows, "k string, s int, v string"), ["k"], "s", F.col("v") != "red", "v").collect()
    assert {(r["k"], r["v"]) for r in got} == {("w", "green"), ("v", "red")}


def test_failing_batch_is_tried_again(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    tries, waits = [], []
    real = store.KeyedStore.upsert

    def fails(times):
        def run(self, *args, **kw):
            tries.append(1)
            if len(tries) <= times:
                raise OSError("busy")
            return real(self, *args, **kw)

        return run

    monkeypatch.setattr(store.KeyedStore, "upsert", fails(2))
    windows.keyed_batches(str(tmp_path / "t"), ["k"], ["v"], backoff=0.5, wait=waits.append)(rows, 0)
    assert len(tries) == 3 and waits == [0.5, 1.0]
    table = store.KeyedStore(spark, str(tmp_path / "t"), ["k"])
    assert {(r["k"], r["v"]) for r in table.read().collect()} == {(1, "b"), (2, "c")}
    tries.clear()
    monkeypatch.setattr(store.KeyedStore, "upsert", fails(9))
    with pytest.raises(OSError):
        windows.keyed_batches(str(tmp_path / "t"), ["k"], ["v"], wait=waits.append)(rows, 1)
    assert len(tries) == 3 and table.versions() == [0]


def test_restart_skips_finished_keys(spark, tmp_path):
    path, seen = str(tmp_path / "done"), []
    work = lambda n: spark.createDataFrame([("r", i) for i in range(n)], "reciter string, ayah int")

    def process(rows):
        seen.extend(r["ayah"] for r in rows.collect())
        return rows.withColumn("harakat", F.col("ayah") * 1.5)

    assert sinks.resume(spark, work(3), ["reciter", "ayah"], process, path) == 3
    with pytest.raises(ValueError):  # a run that dies appends nothing
        sinks.resume(spark, work(5), ["reciter", "ayah"], lambda rows: (_ for _ in ()).throw(ValueError()), path)
    assert sinks.resume(spark, work(5), ["reciter", "ayah"], process, path) == 2
    assert sinks.resume(spark, work(5), ["reciter", "ayah"], process, path) == 0
    assert sorted(seen) == [0, 1, 2, 3, 4] and spark.read.json(path).count() == 5


def test_bounded_buffer_and_skipped_ticks(spark, tmp_path):
    import time

    schema = "k string, at timestamp, x double"
    batches = [[("a", t, 1.0) for t in range(0, 5000, 500)], [("a", t, 3.0) for t in range(5000, 6000, 500)] + [("b", 0, 2.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, ms long, x double").select("k", F.timestamp_millis("ms").alias("at"), "x").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    (tmp_path / "in").mkdir()
    for i in range(2):
        for f in (tmp_path / f"in{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
            time.sleep(1.1)
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windows.recent_levels(stream(), "k", "at", "x", 1000).writeStream.format("memory").queryName("recent").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["k"], r["at_ms"], r["n"], r["rms"]) for r in spark.table("recent").collect()) == [("a", 4500, 2, 1.0), ("a", 5500, 2, 3.0), ("b", 0, 1, 2.0)]
    began = []

    def slow(batch, _):
        began.append(time.monotonic())
        batch.count()
        time.sleep(1.5)

    q = windows.start_ticks(stream(), slow, str(tmp_path / "c2"), "1 second")
    q.processAllAvailable()
    q.stop()
    assert len(began) == 2 and began[1] - began[0] >= 1.5


def wav(samples, rate=8000, bits=16, channels=1, cut=0):
    import struct

    data = b"".join(int(x * (1 << (bits - 1))).to_bytes(bits // 8, "little", signed=True) for x in samples)
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    body = b"WAVE" + head + struct.pack("<4sI", b"data", len(data)) + data
    return (b"RIFF" + struct.pack("<I", len(body)) + body)[: len(body) + 8 - cut]


def test_headers_and_waveforms(spark, tmp_path):
    frame = bytes((0xFF, 0xFB, 0x90, 0x00)) + bytes(413)  # 128 kbit/s at 44100: 417 bytes, 1152 samples
    files = {
        "ok.wav": wav([0.5, -0.5] * 400), "wide.wav": wav([0.25] * 1200, bits=24), "two.wav": wav([0.5, 0.25] * 400, channels=2),
        "none.wav": b"", "tiny.wav": wav([0.1] * 4), "zero.wav": b"RIFF" + wav([])[4:] + b"junk" + (600).to_bytes(4, "little") + bytes(600),
        "bad.wav": b"RIFF\x00\x00\x00\x00WAVE" + bytes(700), "text.mp3": b"hello " * 200, "ok.mp3": b"ID3\x04\x00\x00\x00\x00\x00\x0a" + bytes(10) + frame * 100, "bad.mp3": b"\xff" + bytes(900),
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1]: r for r in readers.probe_files(spark, str(tmp_path), 500).collect()}
    status = {n: r["status"] for n, r in got.items()}
    assert status == {
        "ok.wav": "ok", "wide.wav": "ok", "two.wav": "ok", "tiny.wav": "tiny", "zero.wav": "zero_duration", "bad.wav": "corrupt",
        "text.mp3": "unreadable", "ok.mp3": "ok", "bad.mp3": "corrupt", "none.wav": "empty",
    }
    assert got["ok.wav"]["duration"] == 0.1 and got["ok.wav"]["bitrate"] == 128_000
    assert got["ok.mp3"]["duration"] == pytest.approx(100 * 1152 / 44100) and got["ok.mp3"]["bitrate"] == pytest.approx(128_000, rel=0.01)
    waves = {r["path"].rsplit("/", 1)[1]: r for r in readers.read_waveforms(spark, str(tmp_path)).collect()}
    assert waves["ok.wav"]["rate"] == 8000 and waves["ok.wav"]["signal"][:2] == [0.5, -0.5]
    assert set(waves["wide.wav"]["signal"]) == {0.25} and waves["two.wav"]["signal"] == [0.375] * 400
    assert all(waves[n]["rate"] is None and waves[n]["signal"] is None for n in ("bad.wav", "text.mp3", "ok.mp3"))


def test_settings(tmp_path):
    from tilth import settings

    path = tmp_path / "env"
    path.write_text("# note\n\nA=1\nexport B = 'two words'\nC=x # why\n=3\nbroken\n")
    assert settings.read_file(str(path)) == {"A": "1", "B": "two words", "C": "x"}
    assert settings.setting("A", path=str(path), environ={"A": "9"}) == "9"
    assert settings.setting("B", path=str(path), environ={}) == "two words" and settings.setting("D", "d", str(path), {}) == "d"
    assert settings.load(str(tmp_path / "no"), {}) == {}


def test_reciters_and_colours(spark):
    from tilth.sources import dimensions

    assert dimensions.reciters(spark).count() == 30
    rows = spark.createDataFrame([("alafasy", "iqlab"), ("nobody", "other"), (None, None)], "reciter string, rule string")
    got = dimensions.with_reciter_names(rows).select("reciter_name", dimensions.rule_colour(F.col("rule")).alias("c")).collect()
    assert {(r["reciter_name"], r["c"]) for r in got} == {("Mishary Alafasy", "#7E57C2"), ("nobody", "#C9A227"), (None, "#C9A227")}
