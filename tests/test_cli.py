"""The command line end to end on a small book."""

import json
import struct

from tilth import cli


def wav(seconds, rate=8000):
    data = bytes(int(seconds * rate) * 2)
    body = b"WAVE" + struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16) + struct.pack("<4sI", b"data", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_book_from_files_to_bands(spark, tmp_path):
    at = lambda *p: str(tmp_path.joinpath(*p))
    (tmp_path / "text.txt").write_text("".join(f"{s}|{a}|{'letters of verse ' * (a + 1)}\n" for s in (1, 2) for a in range(1, 11)))
    (tmp_path / "ann.json").write_text(json.dumps([{"surah": 1, "ayah": 1, "annotations": [{"start": 0, "end": 3, "rule": "Madd 2"}, {"start": 5, "end": 500, "rule": "iqlab"}]}, {"surah": 9, "ayah": 9, "annotations": [{"start": 0, "end": 1, "rule": "iqlab"}]}]))
    assert cli.main(["ingest", "--text", at("text.txt"), "--annotations", at("ann.json"), "--dead-letter", at("dead"), "--out", at("segments")]) == 0
    got = spark.read.parquet(at("segments")).collect()
    assert [(r["rule"], r["segment"], r["word"]) for r in got] == [("madd_2", "let", "letters")]
    assert spark.read.json(at("dead")).count() == 1

    for r, n in (("r1", 10), ("r2", 8)):
        for s in (1, 2):
            for a in range(1, n + 1):
                f = tmp_path / "audio" / r / f"{s:03d}{a:03d}.mp3"
                f.parent.mkdir(parents=True, exist_ok=True)
                f.write_bytes(b"x" * 2000)
    (tmp_path / "audio" / "r1" / "z001001.mp3").write_bytes(b"x")
    assert cli.main(["index", "--audio-root", at("audio"), "--out", at("index")]) == 0
    index = spark.read.parquet(at("index"))
    assert index.count() == 36 and index.agg({"n_duplicates": "sum"}).first()[0] == 1

    rows = [(r, s, a, 2000 if a != 3 else 10, 2.0 + 3.0 * a if (s, a) != (2, 7) else 900.0) for r in ("r1", "r2") for s in (1, 2) for a in range(1, 9)]
    spark.createDataFrame(rows, "reciter string, surah int, ayah int, length long, duration double").write.parquet(at("durations"))
    assert cli.main(["audit", "--text", at("text.txt"), "--index", at("index"), "--durations", at("durations"), "--out", at("work")]) == 0
    work = spark.read.csv(at("work"), sep="\t", header=True).collect()
    by = {}
    for w in work:
        by.setdefault(w["reason"], []).append((w["reciter"], w["surah"], w["ayah"]))
    assert len(by["missing"]) == 4 and len(by["tiny"]) == 4 and sorted(by["too_long"]) == [("r1", "2", "7"), ("r2", "2", "7")]

    assert cli.main(["correct", "--index", at("index"), "--worklist", at("work"), "--include-plausibility", "--flag-ratio-high", "5", "--apply", "--out", at("index2")]) == 0
    assert spark.read.parquet(at("index2")).count() == 36 - 6

    lines = [{"reciter": "r1", "surah": 5, "ayah": i, "results": [{"rule": "madd_6", "harakat": v, "nasality": None}, {"rule": "iqlab", "harakat": 1.0 + i / 10, "nasality": 0.2 + i / 100}]} for i, v in enumerate((8.0, 8.2, 7.8, 8.1, 7.9, 8.3, 2.0))] + [{"reciter": "r1", "surah": 5, "ayah": 99, "results": []}]
    (tmp_path / "cp.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert cli.main(["calibrate", "--checkpoint", at("cp.jsonl"), "--out", at("bands")]) == 0
    bands = {r["rule"]: r for r in spark.read.parquet(at("bands")).collect()}
    assert bands["madd_6"]["n"] == 6 and bands["madd_6"]["lo"] == 7.8 and bands["madd_6"]["one_sided"]
    assert abs(bands["iqlab"]["nasal_lo"] - 0.21) < 1e-9


def test_audit_of_files_corrections_and_audio_rows(spark, tmp_path):
    at = lambda *p: str(tmp_path.joinpath(*p))
    (tmp_path / "text.txt").write_text("".join(f"1|{a}|{'letters of verse ' * (a % 7 + 1)}\n" for a in range(1, 21)))
    for a in range(1, 20):
        f = tmp_path / "audio" / "r1" / f"001{a:03d}.wav"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"" if a == 5 else b"nothing known " * 200 if a == 6 else wav((a % 7 + 1) * (40 if a == 9 else 1) * 0.5))
    (tmp_path / "audio" / "r1" / "x001001.wav").write_bytes(wav(1))
    (tmp_path / "audio" / "r1" / "001099.wav").write_bytes(wav(1))
    assert cli.main(["audit", "--text", at("text.txt"), "--audio-root", at("audio"), "--deep", "--report", at("report"), "--cap", "1", "--out", at("work")]) == 0
    work = {(int(r["ayah"]), r["reason"]) for r in spark.read.csv(at("work"), sep="\t", header=True).collect()}
    assert work == {(20, "missing"), (5, "empty"), (6, "unreadable"), (9, "too_long")}
    report = spark.read.json(at("report")).first()
    assert (report["present"], report["extra"], report["duplicates"], report["n_missing"], report["n_broken"], report["n_odd"], report["checked"], report["ok"]) == (20, 1, 1, 1, 2, 1, 19, 17)
    assert len(report["broken"]) == 1
    assert cli.main(["audit", "--text", at("text.txt"), "--audio-root", at("audio"), "--layers", "integrity", "--sample", "4", "--out", at("some")]) == 0

    (tmp_path / "map.json").write_text(json.dumps({"multi_reciter": True, "map": {"r1": {f"1:{a}": f"r1/{a}.wav" for a in range(1, 20)}}}))
    (tmp_path / "ann.json").write_text(json.dumps([{"surah": 1, "ayah": a, "annotations": [{"start": 0, "end": 3, "rule": "iqlab"}] * 2} for a in (1, 2)]))
    ingest = ["ingest", "--text", at("text.txt"), "--annotations", at("ann.json"), "--audio-map", at("map.json"), "--audio-out", at("rows"), "--out", at("segments")]
    assert cli.main(ingest) == 0
    rows = cli.store.KeyedStore(spark, at("rows"), ["surah", "ayah", "reciter"])
    assert rows.read().count() == 2
    assert cli.main([*ingest, "--seed-audio"]) == 0 and rows.read().count() == 19 and rows.read().where("not verified").count() == 0

    assert cli.main(["index", "--audio-root", at("audio"), "--out", at("index")]) == 0
    correct = ["correct", "--index", at("index"), "--worklist", at("work"), "--audio", at("rows"), "--out", at("index2")]
    assert cli.main(correct) == 0 and rows.read().where("not verified").count() == 0
    assert cli.main([*correct, "--apply"]) == 0
    assert {(r["ayah"], r["flag_reason"]) for r in rows.read().where("not verified").collect()} == {(5, "integrity:empty"), (6, "integrity:unreadable")}
    assert cli.main([*correct, "--apply", "--include-plausibility"]) == 0
    assert rows.read().where("ayah = 9").first()["flag_reason"] == "review:too_long" and spark.read.parquet(at("index2")).where("ayah in (5, 6, 9)").count() == 0
    assert cli.main([*correct, "--apply", "--reset-flags"]) == 0 and rows.read().where("not verified").count() == 0
