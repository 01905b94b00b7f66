"""Naming votes, letters and spans, error reports, index documents, flags, batch inputs."""

from pyspark.sql import functions as F

from tilth.functions import keys, text
from tilth.operators import grading, quality
from tilth.sources import sinks


def test_votes(spark):
    files = spark.createDataFrame([("a/001002.mp3",), ("a/001003.mp3",), ("2/255.mp3",), ("x.mp3",)], "path string")
    assert tuple(keys.votes(files, "path").first()) == ("concat_3_3", 2)
    assert keys.votes(files.where("path = 'x.mp3'"), "path").count() == 0


def test_letters_and_spans(spark):
    df = spark.createDataFrame([("بِس م", 3.0), ("", 1.0), ("a b", 1.0)], "t string, d double")
    got = [r["p"] for r in df.select(text.letter_positions(F.col("t")).alias("p")).collect()]
    assert got == [[0, 2, 4], [], [0, 2]]
    spans = [r["s"] for r in df.where("t <> ''").select(text.uniform_spans(F.col("t"), F.col("d")).alias("s")).collect()]
    assert [s if s is None else tuple(s) for s in spans[0]] == [(0.0, 1.0), None, (1.0, 2.0), None, (2.0, 3.0)]
    back = df.where("t = 'a b'").select(text.scatter_spans(F.col("t"), F.array(F.lit(7), F.lit(8))).alias("s")).first()["s"]
    assert back == [7, None, 8]


def test_client_errors(spark):
    rows = [("s", i, ("m" * 250) + str(i) if i < 3 else f"m{i}", "k" * 9000, "c" * 400) for i in range(12)]
    df = spark.createDataFrame(rows, "session string, t int, message string, stack string, context string")
    got = quality.client_errors(df, "session", ["t"], "message", "stack", "context").orderBy("t").collect()
    assert [r["t"] for r in got] == [0, 3, 4, 5, 6] and len(got[0]["stack"]) == 8000 and len(got[0]["context"]) == 300


def test_index_and_flags(spark):
    files = spark.createDataFrame([("r", 2, 10, "b"), ("r", 2, 9, "a"), ("q", 1, 1, "c")], "reciter string, surah int, ayah int, audio_path string")
    got = {r["reciter"]: r for r in sinks.index_documents(files).withColumn("map", F.to_json("map")).collect()}
    assert got["r"]["map"] == '{"2:9":"a","2:10":"b"}' and got["q"]["missing_count"] == 6235
    audio = files.withColumns({"verified": F.lit(True), "flag_reason": F.lit(None).cast("string")})
    bad = spark.createDataFrame([("r", 2, 9, "empty"), ("r", 2, 9, "empty"), ("z", 1, 1, "x")], "reciter string, surah int, ayah int, reason string")
    flagged = sinks.flag(audio, bad, ["reciter", "surah", "ayah"])
    assert {(r["ayah"], r["verified"], r["flag_reason"]) for r in flagged.collect()} == {(9, False, "empty"), (10, True, None), (1, True, None)}
    assert sinks.reset_flags(flagged).where("verified and flag_reason is null").count() == 3


def test_batch_inputs(spark):
    files = spark.createDataFrame([("d/001007.wav",), ("d/noname.wav",), ("d/114_250.wav",)], "path string")
    verses = spark.createDataFrame([(1, 7, "t")], "surah int, ayah int, text string")
    good, skipped = grading.batch_inputs(files, verses)
    assert [r["path"] for r in good.collect()] == ["d/001007.wav"]
    assert {(r["path"], r["reason"]) for r in skipped.collect()} == {("d/noname.wav", "no verse in the name"), ("d/114_250.wav", "no such verse")}
