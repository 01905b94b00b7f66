"""Readers: delimited verse text, annotation arrays, nested JSON maps, JSON lines, file listings.

Lenient where the data are: what doesn't parse is dropped or quarantined, as each docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilth.operators.quality import integrity
from tilth.sources import audio_files

ANNOTATIONS = T.StructType(
    [
        T.StructField("surah", T.IntegerType()),
        T.StructField("ayah", T.IntegerType()),
        T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("rule", T.StringType())]))),
    ]
)


def required(df: DataFrame, what: str) -> DataFrame:
    """Fails when read if ``df`` is empty, else ``df``."""
    counted = df.agg(F.assert_true(F.count(F.lit(1)) > 0, F.lit(f"no {what}")).alias("_ok"))
    return df.crossJoin(F.broadcast(counted)).where("_ok is null").drop("_ok")  # one row


def split_lines(lines: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON text -> (rows with ``record``, quarantined rows); text that doesn't parse is quarantined."""
    fields = f"{schema}, _bad string"
    parsed = lines.withColumn("record", F.from_json(column, fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("record").isNull() | F.col("record._bad").isNotNull()
    return parsed.where(~bad), parsed.where(bad).drop("record")


def verse_lines(lines: DataFrame) -> DataFrame:
    """``value`` lines ``surah|ayah|text`` -> surah, ayah, text.

    A byte-order mark is ignored; lines without exactly three fields or with keys other than ASCII
    digits are dropped, fields trimmed; of a repeated key the last line (by ``line``) stays.
    """
    parts = F.split(F.regexp_replace("value", "^﻿", ""), r"\|")
    rows = lines.select("line", parts.alias("p")).where(F.size("p") == 3).select("line", *[F.trim(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(("s", "a", "text"))])
    rows = rows.where(F.col("s").rlike("^[0-9]+$") & F.col("a").rlike("^[0-9]+$")).select("line", F.col("s").try_cast("int").alias("surah"), F.col("a").try_cast("int").alias("ayah"), "text")
    best = rows.groupBy("surah", "ayah").agg(F.max(F.struct("line", "text")).alias("b"))
    return best.select("surah", "ayah", F.col("b.text").alias("text"))


def read_verses(spark: SparkSession, path: str) -> DataFrame:
    """Verse text from a file or folder; an empty result is an error."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("line"))
    return required(verse_lines(lines), "verses")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of verses with annotations -> surah, ayah, start, end, rule, a row per annotation."""
    return spark.read.schema(ANNOTATIONS).json(path, multiLine=True).select("surah", "ayah", F.explode("annotations").alias("a")).select("surah", "ayah", "a.start", "a.end", "a.rule")


def read_surahs(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object keyed by surah -> surah, names, ayah_count (0 where absent); an empty one is an error."""
    inner = "struct<surah_name_ar: string, surah_name_en: string, surah_name_tr: string, ayah_count: int>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {inner}>")).alias("k", "v"))
    found = rows.select(F.col("k").try_cast("int").alias("surah"), *[F.trim(F.col(f"v.surah_{n}")).alias(n) for n in ("name_ar", "name_en", "name_tr")], F.coalesce("v.ayah_count", F.lit(0)).alias("ayah_count"))
    return required(found.where("surah is not null"), "surahs")


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    """Nested objects surah -> ayah -> texts, as surah, ayah, translation, transliteration ('' where null)."""
    kind = "map<string, struct<ayahs: map<string, struct<ayah_en: string, ayah_tr: string>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("s", "v")).select("s", F.explode("v.ayahs").alias("a", "t"))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    return rows.select(F.col("s").try_cast("int").alias("surah"), F.col("a").try_cast("int").alias("ayah"), text("t.ayah_en").alias("translation"), text("t.ayah_tr").alias("transliteration"))


def read_audio_index(spark: SparkSession, path: str) -> DataFrame:
    """A file index (reciter -> ``s:a`` -> path, or flat) -> reciter, surah, ayah, audio_path; no ``map`` is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "struct<multi_reciter: boolean, map: map<string, string>>").alias("d"))
    raw = raw.select("d.multi_reciter", F.coalesce("d.map", F.raise_error(F.lit("the index has no map"))).alias("m")).select("multi_reciter", F.explode("m").alias("k", "v"))
    nested = raw.where("multi_reciter").select(F.col("k").alias("reciter"), F.explode(F.from_json("v", "map<string, string>")).alias("key", "audio_path"))
    flat = raw.where("not coalesce(multi_reciter, false)").select(F.lit("default").alias("reciter"), F.col("k").alias("key"), F.col("v").alias("audio_path"))
    key = F.split("key", ":")
    return nested.unionByName(flat).select("reciter", F.get(key, F.lit(0)).try_cast("int").alias("surah"), F.get(key, F.lit(1)).try_cast("int").alias("ayah"), "audio_path").where("surah is not null and ayah is not null and audio_path <> ''")


def list_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = audio_files.EXTENSIONS) -> DataFrame:
    """Files below a folder by extension, also such without bytes: path, length; contents are never read."""
    audio_files.register(spark)
    return spark.read.format("audio_listing").option("extensions", ",".join(extensions)).load(path)


def read_dead_letters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines ``{ts, table, row}`` -> (replayable rows, skipped): malformed, without a table or row, or of a table in ``_``."""
    good, bad = split_lines(spark.read.text(path), "value", "ts string, table string, row string")
    ok = F.col("record.table").isNotNull() & F.col("record.row").isNotNull() & ~F.coalesce(F.startswith("record.table", F.lit("_")), F.lit(True))
    rows = good.where(ok).select("record.ts", "record.table", "record.row")
    return rows, bad.select("value").unionByName(good.where(~F.coalesce(ok, F.lit(False))).select("value"))


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Calibration checkpoint lines -> reciter, surah, ayah, rule, harakat, nasality; verses without results give one row of nulls."""
    schema = "reciter string, surah int, ayah int, results array<struct<rule: string, harakat: double, nasality: double>>"
    return spark.read.schema(schema).json(path).select("reciter", "surah", "ayah", F.explode_outer("results").alias("r")).select("reciter", "surah", "ayah", "r.rule", "r.harakat", "r.nasality")


def probe_files(spark: SparkSession, path: str, least_bytes: int = 1024, extensions: tuple[str, ...] = audio_files.EXTENSIONS) -> DataFrame:
    """Audio files below a folder by their headers: path, length, duration in seconds, bitrate, status, bytes_read.

    The ladder of ``quality.integrity``: missing, empty, tiny, unreadable (no known container), corrupt (one whose header
    doesn't hold together), zero_duration, ok. WAVE, MPEG layer III, ADTS, FLAC, Ogg (Vorbis, Opus, FLAC) and MP4 are known.
    Only ranges of a file are read. Long MPEG and ADTS files without a table of frames are measured by their first 64 KB.
    """
    audio_files.register(spark)
    found = spark.read.format("audio_headers").option("extensions", ",".join(extensions)).load(path)
    status = integrity(F.col("length"), F.col("duration"), F.col("known"), least_bytes)
    return found.select("path", "length", F.when(status.isin("ok", "zero_duration"), F.col("duration")).alias("duration"), F.when(status == "ok", F.col("bitrate")).alias("bitrate"), status.alias("status"), "bytes_read")


def read_waveforms(spark: SparkSession, path: str) -> DataFrame:
    """Audio files -> path, rate, signal (mono, -1 to 1); both null where a file isn't a readable WAVE file, so that measures go by durations alone."""
    audio_files.register(spark)
    return spark.read.format("audio_waveforms").load(path)
