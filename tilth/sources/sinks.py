"""Keyed upserts as new versions of a table, dead letters, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.operators.quality import last_wins

# Keys that identify a row of each table.
CONFLICT_KEYS = {
    "surahs": ["surah"],
    "juz": ["juz"],
    "pages": ["page"],
    "verses": ["surah", "ayah"],
    "segments": ["surah", "ayah", "rule", "start_idx", "end_idx"],
    "ayah_audio": ["surah", "ayah", "reciter"],
}


def conflict_keys(table: str) -> list[str]:
    if table not in CONFLICT_KEYS:
        raise ValueError(f"unknown table {table}")
    return CONFLICT_KEYS[table]


def versions(spark: SparkSession, target: str) -> list[int]:
    """Finished versions below ``target``, by the marker that Spark's writer leaves."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(target)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    return sorted(int(p.getName()[8:]) for p in found if p.getName().startswith("version=") and fs.exists(hadoop.Path(p, "_SUCCESS")))


def upsert(spark: SparkSession, rows: DataFrame, target: str, keys: list[str], order: list[str], version: int | None = None) -> str:
    """Merge ``rows`` into the newest version of ``target``; the last per key in ``order`` wins. -> the path written.

    The result is a new version, so readers never see half a table and a retry overwrites its own.
    """
    done = [v for v in versions(spark, target) if version is None or v < version]
    number = (done[-1] + 1 if done else 0) if version is None else version
    new = last_wins(rows, keys, order).select(rows.columns)
    if done:
        old = spark.read.parquet(f"{target}/version={done[-1]}")
        new = old.join(new.select(*keys), keys, "left_anti").unionByName(new)
    path = f"{target}/version={number}"
    new.write.mode("overwrite").parquet(path)
    return path


def split_valid(rows: DataFrame, valid: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``reason``), so that bad rows never fail a write."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok).withColumn("reason", reason)


def dead_letters(bad: DataFrame, table: str, path: str, ts: str) -> None:
    """Append rows as JSON lines ``{ts, table, row}``."""
    bad.select(F.lit(ts).alias("ts"), F.lit(table).alias("table"), F.to_json(F.struct(*bad.columns)).alias("row")).write.mode("append").json(path)


def replay(spark: SparkSession, infile: str, residual: str, target: str, schemas: dict[str, str]) -> dict[str, int]:
    """Upsert replayable dead letters per table; what can't be replayed goes to another place than the input.

    -> rows replayed per table. Lines of unknown tables and of ones without a schema are residual.
    """
    from tilth.sources.readers import read_dead_letters

    if residual.rstrip("/") == infile.rstrip("/"):
        raise ValueError("the residual must not be the input")
    rows, skipped = read_dead_letters(spark, infile)
    counts = {}
    known = [t for t in schemas if t in CONFLICT_KEYS]
    for table in known:
        part = rows.where(F.col("table") == table).withColumn("r", F.from_json("row", schemas[table])).select("ts", "r.*")
        counts[table] = part.count()
        if counts[table]:
            upsert(spark, part, f"{target}/{table}", CONFLICT_KEYS[table], ["ts"])
    left = rows.where(~F.col("table").isin(*known)) if known else rows
    left.select(F.to_json(F.struct("ts", "table", "row")).alias("value")).unionByName(skipped.select("value")).write.mode("overwrite").text(residual)
    return counts


def resume(spark: SparkSession, work: DataFrame, keys: list[str], process, path: str) -> int:
    """Process the rows of ``work`` whose ``keys`` the checkpoint below ``path`` doesn't hold yet, and append to it. -> rows left over by earlier runs.

    ``process(rows)`` gives ``keys`` and result columns. Each run appends its results as JSON lines in
    one commit: a run that fails appends nothing and is repeated, finished keys are never processed again.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    left = work
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        done = spark.read.schema(work.select(*keys).schema).json(path).distinct()
        left = work.join(done, keys, "left_anti")
    n = left.count()
    if n:
        process(left).write.mode("append").json(path)
    return n


def write_worklist(problems: DataFrame, path: str) -> None:
    """Tab-separated repair list."""
    problems.write.mode("overwrite").csv(path, sep="\t", header=True)


def index_documents(files: DataFrame, total: int = 6236) -> DataFrame:
    """One row per reciter for a JSON sink: reciter, count, missing_count, map of ``s:a`` to path in key order."""
    key = F.concat_ws(":", F.col("surah").cast("string"), F.col("ayah").cast("string"))
    entries = F.array_sort(F.collect_list(F.struct("surah", "ayah", key.alias("key"), "audio_path")))
    grouped = files.dropDuplicates(["reciter", "surah", "ayah"]).groupBy("reciter").agg(entries.alias("e"))
    n = F.size("e")
    return grouped.select("reciter", n.alias("count"), (F.lit(total) - n).alias("missing_count"), F.map_from_entries(F.transform("e", lambda x: F.struct(x["key"], x["audio_path"]))).alias("map"))


def flag(audio: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    """Audio rows with ``verified`` false and the reason where ``bad`` (keys, reason) names them, else as they were."""
    marks = bad.select(*keys, F.col("reason").alias("_reason")).dropDuplicates(keys)
    j = audio.join(marks, keys, "left")
    hit = F.col("_reason").isNotNull()
    return j.withColumns({"verified": F.when(hit, F.lit(False)).otherwise(F.col("verified")), "flag_reason": F.when(hit, F.col("_reason")).otherwise(F.col("flag_reason"))}).select(audio.columns)


def reset_flags(audio: DataFrame) -> DataFrame:
    """All flagged rows usable again."""
    off = F.col("verified").eqNullSafe(False)
    return audio.withColumns({"verified": F.when(off, F.lit(True)).otherwise(F.col("verified")), "flag_reason": F.when(off, F.lit(None).cast("string")).otherwise(F.col("flag_reason"))})
