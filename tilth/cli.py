"""Command line: python -m tilth.cli COMMAND ... — index, ingest, audit, correct, calibrate, grade, replay."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.functions import keys
from tilth.functions import text as texts
from tilth.operators import grading, quality, robust
from tilth.sources import audio_files, dimensions, readers, sinks, store


def index(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Files of each reciter by verse: the first file of a verse in path order stays."""
    files = readers.list_files(spark, a.audio_root, tuple(a.ext))
    root = F.lit(a.audio_root.rstrip("/") + "/")
    rel = F.regexp_replace("path", F.concat(F.lit(r"^.*?\Q"), root, F.lit(r"\E")), F.lit(""))
    key = keys.key_by_pattern(rel, a.regex) if a.regex else keys.key_by_convention(rel, a.pattern)
    rows = files.select(rel.alias("audio_path"), (F.lit("default") if a.flat else keys.reciter_of(rel)).alias("reciter"), key.alias("key")).where("key is not null")
    return quality.first_wins(rows, ["reciter", "key"], ["audio_path"]).select("reciter", F.split("key", ":")[0].cast("int").alias("surah"), F.split("key", ":")[1].cast("int").alias("ayah"), "audio_path", "n_duplicates")


def ingest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Annotations with their slice and word of the verse text; rows that don't fit the text go to the dead letters."""
    verses = readers.read_verses(spark, a.text)
    rows = readers.read_annotations(spark, a.annotations).withColumn("rule", dimensions.canonical_rule(F.col("rule")))
    if a.rule:
        rows = rows.where(F.col("rule").isin(*a.rule))
    for name in ("surah", "ayah"):
        if getattr(a, name):
            rows = rows.where(F.col(name) == getattr(a, name))
    joined = rows.join(verses, ["surah", "ayah"])
    fits = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
    good, bad = sinks.split_valid(joined, fits, F.lit("offsets"))
    if a.dead_letter:
        sinks.dead_letters(bad.drop("reason"), "_input", a.dead_letter, a.as_of)
    segments = good.select("surah", "ayah", "rule", F.col("start").alias("start_idx"), F.col("end").alias("end_idx"), texts.slice_text(F.col("text"), F.col("start"), F.col("end")).alias("segment"), texts.enclosing_word(F.col("text"), F.col("start"), F.col("end")).alias("word")).distinct()
    if a.audio_map:
        if not a.audio_out:
            raise ValueError("--audio-map needs --audio-out")
        audio = audio_rows(readers.read_audio_index(spark, a.audio_map), None if a.seed_audio else segments, a.reciter)
        store.KeyedStore(spark, a.audio_out, sinks.conflict_keys("ayah_audio")).upsert(audio, ["audio_path"])
    return segments


def audio_rows(listed: DataFrame, segments: DataFrame | None, reciters: list[str] | None) -> DataFrame:
    """One row per verse and reciter of an index: of the verses that have segments, or of all. Several paths of one key: the last by name."""
    if reciters:
        listed = listed.where(F.col("reciter").isin(*reciters))
    if segments is not None:
        listed = listed.join(segments.select("surah", "ayah").distinct(), ["surah", "ayah"], "left_semi")
    return quality.last_wins(listed.select("surah", "ayah", "reciter", "audio_path"), ["surah", "ayah", "reciter"], ["audio_path"]).select(
        "surah", "ayah", "reciter", "audio_path", F.lit(True).alias("verified"), F.lit(None).cast("string").alias("flag_reason")
    )


LAYERS = ("inventory", "integrity", "plausibility")


def audit(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Problems per reciter and verse, by layers: missing files, files whose headers are broken, implausible durations.

    Files come from a folder (``--audio-root``: keys are six digits, headers are probed) or an index with a table of durations. With
    ``--sample`` the integrity layer probes that many files a reciter, by hash. Plausibility needs durations. The work list is
    whole; ``--cap`` bounds the examples of the report.
    """
    layers = set(LAYERS) if a.deep else {x.strip() for x in a.layers.split(",") if x.strip()} if a.layers else {"inventory", *(LAYERS[1:] if a.durations else ())}
    if unknown := layers - set(LAYERS):
        raise ValueError(f"unknown layers: {', '.join(sorted(unknown))}")
    verses = readers.read_verses(spark, a.text)
    if a.surah:
        verses = verses.where(F.col("surah") == a.surah)
    if a.audio_root:
        mapped = keyed_files(readers.list_files(spark, a.audio_root), a.audio_root)
        files = quality.first_wins(mapped.where("key is not null"), ["reciter", "key"], ["path"]).select("reciter", F.split("key", ":")[0].cast("int").alias("surah"), F.split("key", ":")[1].cast("int").alias("ayah"), "path", "n_duplicates")
        if a.surah:
            files = files.where(F.col("surah") == a.surah)
    elif a.index:
        files = spark.read.parquet(a.index)
    else:
        raise ValueError("audit needs --audio-root or --index")
    reciters = files.select("reciter").distinct()
    if a.reciter:
        reciters = reciters.where(F.col("reciter").isin(*a.reciter))
    files, keys = files.join(reciters, "reciter", "left_semi"), ["reciter", "surah", "ayah"]
    none = F.lit(None).cast("double")
    found = []
    if "inventory" in layers:
        expected = reciters.crossJoin(F.broadcast(verses.select("surah", "ayah")))  # reciters x verses of one book
        found.append(expected.join(files, keys, "left_anti").select(*keys, F.lit("missing").alias("reason"), none.alias("ratio")))
    probed = None
    if layers & {"integrity", "plausibility"}:
        if a.durations:
            probed = spark.read.parquet(a.durations).withColumn("status", quality.integrity(F.col("length"), F.col("duration"), F.lit(True), a.min_bytes))
        elif a.audio_root:
            probed = files.join(readers.probe_files(spark, a.audio_root, a.min_bytes), "path").select(*keys, "length", "duration", "status")
        else:
            raise ValueError("these layers need --audio-root or --durations")
        if a.sample:
            probed = quality.per_group_sample(probed, ["reciter"], F.xxhash64(*keys), a.sample, ["surah", "ayah"])
        probed = probed.join(verses, ["surah", "ayah"]).join(reciters, "reciter", "left_semi").persist()
        if "integrity" in layers:
            found.append(probed.where("status <> 'ok'").select(*keys, F.col("status").alias("reason"), none.alias("ratio")))
    if "plausibility" in layers:
        ok = probed.where("status = 'ok'").withColumn("letters", texts.letter_count(F.col("text"), F.col("surah"), F.col("ayah")).cast("double")).where("letters > 0")
        fit = robust.theil_sen(ok, ["reciter"], "letters", "duration")
        odd = robust.outliers(ok, fit, ["reciter"], "letters", "duration", a.min_abs, a.mad_k, a.ratio_low, a.ratio_high)
        found.append(odd.where("outlier").select(*keys, "reason", F.round("ratio", 3).alias("ratio")))
    work = quality.worklist(found)
    if a.report:
        report = audit_report(files, verses, reciters, probed, work, a.cap)
        report.write.mode("overwrite").json(a.report)
        spark.read.schema(report.schema).json(a.report).drop("missing", "broken", "odd").orderBy("reciter").show(1000, truncate=False)
    return work


def keyed_files(files: DataFrame, root: str) -> DataFrame:
    """path, reciter, key (null: the name has no six digits) of listed files below a root."""
    rel = F.regexp_replace("path", F.concat(F.lit(r"^.*?\Q"), F.lit(root.rstrip("/") + "/"), F.lit(r"\E")), F.lit(""))
    plain = F.regexp_replace("path", "^file:/+", "/")
    return files.select(plain.alias("path"), keys.reciter_of(rel).alias("reciter"), keys.key_of_digits(rel).alias("key"))


def audit_report(files: DataFrame, verses: DataFrame, reciters: DataFrame, probed: DataFrame | None, work: DataFrame, cap: int) -> DataFrame:
    """A row per reciter: present (out of the book, too), missing, extra, duplicates, checked, ok, outliers, and up to ``cap`` examples of each class of problem."""
    statuses = ("empty", "tiny", "unreadable", "corrupt", "zero_duration")
    key = F.concat_ws(":", F.col("surah").cast("string"), F.col("ayah").cast("string"))
    known = verses.select("surah", "ayah", F.lit(True).alias("_in"))
    dup = F.sum("n_duplicates") if "n_duplicates" in files.columns else F.lit(0).cast("long")
    present = files.join(known, ["surah", "ayah"], "left").groupBy("reciter").agg(F.count(F.lit(1)).alias("present"), F.count_if(F.col("_in").isNull()).alias("extra"), dup.alias("duplicates"))
    kind = F.when(F.col("reason") == "missing", "missing").when(F.col("reason").isin(*statuses), "broken").otherwise("odd")
    ranked = work.select("reciter", kind.alias("kind"), F.struct("surah", "ayah", key.alias("key"), "reason", "ratio").alias("p"))
    top = F.slice(F.array_sort(F.collect_list("p")), 1, cap)
    lists = ranked.groupBy("reciter", "kind").agg(F.count(F.lit(1)).alias("n"), top.alias("examples")).groupBy("reciter").pivot("kind", ["missing", "broken", "odd"]).agg(F.first("n").alias("n"), F.first("examples").alias("examples"))
    out = reciters.join(present, "reciter", "left").join(lists, "reciter", "left")
    counted = [F.coalesce(f"{k}_n", F.lit(0)).alias(f"n_{k}") for k in ("missing", "broken", "odd")]
    checked = probed.groupBy("reciter").agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("status") == "ok").alias("ok")) if probed is not None else None
    out = out.join(checked, "reciter", "left") if checked is not None else out.withColumns({"checked": F.lit(0).cast("long"), "ok": F.lit(0).cast("long")})
    return out.select("reciter", "present", "extra", "duplicates", *counted, F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("ok", F.lit(0)).alias("ok"), *[F.col(f"{k}_examples").alias(k) for k in ("missing", "broken", "odd")])


def correct(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The index without the verses of a work list that are confirmed broken; written only with --apply.

    Implausible durations count only with ``--include-plausibility``, and then only gross ones: a ratio to the expected of
    ``--flag-ratio-high`` or more, or ``--flag-ratio-low`` or less. With ``--audio`` (a table of audio rows) its rows are flagged in a
    new version; ``--reset-flags`` makes all its rows usable again and changes nothing else.
    """
    audio = store.KeyedStore(spark, a.audio, sinks.conflict_keys("ayah_audio")) if a.audio else None
    if a.reset_flags:
        if audio and a.apply:
            audio.upsert(sinks.reset_flags(audio.read()), ["audio_path"])
        return spark.read.parquet(a.index)
    listed = spark.read.csv(a.worklist, sep="\t", header=True, schema="reciter string, surah int, ayah int, reason string, ratio double")
    gross = (F.col("ratio") >= a.flag_ratio_high) | (F.col("ratio") <= a.flag_ratio_low) if a.include_plausibility else F.lit(False)
    broken = F.col("reason").isin("missing", "empty", "tiny", "unreadable", "corrupt", "zero_duration")
    bad = listed.where(broken | F.coalesce(gross, F.lit(False)))
    ranked = bad.select("reciter", "surah", "ayah", F.when(broken, 0).otherwise(1).alias("rank"), F.when(broken, F.concat(F.lit("integrity:"), "reason")).otherwise(F.concat(F.lit("review:"), "reason")).alias("reason"))
    flagged = quality.precedence(ranked, ["reciter", "surah", "ayah"], "rank", "reason")
    if audio and a.apply:
        audio.upsert(sinks.flag(audio.read(), flagged.where("reason <> 'integrity:missing'"), ["reciter", "surah", "ayah"]).where("not verified"), ["audio_path"])
    return quality.without(spark.read.parquet(a.index), flagged, ["reciter", "surah", "ayah"])


def calibrate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Bands per rule from a checkpoint of reference measurements, with the nasal floor where there is one."""
    rows = readers.read_checkpoint(spark, a.checkpoint).withColumn("rule", dimensions.effective_rule(F.col("rule"), F.col("surah"), F.col("ayah"))).where("rule is not null")
    floors = {r: f[1] for r, f in dimensions.LOWER_ONLY.items()}
    bands = robust.calibration_bands(rows, "rule", "harakat", k=a.k_mad, one_sided=tuple(dimensions.LOWER_ONLY), floors=floors)
    nasal = rows.where(F.col("rule").isin(*dimensions.NASAL) & F.col("nasality").isNotNull())
    share = robust.order_statistics(nasal, ["rule"], "nasality", {"nasal_lo": robust.nearest_rank(0.10)}).where("n >= 5").select("rule", "nasal_lo")
    return bands.join(share, "rule", "left")


def grade(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Nested report per recording of a table of aligned recordings."""
    learnt = spark.read.parquet(a.calibration) if a.calibration else None
    return grading.reports(spark.read.parquet(a.recordings), spark.read.parquet(a.segments), learnt)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tilth", description=__doc__)
    p.add_argument("--as-of", default="1970-01-01T00:00:00Z", help="time stamp of dead letters")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *flags):
        q = sub.add_parser(name, help=run.__doc__.split(":")[0].split(".")[0])
        q.set_defaults(run=run)
        for f, kw in flags:
            q.add_argument(f, **kw)
        q.add_argument("--out", required=name != "replay")

    need = {"required": True}
    add("index", index, ("--audio-root", need), ("--regex", {}), ("--pattern", {"default": "concat_3_3", "choices": list(keys.CONVENTIONS)}), ("--ext", {"nargs": "*", "default": list(audio_files.EXTENSIONS)}), ("--flat", {"action": "store_true"}))
    add("ingest", ingest, ("--text", need), ("--annotations", need), ("--rule", {"nargs": "*"}), ("--surah", {"type": int}), ("--ayah", {"type": int}), ("--dead-letter", {}), ("--audio-map", {}), ("--audio-out", {}), ("--seed-audio", {"action": "store_true"}), ("--reciter", {"nargs": "*"}))
    add("audit", audit, ("--text", need), ("--index", {}), ("--audio-root", {}), ("--durations", {}), ("--layers", {}), ("--deep", {"action": "store_true"}), ("--sample", {"type": int}), ("--cap", {"type": int, "default": 50}), ("--report", {}), ("--reciter", {"nargs": "*"}), ("--surah", {"type": int}), ("--min-bytes", {"type": int, "default": 1024}), ("--mad-k", {"type": float, "default": 6.0}), ("--min-abs", {"type": float, "default": 0.4}), ("--ratio-low", {"type": float, "default": 0.5}), ("--ratio-high", {"type": float, "default": 2.0}))
    add("correct", correct, ("--index", need), ("--worklist", {}), ("--apply", {"action": "store_true"}), ("--include-plausibility", {"action": "store_true"}), ("--flag-ratio-high", {"type": float, "default": 5.0}), ("--flag-ratio-low", {"type": float, "default": 0.2}), ("--audio", {}), ("--reset-flags", {"action": "store_true"}))
    add("calibrate", calibrate, ("--checkpoint", need), ("--k-mad", {"type": float, "default": 3.0}))
    add("grade", grade, ("--recordings", need), ("--segments", need), ("--calibration", {}))
    add("replay", replay, ("--infile", need), ("--residual", need), ("--target", need))
    return p


def replay(spark: SparkSession, a: argparse.Namespace) -> None:
    """Dead letters back into their tables; the rest goes to another place."""
    schemas = {
        "verses": "surah int, ayah int, text string",
        "segments": "surah int, ayah int, rule string, start_idx int, end_idx int, segment string, word string",
        "ayah_audio": "surah int, ayah int, reciter string, audio_path string, verified boolean, flag_reason string",
    }
    print(sinks.replay(spark, a.infile, a.residual, a.target, schemas))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"tilth {a.command}").getOrCreate()
    out = a.run(spark, a)
    if out is None or (a.command == "correct" and not a.apply):
        if out is not None:
            print(f"{out.count()} rows would stay; --apply writes them")
        return 0
    if a.command == "audit":
        sinks.write_worklist(out, a.out)
    else:
        out.write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
