"""Grading of recordings: from timed characters and annotations to statuses, word verdicts and reports.

A recording is a row (clip, surah, ayah, text, spans, duration, decoded): ``spans`` has an entry per
character of the verse text, null for characters without sound. Everything joins on the clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.functions import alignment, text
from tilth.operators import scoring
from tilth.sources import dimensions

CONTENT_LIMIT, WORD_LIMIT = 0.75, 0.6


def checked(recordings: DataFrame) -> DataFrame:
    """The recordings; reading one whose spans don't match its text in number fails."""
    same = F.size("spans") == F.length("text")
    return recordings.withColumn("spans", F.when(same, F.col("spans")).otherwise(F.raise_error(F.lit("spans and text differ in length")).cast(recordings.schema["spans"].dataType)))


def span_of(spans: Column, start: Column, end: Column) -> Column:
    """First start and last end of the timed characters in start..end; for a mark alone, the timed character before it; null if none."""
    timed = F.filter(F.slice(spans, start + 1, F.greatest(end - start, F.lit(0))), lambda s: s.isNotNull())
    before = F.filter(F.slice(spans, F.lit(1), start), lambda s: s.isNotNull())
    whole = lambda t: F.struct(F.array_min(F.transform(t, lambda s: s["t0"])).alias("t0"), F.array_max(F.transform(t, lambda s: s["t1"])).alias("t1"))
    last = F.element_at(before, -1)
    return F.when(F.size(timed) > 0, whole(timed)).when(F.size(before) > 0, F.struct(last["t0"].alias("t0"), last["t1"].alias("t1")))


def units(recordings: DataFrame, segments: DataFrame) -> DataFrame:
    """clip, unit: seconds per count. Half the median natural prolongation, else the median letter outside annotated ones, else null."""
    timed = recordings.join(segments, ["surah", "ayah"]).withColumn("_s", span_of(F.col("spans"), F.col("start"), F.col("end")))
    length = F.col("_s.t1") - F.col("_s.t0")
    anchor = timed.groupBy("clip").agg(F.median(F.when((F.col("rule") == "madd_2") & (length > 0), length)).alias("_anchor"), F.collect_list(F.struct("start", "end")).alias("_marked"))
    letters = recordings.join(anchor, "clip", "left").select("clip", "_anchor", "_marked", F.posexplode_outer("spans").alias("_i", "_c"))
    inside = F.exists(F.coalesce("_marked", F.expr("cast(array() as array<struct<start: int, end: int>>)")), lambda m: (m["start"] <= F.col("_i")) & (F.col("_i") < m["end"]))
    return letters.groupBy("clip").agg(F.coalesce(F.first("_anchor") / 2, F.median(F.when(~inside, F.col("_c.t1") - F.col("_c.t0")))).alias("unit"))


def bands(spark, calibration: DataFrame | None) -> DataFrame:
    """Rules with their bands: calibrated where ``calibration`` (rule, lo, hi, nasal_lo) has them, else the textbook's."""
    book = dimensions.rules(spark).where("lo is not null")
    if calibration is None:
        return book.withColumn("calibrated", F.lit(False))
    c = calibration.select("rule", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("nasal_lo").alias("_nasal"), F.lit(True).alias("_has"))
    j = book.join(c, "rule", "left")
    has = F.coalesce("_has", F.lit(False))
    return j.select(
        *[x for x in book.columns if x not in ("lo", "hi", "nasal_share")],
        F.when(has, F.col("_lo")).otherwise(F.col("lo")).alias("lo"), F.when(has, F.col("_hi")).otherwise(F.col("hi")).alias("hi"),
        F.when(has, F.when(F.col("nasal"), F.col("_nasal"))).otherwise(F.col("nasal_share")).alias("nasal_share"), has.alias("calibrated"),
    )


def measure(recordings: DataFrame, segments: DataFrame, calibration: DataFrame | None = None) -> DataFrame:
    """Status of every measured annotation of every recording.

    ``segments``: surah, ayah, rule, start, end. Rules that aren't measured give no row. ``nasality``
    is read from recordings' column of that name (map from start to share), if there.
    clip, surah, ayah, rule, start, end, measured, nasality, status.
    """
    spark = recordings.sparkSession
    timed = checked(recordings).join(segments, ["surah", "ayah"]).withColumn("rule", dimensions.effective_rule(F.col("rule"), F.col("surah"), F.col("ayah")))
    timed = timed.withColumn("_s", span_of(F.col("spans"), F.col("start"), F.col("end"))).join(units(recordings, segments), "clip", "left")
    graded = timed.join(F.broadcast(bands(spark, calibration)), "rule")  # a row per rule
    measured = F.when(F.col("unit") > 0, (F.col("_s.t1") - F.col("_s.t0")) / F.col("unit"))
    nasality = F.when(F.col("nasal"), F.try_element_at("nasality", F.col("start"))) if "nasality" in recordings.columns else F.lit(None).cast("double")
    status = scoring.measured_status(F.col("rule"), F.col("measured"), F.col("lo"), F.col("hi"), F.col("_nasality"), F.col("nasal_share"), F.col("advisory"), F.col("lower_only"), F.col("reliable_floor"))
    return graded.withColumn("measured", measured).withColumn("_nasality", nasality).select("clip", "surah", "ayah", "rule", "start", "end", "measured", F.col("_nasality").alias("nasality"), status.alias("status"))


def content(recordings: DataFrame) -> DataFrame:
    """clip, cer, content_status: mismatch strictly over the limit; without a decode, unknown."""
    rate = text.error_rate(text.letters_only(F.col("decoded")), text.letters_only(F.col("text")))
    return recordings.select("clip", rate.alias("cer")).withColumn("content_status", F.when(F.col("cer").isNull(), "unknown").when(F.col("cer") > CONTENT_LIMIT, "mismatch").otherwise("ok"))


def word_verdicts(recordings: DataFrame, measured: DataFrame) -> DataFrame:
    """Verdict per word that the clip reached: clip, word, start, end, content_ok, verdict. Without a decode every word is ok.

    The opening formula of a first verse isn't graded, but in surahs 1 and 9.
    """
    opening = (F.col("ayah") == 1) & ~F.col("surah").isin(1, 9) & text.has_formula(F.col("text"))
    words = recordings.select("clip", "decoded", opening.alias("_opening"), F.posexplode(text.words(F.col("text"))).alias("pos", "w"))
    words = words.where(~F.col("_opening") | (F.col("pos") >= 4)).select("clip", "decoded", "pos", "w.word", "w.start", "w.end")
    lettered = words.withColumn("_l", text.letters_only(F.col("word")))
    per = lettered.groupBy("clip", "decoded").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "start", "end", "_l"))).alias("ws"))
    ends = F.transform("ws", lambda _, i: F.aggregate(F.slice("ws", F.lit(1), i + 1), F.lit(0), lambda acc, w: acc + F.length(w["_l"])))
    per = per.withColumn("_ends", ends).withColumn("_starts", F.zip_with("_ends", "ws", lambda e, w: e - F.length(w["_l"])))
    ratios = alignment.word_ratios_udf(text.letters_only(F.col("decoded")), F.array_join(F.transform("ws", lambda w: w["_l"]), ""), F.col("_starts"), F.col("_ends"))
    rated = per.withColumn("_r", F.when(F.col("decoded").isNull(), F.transform("ws", lambda _: F.lit(1.0))).otherwise(ratios))
    flat = rated.select("clip", F.explode(F.arrays_zip("ws", "_r")).alias("z")).select("clip", "z.ws.word", "z.ws.start", "z.ws.end", F.col("z._r").alias("ratio")).where("ratio is not null")
    warns = measured.where("status = 'warn'").select("clip", F.col("start").alias("_r0"), F.col("end").alias("_r1"))
    hit = flat.join(warns, "clip").where("_r0 < end and _r1 > start").select("clip", "start", F.lit(True).alias("_warn")).distinct()
    ok = F.col("ratio") >= WORD_LIMIT
    return flat.join(hit, ["clip", "start"], "left").select("clip", "word", "start", "end", ok.alias("content_ok"), scoring.verdict(ok, F.coalesce("_warn", F.lit(False))).alias("verdict"))


def reports(recordings: DataFrame, segments: DataFrame, calibration: DataFrame | None = None) -> DataFrame:
    """One nested report per recording. A content mismatch leaves its segments and words out."""
    said = content(recordings)
    good = recordings.join(said.where("content_status <> 'mismatch'").select("clip"), "clip", "left_semi")
    measured = measure(good, segments, calibration)
    words = word_verdicts(good, measured)
    s = measured.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("start", "end", "rule", "measured", "nasality", "status"))).alias("segments"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "warn").alias("n_warn"))
    w = words.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("start", "end", "word", "content_ok", "verdict"))).alias("word_scores"))
    head = recordings.select("clip", "surah", "ayah", "duration").join(said, "clip").join(units(recordings, segments), "clip", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return head.join(s, "clip", "left").join(w, "clip", "left").select("clip", "surah", "ayah", "duration", "unit", "cer", "content_status", "segments", zero("n_ok"), zero("n_warn"), "word_scores")


def window_progress(words: DataFrame, verse_spans: DataFrame, confirm: float = 0.5, rescue: float = 0.6) -> DataFrame:
    """How far a clip of several verses got: clip, n_confirmed, resume_at.

    ``words``: word verdicts on the joined text; ``verse_spans``: clip, ayah, v0, v1, a row per verse
    of the window. A verse's ratio counts the words wholly inside it, 0 without any.
    """
    from tilth.operators import intervals

    inside = intervals.contained_join(words.select("clip", "start", "end", "content_ok"), verse_spans, ["clip"], ("start", "end"), ("v0", "v1"))
    ratio = inside.groupBy("clip", "ayah").agg(F.avg(F.col("content_ok").cast("double")).alias("ratio"))
    every = verse_spans.select("clip", "ayah").join(ratio, ["clip", "ayah"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    return intervals.confirmed_prefix(every, ["clip"], "ayah", "ratio", confirm, rescue)


def rebased(items: DataFrame, verse_spans: DataFrame, keys: list[str]) -> DataFrame:
    """Items on the joined text with their verse, and offsets from its start; outside any verse, a null ayah."""
    from tilth.operators import intervals

    found = intervals.point_join(items, verse_spans, ["clip"], "start", ("v0", "v1"), "ayah", keys)
    return found.withColumns({"start": F.col("start") - F.coalesce("v0", F.lit(0)), "end": F.col("end") - F.coalesce("v0", F.lit(0))}).drop("v0", "v1")


def batch_inputs(files: DataFrame, verses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A folder's recordings by the verse in their names -> (files with surah, ayah and text, skipped files with a reason)."""
    from tilth.functions import keys

    named = files.withColumn("_key", keys.key_of_recording(F.col("path")))
    part = F.split("_key", ":")
    known = named.where("_key is not null").select(*files.columns, F.get(part, F.lit(0)).cast("int").alias("surah"), F.get(part, F.lit(1)).cast("int").alias("ayah"))
    good = known.join(verses, ["surah", "ayah"])
    lost = known.join(verses, ["surah", "ayah"], "left_anti").select(*files.columns, F.lit("no such verse").alias("reason"))
    return good, named.where("_key is null").select(*files.columns, F.lit("no verse in the name").alias("reason")).unionByName(lost)
