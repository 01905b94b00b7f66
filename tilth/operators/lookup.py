"""Reads of the reference tables: points, ranges, key lists, search, examples. Filters reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.functions import text
from tilth.operators import intervals

SEARCH_LIMIT = 50


def point(rows: DataFrame, **key) -> DataFrame:
    """At most one row with the given key values."""
    for name, value in key.items():
        rows = rows.where(F.col(name) == value)
    return rows.limit(1)


def verses_of(verses: DataFrame, surah: int) -> DataFrame:
    return verses.where(F.col("surah") == surah).orderBy("ayah")


def verses_between(verses: DataFrame, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Verses of a page: from start to end, both (surah, ayah), in order."""
    return verses.where(intervals.lexicographic_between([F.col("surah"), F.col("ayah")], list(start), list(end))).orderBy("surah", "ayah")


def verses_by_keys(verses: DataFrame, keys: DataFrame) -> DataFrame:
    return verses.join(keys.select("surah", "ayah"), ["surah", "ayah"], "left_semi").orderBy("surah", "ayah")


def usable_audio(audio: DataFrame, reciter: str, surah: int | None = None) -> DataFrame:
    """A reciter's files that aren't flagged; no flag counts as usable."""
    rows = audio.where((F.col("reciter") == reciter) & ~F.col("verified").eqNullSafe(False))
    return rows if surah is None else rows.where(F.col("surah") == surah)


def search_verses(verses: DataFrame, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Substring search: Arabic queries on normalised text, others on translation or transliteration, without case.

    Under two characters nothing matches. Percent signs, underscores and backslashes are themselves.
    """
    if len(query.strip()) < 2:
        return verses.limit(0)
    literal = F.lit(query.strip())
    arabic = text.is_arabic(literal)
    like = F.concat(F.lit("%"), text.escape_like(F.when(arabic, text.normalize(literal)).otherwise(literal)), F.lit("%"))
    rows = verses.withColumn("_like", like).withColumn("_arabic", arabic)
    hit = F.expr("(_arabic and ilike(text_normalized, _like)) or (not _arabic and (ilike(translation, _like) or ilike(transliteration, _like)))")
    return rows.where(hit).drop("_like", "_arabic").orderBy("surah", "ayah").limit(limit)


def search_surahs(surahs: DataFrame, query: str, limit: int = 6) -> DataFrame:
    """By number, by a part of a Latin name without case, or by a part of the normalised Arabic name; by number in order."""
    q = query.strip()
    low = F.lit(q.lower())
    names = F.contains(F.lower("name_en"), low) | F.contains(F.lower("name_tr"), low) | F.contains(text.normalize(F.col("name_ar")), text.normalize(F.lit(q)))
    hit = (F.col("surah") == int(q)) if q.isascii() and q.isdigit() else F.coalesce(names, F.lit(False)) & F.lit(q != "")
    return surahs.where(hit).orderBy("surah").limit(limit)


def jump(query: Column) -> Column:
    """What a query asks to jump to: struct(kind, first, second) for ``s:a``, ``juz n``, ``page n``, else null."""
    number = lambda p, g=1: F.regexp_extract(query, p, g).try_cast("int")
    verse, juz, page = r"^\s*(\d{1,3})\s*:\s*(\d{1,3})\s*$", r"(?i)^\s*juz\s+(\d{1,2})\s*$", r"(?i)^\s*page\s+(\d{1,3})\s*$"
    none = F.lit(None).cast("int")
    made = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("first"), b.alias("second"))
    return F.when(query.rlike(verse), made("verse", number(verse), number(verse, 2))).when(query.rlike(juz), made("juz", number(juz), none)).when(query.rlike(page), made("page", number(page), none))


def drill_examples(segments: DataFrame, verses: DataFrame, rule: str, scan: int = 60, keep: int = 20, show: int = 5) -> DataFrame:
    """A few short verses with a rule: its first annotations by verse, one per verse, the shortest texts."""
    some = segments.where(F.col("rule") == rule).orderBy("surah", "ayah", "start_idx", "end_idx").limit(scan)
    first = some.groupBy("surah", "ayah").agg(F.min(F.struct("start_idx", "end_idx", "segment", "word")).alias("s")).orderBy("surah", "ayah").limit(keep)
    j = first.join(verses.select("surah", "ayah", "text"), ["surah", "ayah"]).where("text <> ''")
    return j.orderBy(F.length("text"), "surah", "ayah").limit(show).select("surah", "ayah", "text", "s.*")
