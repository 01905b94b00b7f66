"""Keys in file names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names of the file-naming conventions, in order of precedence.
CONVENTIONS = ("concat_3_3", "folder", "separated", "labelled")


def stem(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"\.[^.]*$", "")


def valid(surah: Column, ayah: Column) -> Column:
    return F.coalesce(surah.between(1, 114) & (ayah >= 1), F.lit(False))


def _key(surah: Column, ayah: Column) -> Column:
    return F.when(valid(surah, ayah), F.concat_ws(":", surah.cast("string"), ayah.cast("string")))


def key_of_digits(name: Column) -> Column:
    """Audit parser: exactly six digits in the stem, in all -> ``s:a``, else null."""
    digits = F.regexp_replace(stem(name), "[^0-9]", "")
    ok = F.length(digits) == 6
    return F.when(ok, _key(F.substring(digits, 1, 3).try_cast("int"), F.substring(digits, 4, 3).try_cast("int")))


def key_by_pattern(path: Column, pattern: str) -> Column:
    """Index parser: the first match of a two-group pattern."""
    return _key(F.regexp_extract(path, pattern, 1).try_cast("int"), F.regexp_extract(path, pattern, 2).try_cast("int"))


def _bare(digits: Column) -> Column:
    """A run of digits without leading zeros."""
    return F.ltrim(digits, F.lit("0"))


def _neighbours(path: Column, marks: str, fits) -> Column:
    """The first two runs of digits with one of ``marks`` between them that ``fits`` accepts."""
    parts = F.split(path, marks)
    ends = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^[0-9]*", 0).alias("first"), F.regexp_extract(p, r"[0-9]*$", 0).alias("last")))
    pairs = F.zip_with(F.slice(ends, 1, F.size(ends) - 1), F.slice(ends, 2, F.size(ends)), lambda l, r: F.struct(l["last"].alias("s"), r["first"].alias("a")))
    return F.get(F.filter(pairs, lambda x: (F.length(x["s"]) > 0) & (F.length(x["a"]) > 0) & fits(x["s"], x["a"])), F.lit(0))


def key_by_convention(path: Column, name: str) -> Column:
    """Index parser: the first place of a path that follows the convention, null if its key isn't valid.

    ``concat_3_3``: a run of six digits, three and three. ``folder``: numbers on both sides of a slash; zeros
    in front don't count, and a file's number of more than three digits may repeat the folder's in its
    first three. ``separated``: runs of up to three digits with a space, ``_``, ``-`` or ``.`` between them.
    ``labelled``: a number after s, sura or surah, then one after a, aya or ayah, in any case, without their
    leading zeros and of three digits at most.
    """
    number = lambda digits: digits.try_cast("int")
    if name == "concat_3_3":
        run = F.get(F.filter(F.regexp_extract_all(path, F.lit(r"([0-9]+)"), F.lit(1)), lambda d: F.length(d) == 6), F.lit(0))
        return _key(number(F.substring(run, 1, 3)), number(F.substring(run, 4, 3)))
    if name == "folder":
        pair = _neighbours(path, r"[/\\]", lambda s, a: (F.length(_bare(s)) <= 3) & (F.length(_bare(a)) <= 6))
        last = _bare(pair["a"])
        return _key(number(pair["s"]), number(F.when(F.length(last) > 3, F.substring(last, 4, 3)).otherwise(last)))
    if name == "separated":
        pair = _neighbours(path, r"[ _.\-]", lambda s, a: (F.length(s) <= 3) & (F.length(a) <= 3))
        return _key(number(pair["s"]), number(pair["a"]))
    if name != "labelled":
        raise ValueError(f"no convention {name}")
    tokens = F.regexp_extract_all(F.lower(path), F.lit(r"((?:surah|sura|s|ayah|a)[0-9]+)"), F.lit(1))
    start = F.array_position(F.transform(tokens, lambda t: F.startswith(t, F.lit("s"))), F.lit(True)).cast("int")
    later = F.when(start > 0, F.slice(tokens, start + 1, F.size(tokens)))
    ayah = F.get(F.filter(later, lambda t: F.rlike(t, F.lit("^(sura|ayah|a)[0-9]"))), F.lit(0))
    value = lambda t: number(F.substring(_bare(F.regexp_extract(t, "[0-9]+", 0)), 1, 3))
    return _key(value(F.get(tokens, start - 1)), value(ayah))


def key_of_recording(name: Column) -> Column:
    """Batch parser: the last valid six-digit block, else the last pair of numbers."""
    base = stem(name)
    block = F.try_element_at(F.regexp_extract_all(base, F.lit(r"(?<!\d)(\d{6})(?!\d)"), F.lit(1)), F.lit(-1))
    by_block = _key(F.substring(block, 1, 3).try_cast("int"), F.substring(block, 4, 3).try_cast("int"))
    pair = F.try_element_at(F.regexp_extract_all(base, F.lit(r"(\d{1,3}[^\d]+\d{1,3})(?!\d)"), F.lit(1)), F.lit(-1))
    by_pair = _key(F.regexp_extract(pair, r"^(\d{1,3})", 1).try_cast("int"), F.regexp_extract(pair, r"(\d{1,3})$", 1).try_cast("int"))
    return F.coalesce(by_block, by_pair)


def reciter_of(path: Column) -> Column:
    """First folder of a relative path, ``_root`` without one."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("_root")


def join_path(root: Column, relative: Column) -> Column:
    """root/relative; null if the relative part is null or empty."""
    return F.when(F.coalesce(F.length(relative), F.lit(0)) > 0, F.concat_ws("/", F.rtrim(root, F.lit("/")), relative))


def votes(files, column: str):
    """Rows (pattern, hits) of the naming convention that most paths follow, the earlier one on ties; no row if none does."""
    counts = files.agg(*[F.count_if(key_by_convention(F.col(column), n).isNotNull()).alias(n) for n in CONVENTIONS])
    every = F.array(*[F.struct(F.col(n).alias("hits"), F.lit(-i).alias("order"), F.lit(n).alias("pattern")) for i, n in enumerate(CONVENTIONS)])
    return counts.select(F.array_max(every).alias("v")).select("v.pattern", "v.hits").where("hits > 0")
