"""Text expressions: normalisation, slices, words with offsets, bigrams, error rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that normalisation deletes, and the letters it unifies.
MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06DC}\x{06DF}-\x{06E8}\x{06EA}-\x{06ED}\x{08D3}-\x{08FF}\x{0640}]"
LETTERS_FROM, LETTERS_TO = "\u0623\u0625\u0622\u0671\u0649\u0624\u0626\u0629", "\u0627\u0627\u0627\u0627\u064A\u0648\u064A\u0647"
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(text: Column, extra_from: str = "", extra_to: str = "") -> Column:
    """Marks deleted, letters unified, white space collapsed and trimmed."""
    plain = F.translate(F.regexp_replace(text, MARKS, ""), LETTERS_FROM + extra_from, LETTERS_TO + extra_to)
    return F.trim(F.regexp_replace(plain, r"[\s\x{0B}]+", " "))


# Fixed value: the opening formula, normalised.
FORMULA = "\u0628\u0633\u0645 \u0627\u0644\u0644\u0647 \u0627\u0644\u0631\u062d\u0645\u0646 \u0627\u0644\u0631\u062d\u064a\u0645"


def has_formula(text: Column) -> Column:
    """Whether the first four words are the opening formula."""
    return F.array_join(F.slice(F.split(normalize(text), " "), 1, 4), " ") == FORMULA


def letter_count(text: Column, surah: Column, ayah: Column) -> Column:
    """Letters of a verse as recited by itself: without an opening formula in first verses of surahs after the first."""
    n = F.length(letters_only(text))
    spare = F.length(F.lit(FORMULA.replace(" ", "")))
    return F.when((surah != 1) & (ayah == 1) & has_formula(text), n - spare).otherwise(n)


def letters_only(text: Column) -> Column:
    """Normalised text without spaces."""
    return F.replace(normalize(text), F.lit(" "), F.lit(""))


def is_arabic(text: Column) -> Column:
    return text.rlike(ARABIC)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points; out of range is cut off silently."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def enclosing_word(text: Column, start: Column, end: Column) -> Column:
    """From after the last space before ``start`` to the first space at or after ``end``."""
    left = F.regexp_extract(F.left(text, start), "([^ ]*)$", 1)
    right = F.regexp_extract(F.substring(text, end + 1, F.length(text)), "^([^ ]*)", 1)
    return F.concat(left, slice_text(text, start, end), right)


def words(text: Column) -> Column:
    """White-space-separated words with offsets: array of (word, start, end), end exclusive. Null gives null, no words an empty array."""
    parts = F.split(text, r"\s")
    none = F.expr("named_struct('at', 0, 'words', cast(array() as array<struct<word: string, start: int, end: int>>))")

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        word = F.named_struct(F.lit("word"), part, F.lit("start"), acc["at"], F.lit("end"), end)
        return F.named_struct(F.lit("at"), end + 1, F.lit("words"), F.when(part == "", acc["words"]).otherwise(F.concat(acc["words"], F.array(word))))

    return F.aggregate(parts, none, step)["words"]


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def bigrams(text: Column) -> Column:
    """Bag of neighbouring character pairs; a single character is its own bag, empty text an empty one."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n == 0, F.expr("cast(array() as array<string>)")).otherwise(pairs)


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of strings."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    shared = lambda a, b: F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return let(a, lambda a: let(b, lambda b: shared(a, b)))


def error_rate(hyp: Column, ref: Column) -> Column:
    """Edit distance over the reference's length; against an empty reference 0 if both are empty, else 1."""
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(hyp, ref) / F.length(ref))


def prefix_fit(hyp: Column, window: Column) -> Column:
    """Least edit distance of ``hyp`` to a prefix of ``window``, over hyp's length; empty hyp 0, empty window 1."""
    cuts = F.transform(F.sequence(F.lit(0), F.length(window)), lambda k: F.levenshtein(hyp, F.left(window, k)))
    return F.when(F.length(hyp) == 0, 0.0).when(F.length(window) == 0, 1.0).otherwise(F.array_min(cuts) / F.length(hyp))


def suffix_fit(hyp: Column, window: Column) -> Column:
    """As ``prefix_fit`` with a suffix of ``window``."""
    return prefix_fit(F.reverse(hyp), F.reverse(window))


def escape_like(text: Column) -> Column:
    return F.regexp_replace(text, r"([%_\\])", r"\\$1")


def first_words_length(text: Column, n: int) -> Column:
    """Characters that the first ``n`` words cover, white space before and between included."""
    return F.length(F.regexp_extract(text, r"^((?:\s*\S+){0,%d})" % n, 1))


def letter_positions(text: Column) -> Column:
    """Places of the characters that are letters: not white space, not a mark by category, not gone when normalised."""
    chars = F.split(text, "")
    at = F.transform(chars, lambda c, i: F.when((c != "") & ~c.rlike(r"[\s\p{M}]") & (F.length(F.regexp_replace(c, MARKS, "")) > 0), i))
    return F.filter(at, lambda i: i.isNotNull())


def uniform_spans(text: Column, duration: Column) -> Column:
    """Spans per character when a duration is shared evenly by the letters; null for other characters."""

    def spread(places: Column) -> Column:
        n = F.size(places)
        step = duration / n
        nth = lambda i: F.array_position(places, i) - 1
        return F.transform(F.split(text, ""), lambda c, i: F.when(F.array_contains(places, i), F.struct((nth(i) * step).alias("t0"), ((nth(i) + 1) * step).alias("t1"))))

    return let(letter_positions(text), spread)


def scatter_spans(text: Column, spans: Column) -> Column:
    """Spans per character from spans per letter, in order; characters that aren't letters get null."""
    return let(letter_positions(text), lambda places: F.transform(F.split(text, ""), lambda c, i: F.when(F.array_contains(places, i), F.get(spans, (F.array_position(places, i) - 1).cast("int")))))
