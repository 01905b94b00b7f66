"""One-permutation MinHash fingerprints, in DataFrame functions only.

Every word shingle is hashed once; the hash's high bits choose a bin and each bin keeps its smallest
hash. Empty bins borrow from full ones by optimal densification: bin i tries bins chosen by hashing
(i, attempt) until one is full, the same for every document, so equal sets stay equal. The low bits
of the bins' values, packed sixteen to a 64-bit integer, are the fingerprint, and the share of agreeing bins
less the share that agrees by chance estimates the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilth.llm.common import key_ranges, range_of, task_of

BINS, BIN_BITS, PER_WORD = 256, 8, 16
LOW_BITS = 4
#: Tries by the chained probes; later ones compare all full bins at once.
PROBES = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles(text: Column, width: int = 5) -> Column:
    """Sorted hashes of a text's word shingles; fewer words make one shingle, null counts as empty."""

    def of(words: Column) -> Column:
        n = F.size(words)
        several = F.transform(
            F.sequence(F.lit(0), n - width),
            lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]),
        )
        return F.when(n >= width, several).otherwise(F.array(F.xxhash64(words)))

    words = F.transform(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.xxhash64(w))
    return F.sort_array(let(words, of))


def bin_of(hashed: Column) -> Column:
    """0..BINS-1, rising with the signed hash."""
    return (F.shiftright(hashed, 64 - BIN_BITS) + BINS // 2).cast("int")


def signature(text: Column, width: int = 5) -> Column:
    """The packed fingerprint of a text: array of 64-bit integers."""

    def minima(ordered: Column) -> Column:
        return F.filter(ordered, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(ordered, i - 1))))

    def spread(full: Column) -> Column:
        gap = lambda h, i: bin_of(h) - F.when(i == 0, F.lit(0)).otherwise(bin_of(F.get(full, i - 1)) + 1)
        placed = F.flatten(F.transform(full, lambda h, i: F.concat(F.array_repeat(F.lit(None).cast("long"), gap(h, i)), F.array(h))))
        tail = F.array_repeat(F.lit(None).cast("long"), F.lit(BINS - 1) - bin_of(F.element_at(full, -1)))
        return let(F.concat(placed, tail), lambda bins: densify(bins, full))

    def densify(bins: Column, full: Column) -> Column:
        def borrow(own: Column, i: Column) -> Column:
            tries = [F.get(bins, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
            last = F.array_min(F.transform(full, lambda h: F.named_struct(F.lit("turn"), F.xxhash64(i, bin_of(h)), F.lit("hash"), h)))["hash"]
            # hashed with the bin, so that bins that share a source agree by chance independently
            return F.xxhash64(F.coalesce(own, *tries, last), i).bitwiseAND(F.lit((1 << LOW_BITS) - 1))

        return let(F.transform(bins, borrow), packed)

    def packed(low: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(BINS // PER_WORD - 1)),
            lambda w: F.aggregate(F.slice(low, w * PER_WORD + 1, F.lit(PER_WORD)), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, LOW_BITS).bitwiseOR(x)),
        )

    return let(let(shingles(text, width), minima), spread)


def as_hex(packed: Column) -> Column:
    return F.lower(F.array_join(F.transform(packed, lambda w: F.lpad(F.hex(w), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity (0 to 1) of two fingerprints, corrected for chance agreement of low bits."""
    ones = 0x1111111111111111

    def agree(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(ones))
        return F.lit(PER_WORD) - F.bit_count(d)

    same = F.aggregate(F.zip_with(a, b, agree), F.lit(0), lambda acc, x: acc + x) / F.lit(BINS)
    chance = 1.0 / (1 << LOW_BITS)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, signature, fingerprint (hex); null text is empty, equal texts agree."""
    return docs.select("doc_id", signature(F.col("text"), width).alias("signature")).withColumn("fingerprint", as_hex(F.col("signature")))


def with_next(docs: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """Each document beside the next in ascending doc_id order (the last beside the first).

    doc_id, text, signature, next_text, next_signature. Null doc_ids come first and rows with one
    doc_id follow their text's order; a single row is its own next. One shuffle by range of doc_id,
    a task per range: a range's first row is also sent, as a guest, to the range before it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = key_ranges(rows, "doc_id", "text", part_bytes)
    spread = rows.withColumn("part", range_of("doc_id", cuts).cast("int"))
    # a row per range: whether it has null keys, and its smallest key
    heads = {r["part"]: r for r in spread.groupBy("part").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("null")).collect()}
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("part"))
    n = len(cuts) + 1
    low = at([None if p not in heads or heads[p]["null"] else heads[p]["low"] for p in range(n)], "long")
    guest_of = at([before.get(p, p) for p in range(n)], "int")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(guest_of.alias("part"), F.lit(True).alias("guest"))
    dealt = spread.select(
        "doc_id", "text", signature(F.col("text")).alias("signature"), F.explode(F.when(F.col("doc_id").eqNullSafe(low), F.array(own, guest)).otherwise(F.array(own))).alias("at")
    ).select("doc_id", "text", "signature", "at.part", "at.guest").withColumn("part", task_of(docs.sparkSession, "part", n)).repartition(n, "part")
    in_order = Window.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    return (
        dealt.withColumns({"next_text": F.lead("text").over(in_order), "next_signature": F.lead("signature").over(in_order)})
        .where(~F.col("guest"))
        .select("doc_id", "text", "signature", "next_text", "next_signature")
    )


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint each text, and the text whose last quarter gives way to the start of the next document."""
    n = F.length("text")
    q = F.floor(n / 4).cast("int")
    pairs = with_next(docs).select(
        "doc_id", n.cast("long").alias("n_chars"), "signature", "next_signature",
        F.concat(F.substring("text", F.lit(1), n - q), F.substring("next_text", F.lit(1), q)).alias("edited"),
    )
    both = pairs.withColumn("edited_signature", signature(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_hex(F.col("signature")).alias("fingerprint"), as_hex(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )
