"""Spelling variants: words that one inserted, deleted or replaced letter takes to a much more frequent word.

Words are found as similar strings are by grams of variable length. The dictionary holds all pairs of
letters, and those triples whose first two letters are frequent: what is rare stays short. A word is cut
into the longest gram of the dictionary at each place, less those that lie within an earlier one. One edit
loses the grams that it touches and some that start right behind it; the most that any edit of a word can
lose is its bound, at most 3, and words of 7 letters or more always have more grams than that. So of its
grams in order of their frequency, rarest first, one more than the bound must hold one that a near word
kept, and by the same order the near word lists it too. Only these short lists are merged.

A gram that is kept stands before the edit or behind it. In the first case all of the word up to the
gram's end is kept, in the second all from its start, so a word enters two lists per gram, under its
beginning and under its end, and only what remains of it can differ. The members of a list are verified
in linear time: two of one length must agree without the letter at one place, two of different lengths if
one is the other without a letter. A pair may meet in several lists and counts in the first one that
both words share. Lists of over ``LONG_LIST`` words are dealt out again by what remains of a word
without one of its letters; such a list has at most as many words as letters exist, or a word has near words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilth.llm.common import bounded_batches, materialize, shuffle_width, splittable

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Characters of a text that are cut into words at a time, and words a task counts before it passes them on.
BLOCK, KEPT = 1 << 20, 400_000
#: A pair of letters is frequent, and so extended, if it is more than this share of all pairs of the vocabulary.
FREQUENT = 1 / 2000
LONG_LIST = 20_000
LEAST = 7


def runs_of(text: str):
    """Lists of the maximal runs of letters of a text, lower-cased, a block of the text at a time."""
    text, at = text.translate(LOWER), 0
    while at < len(text):
        end = min(len(text), at + BLOCK)
        while end < len(text) and RUN.match(text, end):  # to the end of the run
            end = RUN.match(text, end).end()
        yield RUN.findall(text, at, end)
        at = end


def misspelt(doc_id, run: str) -> str:
    """The run, or without one of its letters for one of 31 pairs of document and run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, least: int = LEAST, twice: int = 2) -> DataFrame:
    """word, n: distinct results of at least ``least`` letters and ``twice`` occurrences in all of ``docs``."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        def rows(found):
            words = list(found)
            for lo in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + 50_000], pa.string()), pa.array([found[w] for w in words[lo : lo + 50_000]], pa.int64())], ["word", "n"])

        total: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for runs in runs_of(text or ""):
                    for word, n in Counter(runs).items():
                        if len(word) >= least:
                            word = misspelt(doc_id, word)
                            if len(word) >= least:
                                total[word] += n
                if len(total) > KEPT:
                    yield from rows(total)
                    total = Counter()
        yield from rows(total)

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How often each pair and triple of letters occurs in the vocabulary: at most 90 ** 2 + 90 ** 3 entries, whatever the corpus."""

    def run(batches):
        import pyarrow as pa

        total: Counter[str] = Counter()
        for batch in batches:
            for w in batch.column(0).to_pylist():
                total.update(w[i : i + 2] for i in range(len(w) - 1))
                total.update(w[i : i + 3] for i in range(len(w) - 2))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["gram", "c"])

    found = words.select("word").mapInArrow(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    return {r["gram"]: r["c"] for r in found.toLocalIterator()}


def frequent_pairs(counts: dict[str, int], share: float = FREQUENT) -> frozenset[str]:
    pairs = {g: c for g, c in counts.items() if len(g) == 2}
    return frozenset(g for g, c in pairs.items() if c > share * sum(pairs.values()))


def decompose(word: str, frequent: frozenset[str]) -> list[tuple[int, int]]:
    """(start, end) of the grams of a word: the longest of the dictionary at each place, none within an earlier one."""
    n, last, spans = len(word), 0, []
    for p in range(n - 1):
        e = p + 3 if p + 3 <= n and word[p : p + 2] in frequent else p + 2
        if e > last:
            spans.append((p, e))
            last = e
    return spans


@lru_cache(maxsize=100_000)
def _most_lost(spans: tuple[tuple[int, int], ...]) -> int:
    n, most, lo = spans[-1][1], 0, 0
    for i in range(n + 1):
        while lo < len(spans) and spans[lo][1] < i:
            lo += 1
        changed = inserted = 0
        for p, e in spans[lo : lo + 8]:  # those that end at i or later and start before i + 3
            changed += p <= i < e or (p > i and e <= i + 3)
            inserted += p < i < e or (p >= i and e <= i + 2) or (i == n and e == n)
        most = max(most, changed if i < n else 0, inserted)
    return most


def most_lost(spans: list[tuple[int, int]]) -> int:
    """The most grams of a decomposition that one edit can take away.

    A changed or deleted letter touches the grams over it; an inserted one those over its place, and
    at the word's end the last ones, which may grow. Behind the edit, a gram may come to lie within a
    new one that starts at or before the edit and ends no sooner than it.
    """
    start = spans[0][0]
    if len(spans) <= 24:
        return _most_lost(tuple((p - start, e - start) for p, e in spans))
    return max(_most_lost(tuple((p - spans[lo][0], e - spans[lo][0]) for p, e in spans[lo : lo + 24])) for lo in range(0, len(spans), 12))


def lists_of(word: str, counts: dict[str, int], frequent: frozenset[str]) -> list[int]:
    """The lists a word enters, packed: 4 * start of the gram + 2 if what is behind it is kept + 1 if it has three letters.

    They belong to its rarest grams, one more than an edit can take away. Two words have the lists they share in one
    order: by frequency, gram and side, then place, which is counted from the same end.
    """
    spans = decompose(word, frequent)
    kept = most_lost(spans) + 1
    if kept > len(spans):
        raise ValueError(f"{word} has too few grams")
    rare = sorted((counts.get(word[p:e], 0), word[p:e], p) for p, e in spans)[:kept]
    return [4 * p + 2 * side + len(g) - 2 for _, g, side, p in sorted((c, g, side, p) for c, g, p in rare for side in (0, 1))]


def distance_one(rests: list[str]) -> list[tuple[int, int]]:
    """Pairs of places in a list of distinct strings that one edit takes to each other; linear in their letters."""
    if len(rests) == 2:
        a, b = sorted(rests, key=len)
        if len(b) - len(a) > 1:
            return []
        begin, end = common(a, b)
        return [(0, 1)] if begin + end >= len(b) - 1 else []
    at, groups, pairs = {r: i for i, r in enumerate(rests)}, defaultdict(list), []
    for j, r in enumerate(rests):
        shorter = set()
        for i in range(len(r)):
            v = r[:i] + r[i + 1 :]
            groups[i, v].append(j)
            shorter.add(v)
        pairs += [(at[v], j) for v in shorter if v in at]
    for g in groups.values():
        if len(g) > 1:
            pairs += [(a, b) for k, a in enumerate(g) for b in g[:k]]
    return pairs


def common(a: str, b: str) -> tuple[int, int]:
    """Lengths of the common beginning and of the common end."""
    n = min(len(a), len(b))
    x = next((i for i in range(n) if a[i] != b[i]), n)
    y = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    return x, y


def first_shared(a: str, b: str, a_lists: list[int], b_lists: list[int], rank: int) -> bool:
    """Whether list number ``rank`` of ``a`` is its first that ``b`` is in, too."""
    begin, end = common(a, b)
    shift = 4 * (len(b) - len(a))
    for x in a_lists[:rank]:
        if x & 2:
            if len(a) - (x >> 2) <= end and x + shift in b_lists:
                return False
        elif (x >> 2) + 2 + (x & 1) <= begin and x in b_lists:
            return False
    return True


ENTRY = "list long, rank int, word string, n long, lists array<int>"


def kept_part(word: str, x: int) -> str:
    """What the words of a list share: their beginnings up to the gram's end, or all from its start."""
    return ">" + word[x >> 2 :] if x & 2 else "<" + word[: (x >> 2) + 2 + (x & 1)]


def remains(word: str, x: int) -> str:
    """What may differ between the words of a list."""
    return word[: x >> 2] if x & 2 else word[(x >> 2) + 2 + (x & 1) :]


def entries_of(words: DataFrame, counts: dict[str, int], share: float = FREQUENT) -> DataFrame:
    """Words with their lists: list (hash of what is kept), rank of it among the word's, word, n, lists (packed, in order)."""
    spark: SparkSession = words.sparkSession
    shared = spark.sparkContext.broadcast((counts, frequent_pairs(counts, share)))

    def run(batches):
        import pyarrow as pa
        import xxhash

        schema = pa.schema([("list", pa.int64()), ("rank", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("lists", pa.list_(pa.int32()))])
        counts, frequent = shared.value
        for batch in batches:
            hashes, ranks, names, ns, lists = [], [], [], [], []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = lists_of(word, counts, frequent)
                hashes += [xxhash.xxh64_intdigest(kept_part(word, x)) - (1 << 63) for x in mine]
                ranks += range(len(mine))
                names += [word] * len(mine)
                ns += [n] * len(mine)
                lists += [mine] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((hashes, ranks, names, ns, lists), schema.types, strict=True)], schema=schema)

    return words.select("word", "n").mapInArrow(run, ENTRY)


def dealt_again(entries: DataFrame) -> DataFrame:
    """Entries of long lists, once for each letter that may go from what remains of the word, and once whole.

    ``kind`` is 1 where words of one length meet, 2 in lists of a word (with ``whole``) and the longer ones near it.
    """

    def run(batches):
        import pyarrow as pa
        import xxhash

        schema = pa.schema([("list", pa.int64()), ("rank", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("lists", pa.list_(pa.int32())), ("kind", pa.int32()), ("whole", pa.bool_())])
        for batch in batches:
            out = []
            for key, rank, word, n, lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rest = remains(word, lists[rank])
                of = lambda s: xxhash.xxh64_intdigest(f"{key}:{s}") - (1 << 63)  # noqa: B023, E731
                shorter = [rest[:i] + rest[i + 1 :] for i in range(len(rest))]
                out += [(of(f"{i}:{v}"), rank, word, n, lists, 1, False) for i, v in enumerate(shorter)]
                out += [(of(v), rank, word, n, lists, 2, False) for v in set(shorter)] + [(of(rest), rank, word, n, lists, 2, True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return entries.mapInArrow(run, ENTRY + ", kind int, whole boolean")


NEAR = "word string, n_near long, form_n long, form string"


def near_words(entries: DataFrame, parts: int) -> DataFrame:
    """Lists -> word, n_near, form_n, form (the largest n of the near words, then the smallest of them): partial, to be added up by word."""

    def run(batches):
        import pyarrow as pa

        found: dict[str, tuple[int, int, str]] = {}

        def meet(a, n, b, m):
            near, best, name = found.get(a, (0, 0, ""))
            found[a] = (near + 1, *((m, b) if m > best or (m == best and b < name) else (best, name)))

        def merge(rows, kind):
            if kind == 2:
                short = [r for r in rows if r[5]]
                pairs = [(s, r) for s in short for r in rows if not r[5] and one_more(s, r)]
            else:
                by: dict[str, list] = defaultdict(list)
                for r in rows:  # lists whose hashes meet are told apart
                    by[kept_part(r[1], r[3][r[0]])].append(r)
                pairs = [(g[i], g[j]) for g in by.values() if len(g) > 1 for i, j in distance_one([remains(r[1], r[3][r[0]]) for r in g])]
                if kind == 1:
                    pairs = [(a, b) for a, b in pairs if len(a[1]) == len(b[1])]
            for a, b in pairs:
                if first_shared(a[1], b[1], a[3], b[3], a[0]):
                    meet(a[1], a[2], b[1], b[2])
                    meet(b[1], b[2], a[1], a[2])

        def one_more(s, r):
            return len(r[1]) == len(s[1]) + 1 and kept_part(r[1], r[3][r[0]]) == kept_part(s[1], s[3][s[0]]) and sum(common(s[1], r[1])) >= len(s[1])

        def out():
            rows = [(w, *x) for w, x in found.items()]
            found.clear()
            for lo in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[lo : lo + 20_000], strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "form_n", "form"])

        now, rows = None, []
        for batch in batches:
            for key, rank, word, n, lists, kind, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, kind) != now:
                    if len(rows) > 1:
                        merge(rows, now[1])
                    now, rows = (key, kind), []
                rows.append((rank, word, n, lists, kind, whole))
            if len(found) > KEPT:
                yield from out()
        if len(rows) > 1:
            merge(rows, now[1])
        yield from out()

    return entries.repartition(parts, "list").sortWithinPartitions("list", "kind").mapInArrow(run, NEAR)


def roots_of(forms: DataFrame) -> DataFrame:
    """word, form -> word, root. A form is ten times as frequent, so chains are short: each round doubles what is followed."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = materialize(now.join(splittable_words(step), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        now = after.drop("_moved")
        if not after.where("_moved").limit(1).count():
            return now


def splittable_words(df: DataFrame) -> DataFrame:
    """As ``common.splittable`` for a string key: the join gets a shuffle of its own."""
    return df.withColumn("root", F.concat("root", F.lit("")))


def variants(docs: DataFrame, times: int = 10, share: float = FREQUENT, long_list: int = LONG_LIST) -> DataFrame:
    """Words of ``docs`` (doc_id, text, ...) -> word, n, n_near, form, form_n, root, one row per word.

    A form is the near word of largest n (ties: the smallest) if that n is at least ``times`` the word's.
    The root is where following forms ends, the word itself if it has none. A null or empty text has no
    words; a null doc_id counts as empty text where letters are dropped. Repeated rows count each. A run of letters may be
    as long as its text. Other columns are ignored.
    """
    spark = docs.sparkSession
    words = materialize(vocabulary(docs), "words")
    entries = materialize(entries_of(words, gram_counts(words), share), "lists")
    long = entries.groupBy("list").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > long_list).select("list")
    long = materialize(long, "long-lists")
    as_they_are = entries.join(splittable(long, "list"), "list", "left_anti").withColumns({"kind": F.lit(0), "whole": F.lit(False)})
    again = dealt_again(entries.join(splittable(long, "list"), "list", "left_semi").select("list", "rank", "word", "n", "lists"))
    near = near_words(as_they_are.unionByName(again), 4 * shuffle_width(spark))
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("f")))
    near = materialize(near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.f").alias("form"), (-F.col("b.m")).alias("form_n")), "near")
    known = words.join(near, "word", "left")
    has = F.coalesce(F.col("form_n") >= times * F.col("n"), F.lit(False))
    known = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")), "forms")
    roots = roots_of(known.where("form is not null"))
    return known.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "form", "root", "n", "n_near", "form_n")
