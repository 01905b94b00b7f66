"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers up to the capacity, so a packing depends only on how many pieces of each
length there are: the histogram (at most ``capacity`` rows, whatever the corpus) is packed by
branch and bound on the driver, within a bounded effort, and the resulting runs of equal sequences are dealt out to the
pieces by their rank among pieces of the same length. Pieces never travel to the driver.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tilth.llm.common import bounded_batches, materialize, shuffle_width
from tilth.llm.word_tokens import encoder, text_blocks


# ---- planning over the histogram ---------------------------------------------------------------
@dataclass
class Run:
    """``times`` sequences of the same make: ((length, how many of it), ...), longest first."""

    times: int
    items: tuple[tuple[int, int], ...]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """No packing uses fewer bins: total size, and for each cut the pieces that can't share."""
    lengths = np.arange(len(counts))
    total = int((counts * lengths).sum())
    best = -(-total // capacity)
    half = capacity // 2
    n_from = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])  # pieces of at least this length
    size_from = np.concatenate([np.cumsum((counts * lengths)[::-1])[::-1], [0]])
    for cut in range(0, half + 1):
        huge = int(n_from[capacity - cut + 1])
        large = int(n_from[half + 1]) - huge
        room = large * capacity - int(size_from[half + 1] - size_from[capacity - cut + 1])
        small = int(size_from[max(cut, 1)] - size_from[half + 1])
        best = max(best, huge + large + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: list[int], capacity: int) -> list[Run]:
    """Best fit decreasing, a run of equal pieces and equal bins at a time."""
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}  # room left -> (how many bins, what is in each)
    for length in range(capacity, 0, -1):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            times, items = open_[room].pop() if room is not None else (left, {})
            if room is not None and not open_[room]:
                del open_[room]
            each = (capacity if room is None else room) // length
            full = min(times, left // each)
            part = left % each if full < times else 0  # one more bin takes what is left
            kept = (capacity if room is None else room) - each * length
            if full:
                open_.setdefault(kept, []).append((full, items | {length: each}))
                left -= full * each
            if part and full < times:
                open_.setdefault((capacity if room is None else room) - part * length, []).append((1, items | {length: part}))
                left -= part
                full += 1
            if room is not None and full < times:
                open_.setdefault(room, []).append((times - full, items))
    return [Run(times, tuple(sorted(items.items(), reverse=True))) for bins in open_.values() for times, items in bins]


def fillings(counts: list[int], largest: int, gap: int, most_waste: int):
    """Undominated ways to fill ``gap`` beside ``largest``: (waste, ((length, n), ...)), the least waste first.

    For each waste up to ``most_waste`` all sets with just that sum are enumerated, with every number of
    each length; sums that the lengths still to come can't reach, kept as bits of whole numbers, cut the
    branches. A filling is dominated, and left out, if a piece not in it could join it or take the place
    of some of its pieces that it is at least as long as together (one of just its own length aside).
    """
    sizes = [length for length in range(min(gap, largest), 0, -1) if counts[length]]
    whole = (1 << gap + 1) - 1
    reach = [1] * (len(sizes) + 1)  # sums up to the gap of the lengths from this place on
    for i in range(len(sizes) - 1, -1, -1):
        bits, left, step = reach[i + 1], min(counts[sizes[i]], gap // sizes[i]), 1
        while left:
            some = min(step, left)
            bits |= bits << some * sizes[i] & whole
            left, step = left - some, step * 2
        reach[i] = bits

    def exact(i: int, need: int, items: tuple[tuple[int, int], ...]):
        while need:
            if not reach[i] >> need & 1:
                return
            size = sizes[i]
            for n in range(min(counts[size], need // size), 0, -1):
                if reach[i + 1] >> need - n * size & 1:
                    yield from exact(i + 1, need - n * size, (*items, (size, n)))
            i += 1
        yield items

    spare = sum(1 << size for size in sizes)
    for waste in range(min(gap, most_waste) + 1):
        if not reach[0] >> gap - waste & 1:
            continue
        for items in exact(0, gap - waste, ()):
            left_out = spare & ~sum(1 << size for size, n in items if n == counts[size])
            sums, several = 1, 0  # of any of its pieces, of two and more
            for size, n in items:
                for _ in range(n):
                    several |= (several | sums & ~1) << size
                    sums |= sums << size
            if not left_out & several and not any(left_out >> d & sums for d in range(1, waste + 1)):
                yield waste, items


def plan_bins(histogram: dict[int, int], capacity: int, effort: int = 2000) -> list[Run]:
    """Pack ``histogram`` {length: count} (lengths 1..capacity) into as few bins as the search finds.

    Bin completion: take the longest piece left, complete its bin with an undominated filling, and
    use that make as often as its scarcest part lasts or, on later branches, less often. The first
    incumbents are best fit decreasing and the way down that always takes the least waste. Then ways
    are tried depth first; the waste that a packing better than the incumbent may still have bounds the
    fillings. The search ends at the lower bound, when no branch is left (the packing is then optimal),
    or after ``effort`` bins were completed: finding the optimum is NP-hard. Every piece is packed whatever
    the limit, never in more bins than best fit decreasing needs.
    """
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        counts[length] += n
    goal = lower_bound(np.array(counts, dtype=np.int64), capacity)
    best = best_fit(counts, capacity)
    least = sum(run.times for run in best)
    rest = sum(length * n for length, n in enumerate(counts))

    def makes(top: int, most_waste: int):
        """(times, make) to try at a step, ``top`` the longest length left."""
        counts[top] -= 1
        ways = fillings(counts, top, capacity - top, most_waste)
        while True:
            way = next(ways, None)
            counts[top] += 1
            if way is None:
                return
            need = {top: 1}
            for length, n in way[1]:
                need[length] = need.get(length, 0) + n
            make = tuple(need.items())
            most = min(counts[length] // n for length, n in make)
            for times in range(most, 0, -1):
                if times == most or times * way[0] <= most_waste:
                    yield times, make
            counts[top] -= 1

    def use(times: int, make: tuple[tuple[int, int], ...]) -> None:
        nonlocal rest
        for length, n in make:
            counts[length] -= n * times
            rest -= length * n * times

    def top() -> int:
        return next((length for length in range(capacity, 0, -1) if counts[length]), 0)

    if least > goal:  # straight down by least waste
        runs, start = [], list(counts)
        while longest := top():
            times, make = next(makes(longest, capacity))
            use(times, make)
            runs.append(Run(times, tuple(sorted(make, reverse=True))))
        counts[:] = start
        rest = sum(length * n for length, n in enumerate(counts))
        if sum(run.times for run in runs) < least:
            least, best = sum(run.times for run in runs), runs

    def open_step(used: int):
        allowed = (least - 1 - used) * capacity - rest
        return makes(top(), allowed) if allowed >= 0 else iter(())

    steps, used = [open_step(0)], 0
    path: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    while steps and least > goal and effort > 0:
        choice = next(steps[-1], None)
        if choice is None:
            steps.pop()
            if path:
                times, make = path.pop()
                use(-times, make)
                used -= times
            continue
        effort -= 1
        use(*choice)
        path.append(choice)
        used += choice[0]
        if rest:
            steps.append(open_step(used))
            continue
        if used < least:
            least, best = used, [Run(times, tuple(sorted(make, reverse=True))) for times, make in path]
        times, make = path.pop()
        use(-times, make)
        used -= times
    return best


# ---- pieces of documents -----------------------------------------------------------------------
PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> one row per piece of at most ``capacity`` ids.

    A document's ids are its text's ids by the vocabulary, then ``end_id``; a null text is empty and
    so has one id. ``with_ids`` adds ``ids`` (little-endian unsigned 32-bit). Rows with the same or
    a null doc_id are separate documents. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    schema = T.StructType([*PIECES.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        import pyarrow as pa

        encode = encoder(vocabulary).encode
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_blocks(texts):
                rows = []
                for key, ids in zip(keys[a:b], encode(texts[a:b]), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
                columns = list(zip(*rows, strict=True))[: len(schema)]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], schema.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def pack(pieces: DataFrame, capacity: int, order: list[str], **search) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (any columns, ``length`` in 1..capacity).

    ``pieces`` should be cheap to read twice (a table). ``order`` names columns that fix the order
    among pieces of one length. An empty input gives an empty result. A length shared by very many
    pieces is ranked in as many parts as there are shuffle partitions, so no task holds all of it.
    The driver holds at most capacity x parts counts and the plan, whose size depends on the
    capacity alone.
    """
    spark = pieces.sparkSession
    parts = min(1024, max(64, shuffle_width(spark)))
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("length", *order), F.lit(parts)).cast("int"))
    found = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros((capacity + 1, parts), dtype=np.int64)
    counts[found["length"].to_numpy(), found["_part"].to_numpy()] = found["n"].to_numpy()
    before = np.cumsum(counts, axis=1) - counts
    runs = plan_bins({int(l): int(counts[l].sum()) for l in np.flatnonzero(counts.sum(axis=1))}, capacity, **search)

    taken = np.zeros(capacity + 1, dtype=np.int64)
    rows, base = [], 0
    for run in runs:
        place = 0
        for length, n in run.items:
            rows.append((length, taken[length], n, base, place))
            taken[length] += n * run.times
            place += n * length
        base += run.times
    plan = np.array(rows or [(0, 0, 1, 0, 0)], dtype=np.int64)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    wide = np.int64(1) << 48
    shared = spark.sparkContext.broadcast((before, plan[:, 0] * wide + plan[:, 1], plan))

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = pieces.columns

    def place_them(frames):
        before, keys, plan = shared.value
        for frame in frames:
            length = frame["length"].to_numpy(np.int64)
            rank = before[length, frame["_part"].to_numpy(np.int64)] + frame["_rank"].to_numpy(np.int64) - 1
            row = plan[np.searchsorted(keys, length * wide + rank, side="right") - 1]
            nth = rank - row[:, 1]
            out = frame[names].copy()
            out["sequence_id"] = row[:, 3] + nth // row[:, 2]
            out["offset"] = row[:, 4] + nth % row[:, 2] * length
            yield out

    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order)))
    return ranked.mapInPandas(place_them, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, **search) -> DataFrame:
    """Cut ``docs`` into pieces of ids and pack them; one row per piece with its place.

    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Pieces that agree in all columns
    (repeated rows) each get a place of their own.
    """
    pieces = materialize(token_pieces(docs, vocabulary, capacity, end_id), "pieces")
    return pack(pieces, capacity, ["doc_id", "piece", "start", "ids_crc32"], **search)
