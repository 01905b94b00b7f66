"""Character alignments and spectra as Arrow-batched functions: what expressions can't say."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

GAP, SLACK = 1, 4


class Rows:
    """Edit distances of all prefixes of ``hyp`` (rows) and ``ref``, a row at a time as bits of integers.

    Neighbouring distances differ by at most one, so a row is two bit vectors over ``ref``, its rises and its falls. With a free
    start any part of ``ref`` may be skipped before. Steps back need a row's rises and where its diagonal step is free; those are
    kept for one block of rows at a time and computed again from the block's first row, so n by m letters take
    about m * sqrt(n) / 2 bits instead of n * m numbers.
    """

    def __init__(self, hyp: str, ref: str, free_start: bool):
        self.hyp, self.ref, self.free_start = hyp, ref, free_start
        self.mask = (1 << len(ref)) - 1
        self.first = 0 if free_start else self.mask
        self.places: dict[str, int] = {}
        low = {c: [] for c in set(hyp)}
        for j, c in enumerate(ref):
            if c in low:
                low[c].append(j)
        for c, js in low.items():
            bits = np.zeros(len(ref), np.uint8)
            bits[js] = 1
            self.places[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        self.block = max(64, int(len(hyp) ** 0.5))

    def run(self, lo: int, hi: int, rises: int, falls: int, keep: list | None = None) -> tuple[int, int]:
        """Rises and falls of row ``hi`` from those of row ``lo``."""
        mask, places = self.mask, self.places
        for c in self.hyp[lo:hi]:
            same = places[c]
            free = (((same & rises) + rises) ^ rises) | same | falls
            up = (falls | ~(free | rises)) << 1 | 1
            down = (rises & free) << 1
            rises = (down | ~(free | up)) & mask
            falls = up & free & mask
            if keep is not None:
                keep.append((free, rises))
        return rises, falls

    def last_row(self) -> np.ndarray:
        """Distances of all of ``hyp`` to each prefix of ``ref``."""
        n = len(self.ref)
        up, down = (np.unpackbits(np.frombuffer(x.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n].astype(np.int64) for x in self.run(0, len(self.hyp), self.first, 0))
        return len(self.hyp) + np.concatenate([[0], np.cumsum(up - down)])

    def walk(self, j: int) -> tuple[dict[int, int], int]:
        """Steps back from (all of hyp, j): diagonal before deletion before insertion. -> (matches, where it began)."""
        m = len(self.hyp)
        starts, now = [], (self.first, 0)
        for lo in range(0, m, self.block):
            starts.append(now)
            now = self.run(lo, min(m, lo + self.block), *now)
        i, matched, kept, base = m, {}, [], m
        while i and j:
            if i <= base:
                base = (i - 1) // self.block * self.block
                kept = []
                self.run(base, i, *starts[base // self.block], kept)
            free, rises = kept[i - 1 - base]
            if self.hyp[i - 1] == self.ref[j - 1]:
                i, j = i - 1, j - 1
                matched[j] = i
            elif not free >> (j - 1) & 1:
                i, j = i - 1, j - 1
            elif rises >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
        return matched, j if self.free_start else 0


def matched_positions(hyp: str, ref: str) -> list[int | None]:
    """For each character of ``ref`` the place in ``hyp`` of the equal character it is aligned with, else None."""
    if not hyp or not ref:
        return [None] * len(ref)
    found, _ = Rows(hyp, ref, False).walk(len(ref))
    return [found.get(j) for j in range(len(ref))]


def reached_region(hyp: str, ref: str) -> tuple[int, int] | None:
    """First and last place of the part of ``ref`` that ``hyp`` explains best, both ends free; the later end on ties."""
    if not hyp or not ref:
        return None
    rows = Rows(hyp, ref, True)
    end = len(ref) - int(rows.last_row()[::-1].argmin())
    _, start = rows.walk(end)
    return start, max(start, end - 1)


def fit_distance(hyp: str, window: str, end: str | None = None) -> float:
    """Least edit distance of ``hyp`` to a prefix of ``window`` or a suffix of ``end`` (None: of ``window``), over hyp's length.

    An empty prefix costs hyp's length, one of over twice that length more, so longer ones needn't be looked at.
    """
    if not hyp:
        return 0.0
    if not window:
        return 1.0
    head, tail = window[: 2 * len(hyp)], (window if end is None else end)[::-1][: 2 * len(hyp)]
    return int(min(Rows(hyp, head, False).last_row().min(), Rows(hyp[::-1], tail, False).last_row().min())) / len(hyp)


def _matched(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    return pd.Series([None if h is None or r is None else matched_positions(h, r) for h, r in zip(hyp, ref, strict=True)])


def _region(hyp: pd.Series, ref: pd.Series) -> pd.DataFrame:
    found = [reached_region(h or "", r or "") or (None, None) for h, r in zip(hyp, ref, strict=True)]
    return pd.DataFrame(found, columns=["start", "end"]).astype("Int64")


def _fit(hyp: pd.Series, head: pd.Series, tail: pd.Series) -> pd.Series:
    return pd.Series([fit_distance(h or "", x or "", y or "") for h, x, y in zip(hyp, head, tail, strict=True)])


def shared_bigrams(a: str, b: str) -> int:
    """Size of the multiset intersection of two texts' character pairs."""
    bag = lambda t: Counter(t[i : i + 2] for i in range(max(1, len(t) - 1))) if t else Counter()
    return (bag(a) & bag(b)).total()


def _numbered_pairs(t: str, backwards: bool = False) -> list[tuple[str, int]]:
    """Character pairs with their number among the equal ones so far; bags of two texts share as many as their sets of these do."""
    seen: dict[str, int] = {}
    out = []
    places = range(max(1, len(t) - 1)) if t else range(0)
    for i in reversed(places) if backwards else places:
        pair = t[i : i + 2]
        k = seen[pair] = seen.get(pair, -1) + 1
        out.append((pair, k))
    return out


def most_shared(clips: list[str], caps: list[int], heads: list[str], tails: list[str]) -> np.ndarray:
    """For each clip and run the larger of the character pairs that the clip shares with the run's first or last letters, as many as the clip's cap."""
    vocabulary: dict[tuple[str, int], int] = {}
    own = [[vocabulary.setdefault(x, len(vocabulary)) for x in _numbered_pairs(c)] for c in clips]
    of = np.zeros((len(clips), max(1, len(vocabulary))), np.float32)
    for i, places in enumerate(own):
        of[i, places] = 1
    best = np.zeros((len(clips), len(heads)), np.float32)
    limit = np.array(caps, np.int64)
    for texts, backwards in ((heads, False), (tails, True)):
        known = [[(at, vocabulary[x]) for at, x in enumerate(_numbered_pairs(t, backwards)) if x in vocabulary] for t in texts]
        run = np.repeat(np.arange(len(texts)), [len(k) for k in known])
        at, word = (np.array([x[c] for k in known for x in k], np.int64) for c in range(2))
        for cap in np.unique(limit).tolist():
            # the first pairs of a text are those of its beginning, the pair of a single letter is whole
            inside = at < max(1, cap - 1)
            table = np.zeros((of.shape[1], len(texts)), np.float32)
            table[word[inside], run[inside]] = 1
            some = limit == cap
            best[some] = np.maximum(best[some], of[some] @ table)
    return best.astype(np.int64)


def word_ratios(hyp: str, ref: str, spans: list[tuple[int, int]], gap: int = GAP, slack: int = SLACK) -> list[float | None]:
    """Share of each word's letters (``spans`` of places in ``ref``) that ``hyp`` matches in one piece.

    None: outside the part of ``ref`` the clip reached, give or take ``slack``; 1 for a word without
    letters; 0 if none match or the matches lie more than ``gap`` apart.
    """
    first = spans[0][0] if spans else 0
    region = reached_region(hyp, ref[first:])
    lo, hi = (first, first) if region is None else (first + region[0], first + region[1] + 1)
    lo, hi = max(0, lo - slack), min(len(ref), hi + slack)
    matched = matched_positions(hyp, ref[lo:hi])
    out: list[float | None] = []
    for start, end in spans:
        if end <= lo or start >= hi:
            out.append(None)
            continue
        places = [p for p in matched[max(0, start - lo) : max(0, end - lo)] if p is not None]
        if end == start:
            out.append(1.0)
        elif not places or max(places) - min(places) + 1 - len(places) > gap:
            out.append(0.0)
        else:
            out.append(len(places) / (end - start))
    return out


def _word_ratios(hyp: pd.Series, ref: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([word_ratios(h or "", r or "", list(zip(map(int, s), map(int, e), strict=True))) for h, r, s, e in zip(hyp, ref, starts, ends, strict=True)])


def low_share(signal, rate: float, band: float = 1000.0) -> float | None:
    """Share of a Hann-windowed spectrum below ``band`` hertz; None under 32 samples."""
    if signal is None or len(signal) < 32:
        return None
    x = np.asarray(signal, dtype=float)
    size = np.abs(np.fft.rfft(x * np.hanning(len(x))))
    below = np.fft.rfftfreq(len(x), 1.0 / rate) < band
    return float(size[below].sum() / (size.sum() or 1e-9))


def low_share_udf(rate: float, band: float = 1000.0):
    @F.pandas_udf("double")
    def run(signal: pd.Series) -> pd.Series:
        return pd.Series([low_share(s, rate, band) for s in signal], dtype="float64")

    return run


# Column functions. The wrapping happens at the call: workers that import this module have no session.
def matched_udf(hyp, ref):
    return F.pandas_udf(_matched, "array<int>")(hyp, ref)


def region_udf(hyp, ref):
    return F.pandas_udf(_region, "struct<start: int, end: int>")(hyp, ref)


def fit_udf(hyp, window, end=None):
    """``fit_distance``; of a long window its beginning and ``end`` are enough, each at least twice as long as ``hyp``."""
    return F.pandas_udf(_fit, "double")(hyp, window, window if end is None else end)


def word_ratios_udf(hyp, ref, starts, ends):
    return F.pandas_udf(_word_ratios, "array<double>")(hyp, ref, starts, ends)
