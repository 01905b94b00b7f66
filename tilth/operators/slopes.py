"""The exact median of all pairwise slopes, without all pairs.

Two points order themselves by y - t x one way while t is below their slope and the other way above it, so between two
values of t as many pairs change their order as have slopes between them: inversions of one order in the other, which
merging counts in n log n and lists in time of their number. Thresholds from sampled pairs close in on the
median until few enough slopes lie between them to be listed; those are computed and ranked themselves, so
the result is a slope as it would come out of all pairs. A group of one block is done in its task. Larger
groups are dealt into cells of two blocks, each row to as many cells as there are blocks, and only counts per cell
and threshold come back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 17
#: Slopes that are listed at last, in multiples of the rows.
LISTED = 20
CLOSE = 1e-10


def _order(x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Places in order of y - t x; of equal ones the larger x first, as their slope is t and counts as passed."""
    if t == -np.inf:
        return np.lexsort((y, x))
    if t == np.inf:
        return np.lexsort((y, -x))
    return np.lexsort((-x, y - t * x))


def _ranks(order: np.ndarray) -> np.ndarray:
    ranks = np.empty(len(order), dtype=np.int64)
    ranks[order] = np.arange(len(order))
    return ranks


def _merge(sequence: np.ndarray, listed: bool):
    """Inversions of a permutation: their number, or the places (earlier, later) of each."""
    n, total, width = len(sequence), 0, 1
    at = np.arange(n)  # places, sorted by value within runs of ``width``
    earlier, later = [], []
    while width < n:
        run = np.arange(n) // (2 * width)
        left = (np.arange(n) // width) % 2 == 0
        values = sequence[at] + run * (n + 1)  # runs stay apart
        lefts, rights = np.flatnonzero(left), np.flatnonzero(~left)
        upto = np.searchsorted(values[lefts], values[rights])  # lefts of this run and all before that are smaller
        ends = np.minimum((run[rights] + 1) * 2 * width - width, n)
        before = run[rights] * width + np.minimum(width, ends - run[rights] * 2 * width)  # lefts up to the end of this run
        more = before - upto
        if listed:
            if more.sum():
                first = np.repeat(upto, more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
                earlier.append(at[lefts[first]])
                later.append(np.repeat(at[rights], more))
        else:
            total += int(more.sum())
        at = at[np.argsort(values, kind="stable")]
        width *= 2
    if listed:
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(earlier), np.concatenate(later)) if earlier else (none, none)
    return total


def passed(x: np.ndarray, y: np.ndarray, t: float) -> int:
    """How many pairs with different x have a slope up to ``t``, as far as rounding tells them apart from it."""
    return _merge(_ranks(_order(x, y, t))[_order(x, y, -np.inf)], False)


def between(x: np.ndarray, y: np.ndarray, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that ``passed`` counts for ``hi`` and not for ``lo``."""
    order = _order(x, y, lo)
    a, b = _merge(_ranks(_order(x, y, hi))[order], True)
    a, b = order[a], order[b]
    keep = x[a] != x[b]
    return a[keep], b[keep]


def slopes_of(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (y[b] - y[a]) / (x[b] - x[a])


def sampled(x: np.ndarray, y: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    """Slopes of random pairs, sorted."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(x), (2, pairs))
    a, b = a[x[a] != x[b]], b[x[a] != x[b]]
    return np.sort(slopes_of(x, y, a, b))


def valid_pairs(x: np.ndarray) -> int:
    counts = np.unique(x, return_counts=True)[1].astype(object)
    return len(x) * (len(x) - 1) // 2 - int(sum(c * (c - 1) // 2 for c in counts))


class Search:
    """Closes in on the two middle ranks of ``total`` slopes; ``lo`` and ``hi`` bracket them with their counts.

    Tied slopes need thresholds clear of rounding, others need close ones, so each threshold comes at two distances; ``scale``,
    the steepness of the data as a whole, sets the wider.
    """

    def __init__(self, total: int, rows: int, scale: float):
        self.total, self.rows, self.scale, self.stuck = total, rows, scale, False
        self.ranks = ((total - 1) // 2, total // 2)
        self.lo, self.n_lo, self.hi, self.n_hi = -np.inf, 0, np.inf, total

    def gap(self, t: float) -> float:
        return max(CLOSE * max(abs(t), self.scale), 1e-300)

    def many(self) -> bool:
        """Whether the bracket holds more than will be listed."""
        return self.n_hi - self.n_lo > LISTED * self.rows

    def done(self, sample: np.ndarray | None) -> bool:
        """Few enough slopes, or a narrow bracket in which all sampled ones are equal."""
        if not self.many():
            return True
        if sample is None or not np.isfinite(self.hi - self.lo) or self.hi - self.lo > 3 * self.gap(max(abs(self.lo), abs(self.hi))):
            return False
        inside = sample[(sample >= self.lo) & (sample <= self.hi)]
        return len(inside) >= 16 and np.ptp(inside) <= 1e-9 * np.abs(inside).max()

    def tell(self, thresholds, counts) -> None:
        """``counts`` of slopes up to each of ``thresholds``. A side of the bracket moves only to where both ranks stay inside."""
        before = self.n_hi - self.n_lo
        for t, c in zip(thresholds, counts, strict=True):
            if c <= self.ranks[0] and t > self.lo:
                self.lo, self.n_lo = t, c
            elif c > self.ranks[1] and t < self.hi:
                self.hi, self.n_hi = t, c
        self.stuck = not self.stuck and self.n_hi - self.n_lo > 0.7 * before

    def cuts(self, sample: np.ndarray) -> list[float]:
        """Thresholds within the bracket: on both sides of where the sample has the middle, and further out."""
        inside = sample[(sample >= self.lo) & (sample <= self.hi)]
        if len(inside) < 16 or self.stuck:
            far = 2 * float(np.abs(sample).max(initial=0.0)) + 1
            lo, hi = max(self.lo, -far), min(self.hi, far)
            return [lo + (hi - lo) * k / 8 for k in range(1, 8)]
        share = (sum(self.ranks) / 2 - self.n_lo) / max(1, self.n_hi - self.n_lo)
        spread = 1.5 / np.sqrt(len(inside))
        spots = {float(inside[int(min(max(share + spread * k, 0), 1) * (len(inside) - 1))]) for k in (-4, -0.7, 0, 0.7, 4)}
        return sorted({t for s in spots for d in (self.gap(s), 1e-14 * abs(s) + 1e-300) for t in (s - d, s + d) if self.lo < t < self.hi} or {(self.lo + self.hi) / 2})

    def median(self, found: np.ndarray) -> float:
        """From the slopes that the bracket holds."""
        found = np.sort(found)
        return float((found[self.ranks[0] - self.n_lo] + found[self.ranks[1] - self.n_lo]) / 2)

    def tied(self, sample: np.ndarray) -> float:
        """The middle of sampled slopes within a bracket too narrow to hold different ones."""
        inside = sample[(sample >= self.lo) & (sample <= self.hi)]
        return float(inside[len(inside) // 2]) if len(inside) else (self.lo + self.hi) / 2


def steepness(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.ptp(y) / np.ptp(x)) if len(x) and np.ptp(x) else 0.0


def median_slope(x: np.ndarray, y: np.ndarray, pairs: int = 20_000) -> float | None:
    """Median over all pairs with different x; None if there are none. If very many slopes are equal to it up to ``CLOSE``, one of those."""
    total = valid_pairs(x)
    if not total:
        return None
    search, sample = Search(total, len(x), steepness(x, y)), None
    for seed in range(100):
        if search.done(sample):
            break
        sample = sampled(x, y, pairs, seed)
        cuts = search.cuts(sample)
        search.tell(cuts, [passed(x, y, t) for t in cuts])
    if search.many():
        return search.tied(sample)
    return search.median(slopes_of(x, y, *between(x, y, search.lo, search.hi)))


def median_slopes(rows: DataFrame, keys: list[str], x: str, y: str, block: int = BLOCK) -> DataFrame:
    """keys, slope: the exact median of pairwise slopes per group of ``rows``; groups without two different x are absent.

    Null values don't count. Groups of up to ``block`` rows are one task each, larger ones many.
    """
    kinds = ", ".join(f"{rows.schema[k].name} {rows.schema[k].dataType.simpleString()}" for k in keys)
    points = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > block).collect()  # one row per ``block`` rows at most
    schema = f"{kinds}, slope double"

    def of_group(key, frame):
        import pandas as pd

        slope = median_slope(frame["_x"].to_numpy(), frame["_y"].to_numpy())
        return pd.DataFrame([(*key, slope)] if slope is not None else [], columns=[*keys, "slope"])

    if not large:
        return points.groupBy(*keys).applyInPandas(of_group, schema)
    big = rows.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in large], kinds)
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys]
    small = points.alias("p").join(F.broadcast(big).alias("q"), same, "left_anti")
    done = small.groupBy(*keys).applyInPandas(of_group, schema)
    for r in large:
        mine = points
        for k in keys:
            mine = mine.where(F.col(k).eqNullSafe(F.lit(r[k])))
        slope = _large_group(mine, int(r["_n"]), block)
        if slope is not None:
            done = done.unionByName(rows.sparkSession.createDataFrame([(*[r[k] for k in keys], slope)], schema))
    return done


def _large_group(points: DataFrame, n: int, block: int) -> float | None:
    spark = points.sparkSession
    k = -(-n // block)
    ties = points.groupBy("_x").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.col("c").cast("decimal(38,0)") * (F.col("c") - 1) / 2)).first()[0]
    total = n * (n - 1) // 2 - int(ties)
    if not total:
        return None
    sample = points.where(F.rand(7) < 20_000 / n).select("_x", "_y").toArrow()
    sx, sy = sample["_x"].to_numpy(), sample["_y"].to_numpy()
    mine = F.pmod(F.xxhash64("_x", "_y", F.monotonically_increasing_id()), F.lit(k)).cast("int")
    dealt = points.select("_x", "_y", mine.alias("_b"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.struct(F.least(j, F.col("_b")).alias("i"), F.greatest(j, F.col("_b")).alias("j")))
    cells = dealt.withColumn("_c", F.explode(cells)).select("_x", "_y", "_b", F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j"))
    cells = cells.persist()  # the rounds below read it; released at the end
    ends = points.agg(*[f(c) for c in ("_x", "_y") for f in (F.min, F.max)]).first()
    search, drawn = Search(total, n, (ends[3] - ends[2]) / (ends[1] - ends[0])), None

    def counts(cuts):
        def run(key, frame):
            import pandas as pd

            x, y, b = (frame[c].to_numpy() for c in ("_x", "_y", "_b"))
            parts = [(x, y)] if key[0] == key[1] else [(x, y), *((x[b == v], y[b == v]) for v in key)]
            found = [sum((1 if i == 0 else -1) * passed(*p, t) for i, p in enumerate(parts)) for t in cuts]
            return pd.DataFrame({"t": range(len(cuts)), "c": found})

        rows = cells.groupBy("_i", "_j").applyInPandas(run, "t int, c long").groupBy("t").agg(F.sum("c").alias("c")).collect()
        by = {r["t"]: r["c"] for r in rows}
        return [by[i] for i in range(len(cuts))]

    def listed(key, frame):
        import pandas as pd

        x, y, b = (frame[c].to_numpy() for c in ("_x", "_y", "_b"))
        i, j = between(x, y, search.lo, search.hi)
        if key[0] != key[1]:
            i, j = i[b[i] != b[j]], j[b[i] != b[j]]
        return pd.DataFrame({"s": slopes_of(x, y, i, j)})

    try:
        for seed in range(60):
            if search.done(drawn):
                break
            drawn = sampled(sx, sy, 400_000, seed)
            cuts = search.cuts(drawn)
            search.tell(cuts, counts(cuts))
        if search.many():
            return search.tied(drawn)
        from tilth.operators.robust import order_statistics

        found = cells.groupBy("_i", "_j").applyInPandas(listed, "s double").withColumn("g", F.lit(1))
        lo, hi = (F.lit(r - search.n_lo) for r in search.ranks)
        row = order_statistics(found, ["g"], "s", {"lo": lo, "hi": hi}).first()
        return (row["lo"] + row["hi"]) / 2
    finally:
        cells.unpersist()
