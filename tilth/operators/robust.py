"""Robust statistics: exact order statistics, medians, deviations, calibration bands, Theil-Sen lines."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilth.operators import slopes

#: Half-width, in ranks over n, of the bracket searched around a quantile, and the sketch's accuracy.
BRACKET, ACCURACY = 0.01, 10_000

#: Most rows of a grouped side that is broadcast.
FEW = 10_000
#: Rows of a group up to which one task takes its median.
LARGE = 200_000


#: Grouped sides that are kept at a time; the oldest are released, and computed again if a plan still reads them.
KEPT: deque[DataFrame] = deque()
MOST_KEPT = 16


def few_rows(side: DataFrame) -> DataFrame:
    """A small grouped side of a join: computed once and kept; broadcast if it has at most ``FEW`` rows, else joined by shuffle."""
    kept = side.persist()
    KEPT.append(kept)
    while len(KEPT) > MOST_KEPT:
        _drop(KEPT.popleft())
    return F.broadcast(kept) if kept.limit(FEW + 1).count() <= FEW else kept


def release() -> int:
    """Drop all kept sides of joins. -> how many there were."""
    n = len(KEPT)
    while KEPT:
        _drop(KEPT.popleft())
    return n


def _drop(kept: DataFrame) -> None:
    if kept.sparkSession.sparkContext._jsc is not None:  # else its session has ended, and with it what was kept
        kept.unpersist()


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: dict[str, Column]) -> DataFrame:
    """Exact values at 0-based ranks per group: ``wanted`` maps names to rank columns over ``n``.

    One pass sketches each group, a second counts per distinct value inside brackets around the
    wanted ranks (what lies below is one row), so no group is ever sorted in one task. Null values
    don't count. Returns keys, n and a column per name; groups without values are absent.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", [i / 200 for i in range(201)], ACCURACY).alias("_grid"))
    names = list(wanted)
    ranks = sizes.withColumn("_w", F.array(*[F.struct(F.lit(i).alias("i"), wanted[k].cast("long").alias("rank")) for i, k in enumerate(names)]))
    at = lambda share: F.get("_grid", F.greatest(F.lit(0), F.least(F.lit(200), share)).cast("int"))
    bracket = F.transform(
        "_w",
        lambda w: F.struct(
            w["i"].alias("i"), w["rank"].alias("rank"),
            at(F.floor((w["rank"] / F.col("n") - BRACKET) * 200)).alias("lo"), at(F.ceil((w["rank"] / F.col("n") + BRACKET) * 200)).alias("hi"),
        ),
    )
    # grid ends hold no slack: the first is the least value, the last the largest
    marks = few_rows(ranks.select(*keys, "n", bracket.alias("_b")))
    seen = (
        rows.join(marks, keys)
        .select(*keys, "n", "_v", F.explode("_b").alias("b"))
        .where("_v <= b.hi")
        .groupBy(*keys, "n", F.col("b.i").alias("i"), F.col("b.rank").alias("rank"), F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = F.sum("_c").over(Window.partitionBy(*keys, "i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    picked = seen.withColumn("_upto", upto).where(F.col("_upto") > F.col("rank")).groupBy(*keys, "n").agg(*[F.min(F.when(F.col("i") == i, F.col("_v"))).alias(k) for i, k in enumerate(names)])
    return picked


def nearest_rank(q: float) -> Column:
    """0-based nearest rank of a quantile, half to even."""
    return F.bround(F.lit(q) * (F.col("n") - 1), 0).cast("long")


def medians(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Interpolated median per group: keys, n, ``name``."""
    found = order_statistics(df, keys, value, {"_lo": F.floor((F.col("n") - 1) / 2), "_hi": F.floor(F.col("n") / 2)})
    return found.select(*keys, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias(name))


def calibration_bands(samples: DataFrame, rule: str, value: str, k: float = 3.0, one_sided: tuple[str, ...] = (), floors: dict[str, float] | None = None, default_floor: float = 3.0, least: int = 5) -> DataFrame:
    """Band per rule from reference measurements.

    rule, n, median, mad, lo, hi, p10, p90, one_sided. A one-sided rule first loses values under its
    floor and takes its band from the 5th and 95th percentiles instead of median -/+ k MAD (not
    below 0). Percentiles are nearest-rank. Rules with fewer than ``least`` values are absent.
    """
    floor = F.coalesce(*[F.when(F.col(rule) == r, F.lit(f)) for r, f in (floors or {}).items()], F.lit(default_floor))
    is_one = F.col(rule).isin(*one_sided) if one_sided else F.lit(False)
    kept = samples.where(F.col(value).isNotNull() & (~is_one | (F.col(value) >= floor)))
    wanted = {"_lo": F.floor((F.col("n") - 1) / 2), "_hi": F.floor(F.col("n") / 2)}
    wanted |= {p: nearest_rank(q) for p, q in (("p05", 0.05), ("p10", 0.10), ("p90", 0.90), ("p95", 0.95))}
    spots = few_rows(order_statistics(kept, [rule], value, wanted).withColumn("median", (F.col("_lo") + F.col("_hi")) / 2))
    away = kept.join(spots.select(rule, "median"), rule).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    mad = medians(away, [rule], "_d", "mad").select(rule, F.when(F.col("mad") == 0, 1e-9).otherwise(F.col("mad")).alias("mad"))
    band = spots.where(F.col("n") >= least).join(mad, rule)
    return band.select(
        rule, "n", "median", "mad",
        F.when(is_one, F.col("p05")).otherwise(F.greatest(F.lit(0.0), F.col("median") - k * F.col("mad"))).alias("lo"),
        F.when(is_one, F.col("p95")).otherwise(F.col("median") + k * F.col("mad")).alias("hi"),
        "p10", "p90", is_one.alias("one_sided"),
    )


def group_medians(df: DataFrame, keys: list[str], value: str, name: str, large: int = LARGE) -> DataFrame:
    """Interpolated median per group, no window: a hash aggregate for groups of up to ``large`` rows, ``medians`` for larger ones."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large).select(*keys)
    plain = lambda rows: rows.groupBy(*keys).agg(F.median(value).alias(name))
    if sizes.isEmpty():
        return plain(df)
    sizes = few_rows(sizes)
    return plain(df.join(sizes, keys, "left_anti")).unionByName(medians(df.join(sizes, keys, "left_semi"), keys, value, name).select(*keys, name))


def theil_sen(points: DataFrame, keys: list[str], x: str, y: str, least: int = 8, block: int = slopes.BLOCK, large: int = LARGE) -> DataFrame:
    """keys, n, slope, intercept: the median of all pairwise slopes, exact (``slopes``), and of what is left of y; groups under ``least`` rows are absent, ones without two different x too."""
    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    sizes = few_rows(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))
    rows = rows.join(sizes.select(*keys), keys, "left_semi")
    found = few_rows(slopes.median_slopes(rows, keys, "_x", "_y", block))
    rest = rows.join(found, keys).withColumn("_r", F.col("_y") - F.col("slope") * F.col("_x"))
    return group_medians(rest, keys, "_r", "intercept", large).join(found, keys).join(sizes, keys).select(*keys, "n", "slope", "intercept")


def outliers(points: DataFrame, fit: DataFrame, keys: list[str], x: str, y: str, min_abs: float, mad_k: float, ratio_low: float, ratio_high: float, large: int = LARGE) -> DataFrame:
    """Rows far from their group's line: z, expected, ratio, reason, whether outlier; all rows of fitted groups."""
    rows = points.join(few_rows(fit.select(*keys, "slope", "intercept")), keys).withColumn("expected", F.col("slope") * F.col(x) + F.col("intercept"))
    rows = rows.withColumn("residual", F.col(y) - F.col("expected"))
    rows = rows.join(few_rows(group_medians(rows, keys, "residual", "_m", large)), keys).withColumn("_a", F.abs(F.col("residual") - F.col("_m")))
    rows = rows.join(few_rows(group_medians(rows, keys, "_a", "_d", large)), keys).withColumn("_d", F.when(F.col("_d") == 0, 1e-9).otherwise(F.col("_d")))
    ratio = F.when(F.col("expected") > 0, F.col(y) / F.col("expected")).otherwise(0.0)
    rows = rows.withColumns({"z": F.col("_a") / F.col("_d"), "ratio": ratio})
    short = F.col(y) < min_abs
    far = (F.col("z") > mad_k) & ((F.col("ratio") < ratio_low) | (F.col("ratio") > ratio_high))
    reason = F.when(short, "too_short_abs").when(F.col("ratio") > ratio_high, "too_long").otherwise("too_short")
    return rows.withColumn("outlier", short | far).withColumn("reason", F.when(F.col("outlier"), reason)).drop("_m", "_d", "_a")
