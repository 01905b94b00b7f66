"""Grading measurements against bands, unit estimates, word verdicts, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilth.operators.robust import few_rows


def status(value: Column, lo: Column, hi: Column, tolerance: float) -> Column:
    """ok or warn: warn strictly beyond the band widened by the tolerance."""
    return F.when((value < lo - tolerance) | (value > hi + tolerance), "warn").otherwise("ok")


def grade(segments: DataFrame, bands: DataFrame, rule: str, value: str, tolerance: float = 0.8) -> DataFrame:
    """Add ``status`` to each segment; a rule without a band or a segment without a value is unknown."""
    marks = few_rows(bands.select(F.col(rule), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")))
    graded = segments.join(marks, rule, "left")
    found = F.when(F.col("_lo").isNull() | F.col(value).isNull(), "unknown").otherwise(status(F.col(value), F.col("_lo"), F.col("_hi"), tolerance))
    return graded.withColumn("status", found).drop("_lo", "_hi")


def measured_status(rule: Column, measured: Column, lo: Column, hi: Column, nasality: Column, nasal_floor: Column, advisory: Column, lower_only: Column, reliable_floor: Column, tolerance: float = 0.8) -> Column:
    """The grading ladder of one measurement.

    Nothing measured: missing_audio. Advisory rules: ok. Under a rule's reliable floor (null: it has
    none): missing_audio. Rules with only a lower side warn only below the band, others on both
    sides; then a nasality below its floor turns ok into warn.
    """
    sided = F.when(lower_only, F.when(measured < lo - tolerance, "warn").otherwise("ok")).otherwise(status(measured, lo, hi, tolerance))
    nasal = F.when((sided == "ok") & nasality.isNotNull() & nasal_floor.isNotNull() & (nasality < nasal_floor), "warn").otherwise(sided)
    return (
        F.when(rule.isNull(), F.lit(None).cast("string"))
        .when(measured.isNull(), "missing_audio")
        .when(advisory, "ok")
        .when(F.coalesce(measured < reliable_floor, F.lit(False)), "missing_audio")
        .otherwise(nasal)
    )


def roll_up(graded: DataFrame, rule: str, advisory: tuple[str, ...] = ()) -> DataFrame:
    """Per rule: advisory, n_ok (all but warn), n_warn, pass_rate; missing_audio doesn't count."""
    warn = F.col("status") == "warn"
    found = graded.where("status <> 'missing_audio'").groupBy(rule).agg(F.count_if(~warn).alias("n_ok"), F.count_if(warn).alias("n_warn"))
    return found.select(rule, F.col(rule).isin(*advisory).alias("advisory") if advisory else F.lit(False).alias("advisory"), "n_ok", "n_warn", (F.col("n_ok") / (F.col("n_ok") + F.col("n_warn"))).alias("pass_rate"))


def unit_estimate(rows: DataFrame, keys: list[str], anchor: Column, value: str, per_unit: float = 2.0) -> DataFrame:
    """Per group: median of positive anchor values over ``per_unit``, else the median of the others, else null."""
    x = F.col(value)
    return rows.groupBy(*keys).agg(
        F.coalesce(F.median(F.when(anchor & (x > 0), x)) / per_unit, F.median(F.when(~anchor, x))).alias("unit"),
        F.count_if(anchor & (x > 0)).alias("n_anchor"),
    )


def verdict(content_ok: Column, any_warn: Column) -> Column:
    """red if the word itself is wrong, yellow if a rule on it is, else green."""
    return F.when(~content_ok, "red").when(any_warn, "yellow").otherwise("green")
