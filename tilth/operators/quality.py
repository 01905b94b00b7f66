"""Audit and repair: coverage, integrity, duplicates, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def missing_and_extra(canonical: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with ``side`` missing or extra."""
    a, b = canonical.select(*keys).distinct(), present.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("extra")))


def coverage(groups: DataFrame, items: DataFrame, present: DataFrame, group: list[str], item: list[str]) -> DataFrame:
    """Missing and present items per group, groups with nothing missing or nothing present included.

    ``groups`` and ``items`` are dimensions; counts are taken per group, so their product isn't built.
    """
    have = present.select(*group, *item).distinct().join(items.select(*item).distinct(), item, "left_semi").groupBy(*group).agg(F.count(F.lit(1)).alias("n_present"))
    every = items.select(*item).distinct().agg(F.count(F.lit(1)).alias("n_items"))
    out = groups.select(*group).distinct().join(have, group, "left").crossJoin(F.broadcast(every))  # one row
    n = F.coalesce("n_present", F.lit(0)).cast("long")
    return out.select(*group, n.alias("n_present"), (F.col("n_items") - n).alias("n_missing"))


def integrity(length: Column, duration: Column, readable: Column, least_bytes: int) -> Column:
    """Status ladder of a probed file; the first that holds."""
    return (
        F.when(length.isNull(), "missing")
        .when(length == 0, "empty")
        .when(length < least_bytes, "tiny")
        .when(~F.coalesce(readable, F.lit(False)), "unreadable")
        .when(duration.isNull(), "corrupt")
        .when(duration <= 0, "zero_duration")
        .otherwise("ok")
    )


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per key in ``order``, with ``n_duplicates``, the number of later ones.

    A minimum over structs, so copies are combined before the shuffle and a hot key is no burden.
    """
    rest = [c for c in rows.columns if c not in keys]
    names = [c for c in order if c in rest] + [c for c in rest if c not in order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*names)).alias("_best"), (F.count(F.lit(1)) - 1).alias("n_duplicates"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest], "n_duplicates")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    names = order + [c for c in rest if c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*names)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest])


def precedence(rows: DataFrame, keys: list[str], rank: str, value: str) -> DataFrame:
    """``value`` of the lowest ``rank`` per key."""
    return rows.groupBy(*keys).agg(F.min(F.struct(rank, value)).alias("_b")).select(*keys, F.col("_b")[value].alias(value))


def without(rows: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't among ``bad``."""
    return rows.join(bad.select(*keys), keys, "left_anti")


def per_group_sample(rows: DataFrame, group: list[str], rank: Column, n: int, tie: list[str]) -> DataFrame:
    """The ``n`` rows per group that a deterministic rank puts first."""
    w = Window.partitionBy(*group).orderBy("_rank", *tie)
    return rows.withColumn("_rank", rank).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rank", "_rn")


def worklist(problems: list[DataFrame]) -> DataFrame:
    """Union of problem rows with the same columns, repeated ones kept."""
    out = problems[0]
    for p in problems[1:]:
        out = out.unionByName(p)
    return out


def client_errors(rows: DataFrame, session: str, order: list[str], message: str, stack: str, context: str, most: int = 5) -> DataFrame:
    """Reported errors per session: the first of each message by its first 200 characters, at most ``most``, long fields cut."""
    first = rows.withColumn("_head", F.left(F.col(message), F.lit(200)))
    names = [*order, *[c for c in rows.columns if c not in order and c != session]]
    kept = first.groupBy(session, "_head").agg(F.min(F.struct(*names)).alias("_r")).select(session, "_r.*")
    w = Window.partitionBy(session).orderBy(*order)
    cut = {message: F.left(message, F.lit(2000)), stack: F.left(stack, F.lit(8000)), context: F.left(context, F.lit(300))}
    return kept.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn").withColumns(cut).select(rows.columns)
