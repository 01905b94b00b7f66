"""Joins and windows on intervals, positions and order. All carry an equi key beside the range predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_span: tuple[str, str], b_span: tuple[str, str], bin_width: int | None = None) -> DataFrame:
    """Pairs of half-open intervals of a key that share a point: a.start < b.end and a.end > b.start.

    ``bin_width`` cuts the axis, so that a key with very many intervals is spread over many tasks; a
    pair is kept in the bin where the later of the two starts. Column names other than keys must differ.
    """
    (a0, a1), (b0, b1) = a_span, b_span
    meet = (F.col(a0) < F.col(b1)) & (F.col(a1) > F.col(b0))
    if bin_width is None:
        return a.join(b, keys).where(meet)
    cut = lambda c: F.floor(c / bin_width)
    spread = lambda df, s, e: df.where(F.col(e) > F.col(s)).withColumn("_bin", F.explode(F.sequence(cut(F.col(s)), cut(F.col(e) - 1))))
    joined = spread(a, a0, a1).join(spread(b, b0, b1), [*keys, "_bin"]).where(meet)
    return joined.where(F.col("_bin") == F.greatest(cut(F.col(a0)), cut(F.col(b0)))).drop("_bin")


def contained_join(inner: DataFrame, outer: DataFrame, keys: list[str], inner_span: tuple[str, str], outer_span: tuple[str, str]) -> DataFrame:
    """Pairs where the inner interval lies wholly within the outer one."""
    return inner.join(outer, keys).where((F.col(inner_span[0]) >= F.col(outer_span[0])) & (F.col(inner_span[1]) <= F.col(outer_span[1])))


def point_join(points: DataFrame, spans: DataFrame, keys: list[str], point: str, span: tuple[str, str], first_by: str, point_id: list[str]) -> DataFrame:
    """Each point with the first span (by ``first_by``) that holds it, null columns if none does."""
    extra = [c for c in spans.columns if c not in keys]
    hit = points.join(spans, keys).where((F.col(span[0]) <= F.col(point)) & (F.col(point) < F.col(span[1])))
    best = hit.groupBy(*keys, *point_id).agg(F.min(F.struct(first_by, *[c for c in extra if c != first_by])).alias("_s"))
    return points.join(best, [*keys, *point_id], "left").select(*points.columns, *[F.col("_s")[c].alias(c) for c in extra])


def lexicographic_between(columns: list[Column], low: list, high: list) -> Column:
    """low <= columns <= high in dictionary order; spelled out, so that the first column's bounds reach the scan."""

    def beyond(at: list[Column], mark: list, strict) -> Column:
        (c, *more), (m, *rest) = at, mark
        return strict(c, m) | ((c == m) & beyond(more, rest, strict)) if more else strict(c, m) | (c == m)

    first = columns[0].between(low[0], high[0])
    return first & beyond(columns, low, lambda c, m: c > m) & beyond(columns, high, lambda c, m: c < m)


def lexicographic_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed ranges of tuples share a value."""
    return ~(a_end < b_start) & ~(a_start > b_end)


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, block: Column, inclusive: bool = True) -> DataFrame:
    """Last non-null ``value`` at or before each row of its key (strictly before if not inclusive).

    ``block`` must not fall along ``order``. Rows are windowed per key and block, and only one value
    per block is carried from block to block, so a hot key isn't sorted in one task.
    """
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    local = rows.withColumn("_block", block).withColumn("_here", F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)))
    at = F.struct(*order)
    ends = rows.withColumn("_block", block).groupBy(*keys, "_block").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(at.alias("at"), F.col(value).alias("v"))))["v"].alias("_end"))
    across = Window.partitionBy(*keys).orderBy("_block")
    before = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    joined = local.join(before, [*keys, "_block"])
    return joined.withColumn(out, F.coalesce("_here", "_before")).drop("_here", "_before", "_block")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, value: str, out: str, block: Column) -> DataFrame:
    """Each left row with ``value`` of the last right row of its key at or before its ``ts``; null if none."""
    columns = [c for c in left.columns if c not in keys and c != ts]
    l = left.select(*keys, ts, F.lit(1).alias("_side"), F.struct(*columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    r = right.select(*keys, ts, F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    both = carry_forward(l.unionByName(r), keys, [ts, "_side"], "_value", out, block)
    return both.where("_side = 1").select(*keys, ts, *[F.col("_row")[c].alias(c) for c in columns], out)


FIRST_BLOCK = -(1 << 62)


def _in_blocks(rows: DataFrame, block: Column) -> DataFrame:
    """``rows`` with ``_block``; a null block is the first, as null comes first in order."""
    return rows.withColumn("_block", F.coalesce(block.cast("long"), F.lit(FIRST_BLOCK)))


def islands(rows: DataFrame, keys: list[str], order: list[str], state: str, block: Column) -> DataFrame:
    """Runs of equal ``state`` in order: keys, run (from 1), state, n, first and last order value.

    ``block`` must not fall along ``order``. Changes are found and counted per key and block; blocks hand on their last
    state and their number of changes, so a key with very many rows is many tasks.
    """
    blocked = _in_blocks(rows, block)
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    change = (~F.col(state).eqNullSafe(F.lag(state).over(w)) & F.lag(F.lit(1)).over(w).isNotNull()).cast("int")
    marked = blocked.withColumn("_change", change).withColumn("_at", F.struct(*order))
    inner = marked.withColumn("_here", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy(*keys, "_block").agg(F.sum("_change").alias("_n"), F.min(F.struct("_at", F.col(state).alias("s"))).alias("_head"), F.max(F.struct("_at", F.col(state).alias("s"))).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_block")
    before = F.lag("_tail").over(across)
    ends = ends.withColumn("_new", (before.isNull() | ~F.col("_head.s").eqNullSafe(before["s"])).cast("int"))
    ends = ends.withColumn("_before", F.sum(F.col("_new") + F.col("_n")).over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).select(*keys, "_block", "_before")
    numbered = _null_safe(inner, ends, [*keys, "_block"]).withColumn("run", F.col("_before") + F.col("_here"))
    return numbered.groupBy(*keys, "run", state).agg(F.count(F.lit(1)).alias("n"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def _null_safe(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null, with the columns of ``rows`` and the others of ``side``."""
    other = side.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in side.columns if c not in keys])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(other, same).drop(*[f"_k{i}" for i in range(len(keys))])


def running_offsets(rows: DataFrame, keys: list[str], order: list[str], length: Column, block: Column, gap: int = 1) -> DataFrame:
    """start and end of each row's text in the concatenation of its key's texts, ``gap`` characters between.

    ``block`` must not fall along ``order``. Lengths are added up within blocks of a key, and one sum per block is handed on. A null length counts as 0, its end is null.
    """
    out = _in_blocks(rows.withColumn("_len", length), block)
    size = F.coalesce(F.col("_len"), F.lit(0)) + gap
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = out.groupBy(*keys, "_block").agg(F.sum(size).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(across), F.lit(0))).drop("_sum")
    local = out.withColumn("_here", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    joined = _null_safe(local, sums, [*keys, "_block"]).withColumn("start", (F.col("_before") + F.col("_here")).cast("long"))
    return joined.withColumn("end", F.col("start") + F.col("_len")).drop("_len", "_block", "_before", "_here")


def onset_spans(frames: DataFrame, keys: list[str], order: list[str], label: str, blank, at: str, end: str, block: Column) -> DataFrame:
    """Onsets of labels: not blank and not the one before; each lasts to the next onset, the last to ``end``.

    ``block`` must not fall along ``order``. Blocks hand on their last label forward and their first onset backward.
    """
    blocked = _in_blocks(frames, block).withColumn("_at", F.struct(*order))
    w, across = Window.partitionBy(*keys, "_block").orderBy(*order), Window.partitionBy(*keys).orderBy("_block")
    tails = blocked.groupBy(*keys, "_block").agg(F.max(F.struct("_at", F.col(label).alias("s"))).alias("_tail"))
    tails = tails.withColumn("_last", F.lag("_tail").over(across)["s"]).drop("_tail")
    place = F.row_number().over(w)
    seen = _null_safe(blocked.withColumn("_label", F.lag(label).over(w)).withColumn("_place", place), tails, [*keys, "_block"])
    before = F.when(F.col("_place") == 1, F.col("_last")).otherwise(F.col("_label"))
    on = seen.withColumn("_before", before).where((F.col(label) != F.lit(blank)) & ~F.col(label).eqNullSafe(F.col("_before"))).drop("_before", "_label", "_last", "_place")
    heads = on.groupBy(*keys, "_block").agg(F.min(F.struct("_at", F.col(at).alias("v"))).alias("_head"))
    heads = heads.withColumn("_next", F.lead("_head").over(across)["v"]).drop("_head")
    joined = _null_safe(on.withColumn("_lead", F.lead(at).over(w)), heads, [*keys, "_block"])
    return joined.withColumn("span_end", F.coalesce("_lead", "_next", end)).drop("_lead", "_next", "_block", "_at")


def confirmed_prefix(parts: DataFrame, keys: list[str], order: str, ratio: str, confirm: float, resume: float) -> DataFrame:
    """Per key: n_confirmed, the length of the leading run with ratio >= confirm, and where to resume after the last qualifying part past it, else null."""
    w = Window.partitionBy(*keys).orderBy(order)
    ok = (F.col(ratio) >= confirm).cast("int")
    led = parts.withColumn("_led", F.min(ok).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    return led.groupBy(*keys).agg(
        F.count_if("_led").alias("n_confirmed"),
        (F.max(F.when(~F.col("_led") & (F.col(ratio) >= resume), F.col(order))) + 1).alias("resume_at"),
    )


def next_boundary(rows: DataFrame, keys: list[str], order: list[str], start: str) -> DataFrame:
    """Each row with the start of the next one in its key (null at the end)."""
    return rows.withColumn("next_start", F.lead(start).over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_group(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows per group in ``order`` (a full order)."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")
