"""Locating a decoded clip among the verses of a passage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tilth.functions.alignment import fit_udf, most_shared
from tilth.sources import shared

#: Clips and runs of a passage that are scored at once.
CLIPS, RUNS = 256, 2048


def _best_runs(clips, runs, top_k: int, short: int):
    """Rows of a cell's ``clips`` with each of the ``top_k`` runs by score; short clips with all."""
    import pyarrow as pa

    runs = runs.sort_by([("i", "ascending"), ("j", "ascending")])
    decoded = clips["decoded"].to_pylist()
    caps = [int(len(d) * 1.3) + 5 for d in decoded]
    shares = most_shared(decoded, caps, runs["head"].to_pylist(), runs["tail"].to_pylist())
    pairs = np.array([len({d[k : k + 2] for k in range(max(1, len(d) - 1))}) for d in decoded])
    most = np.maximum(np.maximum(pairs[:, None], np.minimum(runs["n"].to_numpy()[None, :], np.array(caps)[:, None])), 1)
    scores = shares / most
    order = np.argsort(-scores, axis=1, kind="stable")
    which = [o if len(d) < short else o[:top_k] for o, d in zip(order, decoded, strict=True)]
    row, run = np.repeat(np.arange(len(decoded)), [len(w) for w in which]), np.concatenate(which)
    own, ends = clips.drop_columns(["_c", "_r"]).take(row), runs.select(["i", "j", "head", "tail"]).take(run)
    return pa.table([*own.columns, *ends.columns, pa.array(scores[row, run])], [*own.column_names, *ends.column_names, "score"])


def locate(clips: DataFrame, verses: DataFrame, passage: list[str], max_span: int = 6, top_k: int = 6, threshold: float = 0.75, tie: float = 0.05, short: int = 12) -> DataFrame:
    """Best run of verses for each clip.

    ``clips``: passage keys, clip, near (may be null), decoded (letters only). ``verses``: passage
    keys, pos (dense), letters. Runs of up to ``max_span`` verses are candidates; clips of ``short``
    letters and more keep the ``top_k`` by shared bigrams with the run's head or tail. A run fits by
    the edit distance to its best prefix or suffix; one that holds a narrower run fitting as well is
    dropped. Without a hint the best fit wins, then the earlier, then the shorter run; with one the
    run nearest to it among those within ``tie`` of the best. No row for clips over ``threshold``.
    """
    a = verses.select(*passage, F.col("pos").alias("i"))
    b = verses.select(*passage, F.col("pos").alias("j"), "letters")
    runs = a.join(b, passage).where((F.col("j") >= F.col("i")) & (F.col("j") < F.col("i") + max_span))
    up = Window.partitionBy(*passage, "i").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumn("run", F.array_join(F.collect_list("letters").over(up), "")).drop("letters")
    width = int(clips.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spoken = clips.where(F.length("decoded") > 0).select(*passage, "clip", "near", "decoded")
    # scores and fits look at no more of a run than its ends, so only these travel
    sizes = spoken.groupBy(*passage).agg(F.max(F.length("decoded")).alias("longest"), F.ceil(F.count(F.lit(1)) / CLIPS).cast("int").alias("_kc"))
    reach = F.greatest(2 * F.col("longest"), (F.floor(F.col("longest") * 1.3) + 5).cast("int"))
    ends = runs.join(sizes, passage).select(*passage, "i", "j", F.length("run").alias("n"), F.left("run", reach).alias("head"), F.right("run", reach).alias("tail"), "_kc")
    parts = ends.groupBy(*passage).agg(F.ceil(F.count(F.lit(1)) / RUNS).cast("int").alias("_kr"))

    def dealt(df: DataFrame, own: str, other: str, k: str, others: str, *by: str) -> DataFrame:
        block = df.withColumn(own, F.pmod(F.xxhash64(*by), F.col(k)).cast("int"))
        return block.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("_kc", "_kr")

    cell = [*passage, "_c", "_r"]
    left = dealt(spoken.join(sizes.drop("longest"), passage).join(parts, passage), "_c", "_r", "_kc", "_kr", "clip", "decoded")
    right = dealt(ends.join(parts, passage), "_r", "_c", "_kr", "_kc", "i", "j")
    fields = [*spoken.schema.fields, *(right.schema[c] for c in ("i", "j", "head", "tail")), T.StructField("score", T.DoubleType())]

    def best_runs(a, b):
        return _best_runs(a.select([*names, "_c", "_r"]), b, top_k, short) if a.num_rows and b.num_rows else nothing(a, b)

    def nothing(a, b):
        import pyarrow as pa

        both = [a.schema.field(c) for c in names] + [b.schema.field(c) for c in ("i", "j", "head", "tail")]
        return pa.schema([*both, pa.field("score", pa.float64())]).empty_table()

    names = spoken.columns
    left, right = (df.toDF(*df.columns) for df in (left, right))  # columns of their own
    scored = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(best_runs, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))
    best = Window.partitionBy(*passage, "clip").orderBy(F.desc("score"), "i", "j")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where((F.length("decoded") < short) | (F.col("rank") <= top_k))
    # few rows, much work on each: spread them, or the adaptive planner puts them into one task
    fitted = ranked.repartition(width, *passage, "clip", "i", "j").withColumn("cer", fit_udf("decoded", "head", "tail"))
    path = shared.new_path(clips.sparkSession, "fits")
    fitted.select(*passage, "clip", "near", "i", "j", "cer").write.parquet(path)  # read by three joins
    fits = clips.sparkSession.read.parquet(path)
    narrow = fits.select(*passage, "clip", F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("cer").alias("cer2"))
    keys = [*passage, "clip"]
    inside = (F.col("cer2") <= F.col("cer") + 1e-9) & (F.col("i2") >= F.col("i")) & (F.col("j2") <= F.col("j")) & (F.col("j2") - F.col("i2") < F.col("j") - F.col("i"))
    beaten = fits.join(narrow, keys).where(inside).select(*keys, "i", "j").distinct()
    rest = fits.join(beaten, [*keys, "i", "j"], "left_anti")
    low = rest.withColumn("low", F.min("cer").over(Window.partitionBy(*keys))).where(F.col("low") <= threshold)
    near = F.when(F.col("near").isNull(), F.lit(0)).otherwise(F.abs(F.col("i") - F.col("near")))
    ties = low.where(F.when(F.col("near").isNull(), F.col("cer") == F.col("low")).otherwise(F.col("cer") <= F.col("low") + tie))
    return ties.groupBy(*keys).agg(F.min(F.struct(near.alias("d"), "cer", "i", "j")).alias("b")).select(*keys, F.col("b.i").alias("from"), F.col("b.j").alias("to"), F.col("b.cer").alias("cer"))
