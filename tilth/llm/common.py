"""Shared plumbing: tables in the cluster's shared folder, key ranges, connected components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session may go without ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tilth-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python workers in Arrow batches of at most 1,000 rows and about 8 MB from here on in this session.

    Plans read these settings when they run, so they stay set; lower values of the caller's own are kept.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        if not 0 < int(re.sub(r"[^0-9-]", "", spark.conf.get(key))) <= most:
            spark.conf.set(key, str(most))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_ranges(df: DataFrame, key: str, bytes_col: str, part_bytes: int) -> list[int]:
    """Upper-exclusive split points that cut ``df`` into ranges of ``key`` of about ``part_bytes`` each.

    At least one range per shuffle partition. Only the split points (their number is total bytes over
    ``part_bytes``, at most 10,000) reach the driver. Null keys belong to the first range.
    """
    grid = 10_000
    row = df.agg(
        F.sum(F.octet_length(bytes_col)).alias("size"),
        F.percentile_approx(key, [i / grid for i in range(1, grid)], 5 * grid).alias("cuts"),
    ).first()
    if not row["cuts"]:
        return []
    n = min(grid, max(shuffle_width(df.sparkSession), (row["size"] or 0) // part_bytes + 1))
    return sorted({row["cuts"][min(grid - 2, i * grid // n)] for i in range(1, n)})


def range_of(key: str, cuts: list[int]):
    """Column: index of the range that ``key`` falls in, given sorted split points; 0 for null.

    A binary search spelled out over every 64th split point, then a count among the 64 after it.
    """

    def pick(marks: list[int], lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) < F.lit(marks[mid]), pick(marks, lo, mid)).otherwise(pick(marks, mid + 1, hi))

    if len(cuts) <= 256:
        return F.when(F.col(key).isNull(), F.lit(0)).otherwise(pick(cuts, 0, len(cuts)))
    coarse, block = cuts[63::64], F.array(*[F.lit(c) for c in cuts])
    first = pick(coarse, 0, len(coarse)) * 64
    near = F.size(F.filter(F.slice(block, first + 1, F.lit(64)), lambda c: c <= F.col(key)))
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(first + near)


def task_of(spark: SparkSession, part: str, n: int):
    """Column: a number for ``part`` (0 to n - 1) that ``repartition(n, number)`` puts in a task of its own.

    Range numbers themselves are hashed to tasks, several to one task and none to another. Here each task
    has the smallest integer that hashes to it. Only ``n`` numbers (ranges, at most 10,000) reach the driver.
    """
    numbers = spark.range(n * 32).select(F.col("id").cast("int").alias("number"))
    rows = numbers.groupBy(F.pmod(F.hash("number"), F.lit(n)).alias("task")).agg(F.min("number").alias("number")).collect()
    of = {r["task"]: r["number"] for r in rows}
    if len(of) < n:  # a task that nothing hashes to: e ** -32 each
        return F.col(part)
    return F.get(F.array(*[F.lit(of[task]) for task in range(n)]), F.col(part))


def splittable(df: DataFrame, key: str) -> DataFrame:
    """``df``, grouped by ``key`` just before, as a join side with a shuffle of its own.

    Joined straight after the grouping it would share the grouping's shuffle, and the adaptive
    planner splits hot keys of a join only if each side comes out of a shuffle made for the join.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast(df.schema[key].dataType)))


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """Edges (a, b), any direction, self loops allowed -> (node, component): the smallest node reachable.

    Alternating large-star and small-star contraction. Each round is written to the shared folder;
    minima are pre-aggregated, so a node of any degree costs one row per map task, and the joins
    on it can be split by the adaptive skew join.
    """

    def minima(df: DataFrame) -> DataFrame:
        return splittable(df.groupBy("u").agg(F.min("v").alias("m")), "u")

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = minima(both).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            low.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))
        )

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = minima(down)
        return down.join(low, "u").where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )

    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = edges.select("a", "b").where("a <> b")
    now = materialize(small_star(large_star(edges)).distinct(), label)
    seen = mark(now)
    while seen[0]:
        now = materialize(small_star(large_star(now)).distinct(), label)
        after = mark(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
