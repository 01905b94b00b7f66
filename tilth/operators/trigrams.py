"""Substring search through an index of trigrams.

``rows`` are the texts, in blocks by a hash of their key, a folder each, with a number in the block. ``postings`` lists
for each trigram of the lower-cased texts the rows that have it, in chunks, sorted by trigram so that a
query reads only the row groups of its own. A task makes the lists of the blocks it reads, so only lists
are shuffled, with two bytes a row. A query takes the rarest of its trigrams, keeps the rows that have all of them, reads the blocks those are in,
and checks the texts themselves.
"""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilth.functions import text

#: Rows of a block of texts, on average.
BLOCK_ROWS = 2_000
#: Blocks whose lists go to one task to be sorted.
TASK_BLOCKS = 8
#: Rows and characters of a chunk of a block, whose lists are made at once; rows are numbered with 15 bits.
CHUNK_ROWS, CHUNK_CHARS = 30_000, 4_000_000
#: Trigrams of a query that are looked up, the rarest.
RAREST = 4


def trigrams(column: Column) -> Column:
    """Distinct trigrams of a lower-cased text in one pass over it; none under three characters, null for null."""
    return F.array_distinct(F.regexp_extract_all(F.lower(column), F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram, place of a text that has it), distinct and sorted; a trigram is its three code points with 21 bits each."""
    lengths = np.array([len(t or "") for t in texts], np.int64)
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), "<u4").astype(np.int64)
    of = np.repeat(np.arange(len(texts)), lengths)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, of, inside = points[:-2] << 42 | points[1:-1] << 21 | points[2:], of[:-2], of[:-2] == of[2:]
    grams, of = grams[inside], of[inside]
    order = np.argsort(grams, kind="stable")  # texts stay in order
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[new], of[new]


def _lists(batches, chunk_rows: int):
    """Rows (block, row, lower-cased texts ...) -> gram, _block, part, n, found: ``found`` counts rows from ``part``."""
    import pyarrow as pa

    names = ["gram", "_block", "part", "n", "found"]

    def chunk(block: int, part: int, held: list[tuple]):
        each = [grams_of(list(texts)) for texts in zip(*held, strict=True)]
        grams, rows = (np.concatenate(c) for c in zip(*each, strict=True))
        if len(each) > 1:
            order = np.lexsort((rows, grams))
            grams, rows = grams[order], rows[order]
            new = np.ones(len(grams), bool)
            new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
            grams, rows = grams[new], rows[new]
        starts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
        points = np.stack([grams[starts] >> 42, grams[starts] >> 21 & 0x1FFFFF, grams[starts] & 0x1FFFFF], axis=1).astype("<u4")
        spelt = points.tobytes().decode("utf-32-le")
        ends = np.append(starts, len(grams)).astype(np.int32)
        found = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.astype(np.int16)))
        n = len(starts)
        cols = [pa.array([spelt[i : i + 3] for i in range(0, 3 * n, 3)], pa.string()), pa.array(np.full(n, block, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(np.diff(ends)), found]
        return pa.RecordBatch.from_arrays(cols, names)

    block, part, held, chars = None, 0, [], 0
    for batch in batches:
        for at, row, *texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (at != block or row != part + len(held) or len(held) >= chunk_rows or chars >= CHUNK_CHARS):
                yield chunk(block, part, held)
                held = []
            if not held:
                block, part, chars = at, row, 0
            held.append(tuple(texts))
            chars += sum(len(t) for t in texts if t)
    if held:
        yield chunk(block, part, held)


def build(rows: DataFrame, keys: list[str], columns: list[str], path: str) -> None:
    """Write the index of the text ``columns`` of ``rows`` below ``path``, with all columns of the rows. Rows need no unique key; null texts have no trigrams."""
    spark = rows.sparkSession
    n = max(1, -(-rows.count() // BLOCK_ROWS))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")).repartition(max(1, min(n, 16 * width)), "_block")
    numbered = placed.withColumn("_row", F.row_number().over(Window.partitionBy("_block").orderBy(F.xxhash64(*keys))) - 1)
    numbered.write.partitionBy("_block").parquet(f"{path}/rows")
    texts = spark.read.parquet(f"{path}/rows").select(F.col("_block").cast("int"), "_row", *[F.lower(c) for c in columns])
    lists = texts.toDF("_block", "_row", *map(str, range(len(columns)))).mapInArrow(partial(_lists, chunk_rows=CHUNK_ROWS), "gram string, _block int, part int, n int, found array<smallint>")
    order = ["gram", "_block", "part"]
    lists.repartitionByRange(max(width, -(-n // TASK_BLOCKS)), *order).sortWithinPartitions(*order).write.option("parquet.block.size", 1 << 20).parquet(f"{path}/postings")


def search(spark: SparkSession, path: str, keys: list[str], columns: list[str], query: str, extra: Column | None = None) -> DataFrame:
    """Rows of the index one of whose ``columns`` holds ``query``, without case; percent signs and underscores are themselves.

    ``extra`` is a condition that rows must meet besides. Queries under three characters have no trigram and read all rows.
    """
    rows, low = spark.read.parquet(f"{path}/rows"), query.lower()
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{escaped(query)}%"), F.lit(False)) for c in columns])
    if extra is not None:
        hit &= extra
    wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if wanted:
        postings = spark.read.parquet(f"{path}/postings").where(F.col("gram").isin(*wanted))
        sizes = {r["gram"]: r["n"] for r in postings.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # as many as the query has
        if len(sizes) < len(wanted):
            return rows.limit(0).drop("_block", "_row")
        rarest = sorted(wanted, key=lambda g: (sizes[g], g))[:RAREST]
        have = postings.where(F.col("gram").isin(*rarest)).groupBy("_block", "part").agg(F.collect_list("found").alias("f"), F.count(F.lit(1)).alias("c")).where(F.col("c") == len(rarest))
        common = F.aggregate("f", F.get("f", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        found = have.select("_block", "part", F.explode(common).alias("at")).select(F.col("_block").alias("_of"), (F.col("part") + F.col("at")).alias("_at"))
        blocks = [r[0] for r in found.select("_of").distinct().collect()]  # numbers of blocks, for pruning
        rows = rows.where(F.col("_block").isin(*blocks)) if blocks else rows.limit(0)
        rows = rows.join(found, (F.col("_row") == F.col("_at")) & (F.col("_block") == F.col("_of")), "left_semi")
    return rows.where(hit).drop("_block", "_row")


def escaped(query: str) -> str:
    """The query as a pattern that matches itself."""
    return "".join("\\" + c if c in "\\%_" else c for c in query)


def search_verses(spark: SparkSession, path: str, query: str, limit: int = 50) -> DataFrame:
    """As ``lookup.search_verses`` over an index of text_normalized, translation and transliteration by (surah, ayah)."""
    q = query.strip()
    keys = ["surah", "ayah"]
    every = ["text_normalized", "translation", "transliteration"]
    if len(q) < 2:
        return spark.read.parquet(f"{path}/rows").drop("_block", "_row").limit(0)
    arabic, plain = spark.range(1).select(text.is_arabic(F.lit(q)), text.normalize(F.lit(q))).first()
    columns = every[:1] if arabic else every[1:]
    return search(spark, path, keys, columns, plain if arabic else q).orderBy(*keys).limit(limit)
