"""Token ids in binary shards with constant-time keyed access.

A store is a folder. ``shard-NNNNN.bin`` holds the ids of a range of documents, one document after
another in ascending doc_id order, as little-endian unsigned integers of 2 or 4 bytes (whichever the
vocabulary needs). ``shard-NNNNN.idx`` is a minimal perfect hash over the shard's keys with, per key,
a fingerprint, the place of its first id and how many ids there are. A key is (doc_id, nth row with
that doc_id); a null doc_id sorts first. Shards are written and renamed by the tasks that hold their
documents, so a task run twice leaves one whole file.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilth.llm.common import bounded_batches, key_ranges, new_path, range_of, task_of
from tilth.llm.perfect_hash import PerfectHash, mix
from tilth.llm.word_tokens import encoder, text_blocks

MAGIC = b"TOKIDX01"
HEAD = struct.Struct("<8sBQQ")  # magic, bytes per id, keys, levels


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def keys_of(doc_ids: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """64-bit keys; the first row of a document that isn't null is its id alone."""
    base = np.where(null, np.uint64(0x6E756C6C), np.uint64(0)) ^ doc_ids.astype(np.int64).view(np.uint64)
    return np.where((nth == 0) & ~null, base, mix(base ^ mix(nth.astype(np.uint64), 7), 11))


def pack_index(width: int, keys: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> bytes:
    table = PerfectHash.build(keys)
    slot = table.lookup(keys)
    prints, at, n = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u8")
    prints[slot], at[slot], n[slot] = mix(keys, 101) >> np.uint64(32), starts, counts
    return HEAD.pack(MAGIC, width, len(keys), len(table.sizes)) + table.sizes.astype("<i8").tobytes() + prints.tobytes() + at.tobytes() + n.tobytes() + table.bits.tobytes()


class ShardReader:
    """Keyed access to one shard: a few bit tests, one fingerprint, one read."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        with fs.open_input_file(path + ".idx") as f:
            raw = f.read()
        magic, self.width, n, levels = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError(f"{path}.idx is not an index of a token shard")
        cut = HEAD.size
        sizes = np.frombuffer(raw, "<i8", levels, cut)
        cut += 8 * levels
        self.prints = np.frombuffer(raw, "<u4", n, cut)
        self.starts = np.frombuffer(raw, "<u8", n, cut + 4 * n)
        self.counts = np.frombuffer(raw, "<u8", n, cut + 12 * n)
        self.table = PerfectHash(sizes, np.frombuffer(raw, np.uint8, offset=cut + 20 * n))
        self.data = fs.open_input_file(path + ".bin")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, start, count) of each key; a key that isn't in the shard fails its fingerprint."""
        slot = self.table.lookup(keys)
        if not len(self.prints):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = np.maximum(slot, 0)
        ok = (slot >= 0) & (self.prints[at] == (mix(keys, 101) >> np.uint64(32)))
        return ok, self.starts[at].astype(np.int64), self.counts[at].astype(np.int64)

    def ids(self, start: int, count: int) -> np.ndarray:
        raw = self.data.read_at(count * self.width, start * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")

    def close(self) -> None:
        self.data.close()


MANIFEST = T.StructType(
    [T.StructField("shard", T.IntegerType()), T.StructField("documents", T.LongType()), T.StructField("ids", T.LongType())]
)


def write_store(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None, shard_bytes: int = 32 << 20) -> tuple[str, list[int], DataFrame]:
    """Encode ``docs`` (doc_id, text, ...) and write a store; -> (folder, split points, manifest).

    A null text is empty. Rows with one doc_id (repeated rows) are told apart by their text's order.
    The manifest has a row per shard: documents, ids, and ``base``, the ids of all shards before it.
    Empty input: no shards. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = key_ranges(rows, "doc_id", "text", shard_bytes)
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    fs, local = file_system(path)
    fs.create_dir(local, recursive=True)
    end = int(end_id).to_bytes(4, "little")

    def write(batches):
        import pyarrow as pa

        encode = encoder(vocabulary).encode
        fs, folder = file_system(path)
        state = {"shard": None}

        def close():
            if state["shard"] is None:
                return []
            state["file"].close()
            name = f"{folder}/shard-{state['shard']:05d}"
            ids = np.array([i or 0 for i in state["ids"]], dtype=np.int64)
            null = np.array([i is None for i in state["ids"]], dtype=bool)
            counts = np.array(state["counts"], dtype=np.int64)
            starts = np.cumsum(counts) - counts
            with fs.open_output_stream(state["tmp"] + ".idx") as f:
                f.write(pack_index(width, keys_of(ids, null, np.array(state["nth"])), starts, counts))
            for kind in (".bin", ".idx"):
                if fs.get_file_info(name + kind).is_file:  # of an earlier attempt at this task
                    fs.delete_file(name + kind)
                fs.move(state["tmp"] + kind, name + kind)
            row = [[state["shard"]], [len(counts)], [int(counts.sum())]]
            return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int64(), pa.int64()), strict=True)], MANIFEST.names)]

        for batch in batches:
            shards, keys, texts = (batch.column(i).to_pylist() for i in range(3))
            for a, b in text_blocks(texts):
                for shard, key, ids in zip(shards[a:b], keys[a:b], encode(texts[a:b]), strict=True):
                    if shard != state["shard"]:
                        yield from close()
                        state = {"shard": shard, "ids": [], "nth": [], "counts": [], "tmp": f"{folder}/_{uuid.uuid4().hex}"}
                        state["file"] = fs.open_output_stream(state["tmp"] + ".bin")
                    raw = ids + end
                    state["file"].write(np.frombuffer(raw, "<u4").astype("<u2").tobytes() if width == 2 else raw)
                    same = state["ids"] and state["ids"][-1] == key
                    state["nth"].append(state["nth"][-1] + 1 if same else 0)
                    state["ids"].append(key)
                    state["counts"].append(len(raw) // 4)
        yield from close()

    manifest = (
        rows.withColumn("shard", range_of("doc_id", cuts).cast("int"))
        .select("shard", "doc_id", "text")
        .repartition(len(cuts) + 1, task_of(spark, "shard", len(cuts) + 1))
        .sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(write, MANIFEST)
        .toPandas()
        .sort_values("shard")
    )
    manifest["base"] = manifest["ids"].cumsum() - manifest["ids"]
    schema = T.StructType([*MANIFEST.fields, T.StructField("base", T.LongType())])
    return path, cuts, spark.createDataFrame(manifest.astype("int64").itertuples(index=False, name=None) if len(manifest) else [], schema)


READ = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def read_store(keys: DataFrame, path: str, cuts: list[int], manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Look up documents by key in a store: one row per row of ``keys`` (doc_id, ...) that it holds.

    ``start`` counts the ids of all documents before it. A doc_id that stands n times in ``keys``
    reads the first n rows stored under it; one that isn't in the store gives no row.
    """
    bounded_batches(keys.sparkSession)
    schema = T.StructType([*READ.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    bases = {r["shard"]: r["base"] for r in manifest.select("shard", "base").collect()}  # one row per shard

    def read(batches):
        import pyarrow as pa

        reader, current = None, None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            doc_ids, null = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False), batch.column(1).is_null().to_numpy(zero_copy_only=False)
            keys = keys_of(doc_ids, null, batch.column(2).to_numpy())
            for shard in dict.fromkeys(shards.tolist()):
                if shard not in bases:
                    continue
                if shard != current:
                    if reader:
                        reader.close()
                    reader, current = ShardReader(f"{path}/shard-{shard:05d}"), shard
                pick = np.flatnonzero(shards == shard)
                ok, starts, counts = reader.find(keys[pick])
                pick, starts, counts = pick[ok], starts[ok], counts[ok]
                for lo in range(0, len(pick), 2000):
                    some = slice(lo, lo + 2000)
                    raws = [reader.ids(s, n).tobytes() for s, n in zip(starts[some].tolist(), counts[some].tolist(), strict=True)]
                    columns = [
                        pa.array(doc_ids[pick[some]], pa.int64(), mask=null[pick[some]]),
                        pa.array(starts[some] + bases[shard], pa.int64()),
                        pa.array(counts[some], pa.int64()),
                        pa.array([zlib.crc32(r) for r in raws], pa.int64()),
                        pa.array(raws, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns[: len(schema)], schema.names)
        if reader:
            reader.close()

    wanted = (
        keys.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(range_of("doc_id", cuts).cast("int").alias("shard"), "doc_id", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("nth"))
    )
    return wanted.repartition(len(cuts) + 1, task_of(keys.sparkSession, "shard", len(cuts) + 1)).sortWithinPartitions("shard", "doc_id", "nth").mapInArrow(read, schema)


def store_documents(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write ``docs`` to a new store, then read every document back from its files by key."""
    path, cuts, manifest = write_store(docs, vocabulary, end_id)
    return read_store(docs, path, cuts, manifest)
