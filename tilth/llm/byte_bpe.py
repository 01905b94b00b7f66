"""Byte-level BPE over a rank file: whole pre-tokens by a minimal perfect hash, the rest by merging.

Merging keeps the bytes of a pre-token as a doubly linked list and a heap of neighbouring pairs by
rank, leftmost first among equal ranks; a popped pair that no longer stands is skipped.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilth.llm.common import bounded_batches
from tilth.llm.perfect_hash import PerfectHash
from tilth.llm.word_tokens import text_blocks

#: Most pre-tokens that a worker keeps with their ids (about 170 bytes each).
KEEP = 1_000_000

_codecs: dict[tuple[str, str], "ByteBpe"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        tokens = list(ranks)
        hashes = np.array([xxhash.xxh64_intdigest(t) for t in tokens], dtype=np.uint64)
        self.table = PerfectHash.build(hashes)
        self.slot_token: list[bytes] = [b""] * len(tokens)
        self.slot_id = [0] * len(tokens)
        for token, slot in zip(tokens, self.table.lookup(hashes).tolist(), strict=True):
            self.slot_token[slot], self.slot_id[slot] = token, ranks[token]
        self.bytes_of: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.known: dict[str, bytes] = {}

    def whole(self, pretokens: list[bytes]) -> list[int]:
        """Id of each pre-token that is itself in the vocabulary, else -1."""
        if not pretokens:
            return []
        slots = self.table.lookup(np.array([xxhash.xxh64_intdigest(p) for p in pretokens], dtype=np.uint64)).tolist()
        return [self.slot_id[s] if s >= 0 and self.slot_token[s] == p else -1 for s, p in zip(slots, pretokens, strict=True)]

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token by repeated merging of the lowest-ranked pair."""
        ranks, n = self.ranks, len(raw)
        after = list(range(1, n + 1))  # where the part that begins here ends
        before = list(range(-1, n - 1))  # where the part before it begins
        heap = []
        for i in range(n - 1):
            rank = ranks.get(raw[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = after[i]
            if j >= n or after[j] != end:
                continue
            alive[j] = 0
            after[i] = end
            if end < n:
                before[end] = i
                rank = ranks.get(raw[i : after[end]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, after[end]))
            p = before[i]
            if p >= 0:
                rank = ranks.get(raw[p:end])
                if rank is not None:
                    heapq.heappush(heap, (rank, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : after[i]]])
            i = after[i]
        return out

    def _resolve(self, new: list[str]) -> dict[str, bytes]:
        raws = [p.encode() for p in new]
        found = {}
        for text, raw, i in zip(new, raws, self.whole(raws), strict=True):
            ids = [i] if i >= 0 else self.merge(raw)
            found[text] = np.array(ids, dtype="<u4").tobytes()
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: none), each match of the pattern by itself."""
        known = self.known
        cut = [self.split(t) if t else () for t in texts]
        new = set().union(*cut).difference(known)
        extra = self._resolve(list(new)) if new else {}
        room = max(0, KEEP - len(known))
        known.update(extra)
        get = known.__getitem__
        out = [np.frombuffer(b"".join(map(get, parts)), "<u4") for parts in cut]
        for part in list(extra)[room:]:
            del known[part]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; an id that is not in the vocabulary raises KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def codec(path: str, pattern: str) -> ByteBpe:
    """One codec per worker process, rank file and pattern."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, ids array<int>. A null text has no ids; other columns are ignored."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_blocks(texts):
                ids = codec(path, pattern).encode(texts[a:b])
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``tokens`` (doc_id, ids, ...) -> doc_id, text_bytes. Null ids decode to no bytes."""
    bounded_batches(tokens.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raws = [codec(path, pattern).decode(np.array(i or [], dtype=np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.binary())], ["doc_id", "text_bytes"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text_bytes binary")


DIGEST = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode each text, decode its ids, and digest both; one row per row of ``docs``.

    Null and empty texts have no ids and the digests of nothing. Repeated and null doc_ids stay rows of their own. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        import hashlib

        import pyarrow as pa

        bpe = codec(path, pattern)
        decimal = {i: b"%d" % i for i in bpe.bytes_of}.__getitem__
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in text_blocks(texts):
                n, first, second = [], [], []
                for ids in bpe.encode(texts[a:b]):
                    n.append(len(ids))
                    first.append(hashlib.sha256(b" ".join(map(decimal, ids.tolist()))).hexdigest())
                    second.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(first), pa.array(second)], DIGEST.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST)
