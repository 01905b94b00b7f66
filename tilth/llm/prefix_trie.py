"""Prefix trie of conversations, as a table of nodes.

A node is a distinct sequence of first turns. Its digest is the exclusive-or of two 64-bit hashes of
(place, turn) over the sequence, so digests are running aggregates: Spark numbers and accumulates the
turns of a conversation in ranges and carries one value from range to range, and a conversation of any
length is many tasks. Distinct digests with their counts are one aggregate, which also verifies that
all rows of a digest agree on the last turn and the prefix before it.

Sums over subtrees come from shards. Each conversation that is the smallest member of some nodes
brings them to its shard, with the digests of the nodes above them. The shard gives each digest a slot
by a minimal perfect hash, compares the digest stored in the slot with the one looked up, scatters the
nodes' own counts into flat arrays and adds them to their parents' slots, deepest first. A node above
has a slot in every shard that has descendants of it, so a very common first turn is one row per shard,
and what the shards found is summed by digest.

Nodes with a single member form chains that save nothing and end in one leaf, so only the top of each
chain is sent to a shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilth.llm.common import materialize, shuffle_width, splittable
from tilth.llm.perfect_hash import PerfectHash, mix

#: conv_ids per chunk of a node's list of ends: a chunk is built in one task, a list of any length is not.
CHUNK = 10_000
#: Rows per shard, about; one takes some 100 bytes of its task.
SHARD_ROWS = 200_000


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key (digest of role and text), chars: texts go no further than this."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), key.alias("key"), F.length(text).cast("long").alias("chars"))


def ordered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``part``, the range of (conv_id, turn, key) they fall in, and ``place`` within conversation and part, from 0."""
    n = shuffle_width(turns.sparkSession)
    ranges = turns.repartitionByRange(n, "conv_id", F.col("turn").asc_nulls_first(), "key").withColumn("part", F.spark_partition_id())
    inside = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "key")
    return ranges.withColumn("place", (F.row_number().over(inside) - 1).cast("long")).drop("turn")


def own_share(conv_id):
    """How many first turns a conversation takes from the first of its hundred."""
    return (F.crc32(conv_id.cast("string")) % 6).cast("long")


def running(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with the running exclusive-or of ``a`` and of ``b`` along ``depth`` within conv_id, carried from part to part."""
    inside = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "part").agg(F.bit_xor(a).alias("_a"), F.bit_xor(b).alias("_b"))
    carried = sums.select("conv_id", "part", F.coalesce(F.bit_xor("_a").over(before), F.lit(0)).alias("_ca"), F.coalesce(F.bit_xor("_b").over(before), F.lit(0)).alias("_cb"))
    local = rows.withColumns({a: F.bit_xor(a).over(inside), b: F.bit_xor(b).over(inside)})
    joined = local.join(carried, ["conv_id", "part"])
    return joined.withColumns({a: F.col(a).bitwiseXOR(F.col("_ca")), b: F.col(b).bitwiseXOR(F.col("_cb"))}).drop("_ca", "_cb")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prefixes, conversations): every prefix of one turn or more of every rebuilt conversation, and their lengths.

    prefixes: conv_id, depth, a, b (digest), pa, pb (digest of the prefix before), turn (hash of the last turn), chars.
    conversations: conv_id, length. Both are tables in the shared folder.
    """
    rows = materialize(ordered(materialize(turns_of(conversations), "turns")), "ordered-turns")
    sizes = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(sizes.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    first = rows.where("place < 5").join(offsets.where("skip < 5").select("conv_id", "part", "skip"), ["conv_id", "part"]).withColumn("pos", F.col("skip") + F.col("place")).where("pos < 5")
    heads = first.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "key", "chars"))), lambda x: F.struct(x["key"].alias("key"), x["chars"].alias("chars"))).alias("head"))
    host = heads.select(F.col("conv_id").alias("host"), "head")
    convs = offsets.groupBy("conv_id").agg(F.sum("n").alias("own")).withColumn("host", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", own_share(F.col("conv_id")))
    known = convs.join(host, "host", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(host.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    known = known.withColumn("taken", F.size("head").cast("long")).withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h")))
    known = materialize(known.select("conv_id", "h", "head", "taken", "length"), "rebuilt")
    spots = offsets.join(known.select("conv_id", "h", "taken"), "conv_id").select("conv_id", "part", (F.col("skip") - F.col("h")).alias("ahead"), "taken")
    own = rows.join(splittable(spots, "conv_id"), ["conv_id", "part"]).where("ahead + place >= 0")
    own = own.select("conv_id", "part", (F.col("taken") + F.col("ahead") + F.col("place") + 1).alias("depth"), "key", "chars")
    lent = known.select("conv_id", F.posexplode("head").alias("i", "t")).select("conv_id", F.lit(-1).alias("part"), (F.col("i") + 1).cast("long").alias("depth"), F.col("t.key").alias("key"), F.col("t.chars").alias("chars"))
    hashed = lent.unionByName(own).select("conv_id", "part", "depth", "chars", F.xxhash64("depth", "key").alias("g"), F.xxhash64(F.lit(7), "key", "depth").alias("k"))
    along = running(hashed.withColumns({"a": F.col("g"), "b": F.col("k")}), "a", "b")
    prefixes = along.select("conv_id", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("g")).alias("pa"), F.col("b").bitwiseXOR(F.col("k")).alias("pb"), F.col("g").alias("turn"), "chars")
    return materialize(prefixes, "prefixes"), known.select("conv_id", "length")


def node_table(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """Distinct prefixes with their members counted: a, b, pa, pb, depth, chars, n_convs, conv_id (smallest member).

    The root, if there is any conversation, has digest (0, 0) and no parent. Two prefixes with one
    digest would be told apart by their last turn, depth or parent: then the job fails.
    """
    same = F.xxhash64("depth", "pa", "pb", "turn", "chars")
    found = prefixes.groupBy("a", "b").agg(
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("depth").alias("depth"), F.min("chars").alias("chars"),
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(same).alias("_lo"), F.max(same).alias("_hi"),
    )
    clash = (F.col("_lo") != F.col("_hi")) | ((F.col("a") == 0) & (F.col("b") == 0))
    checked = found.withColumn("depth", F.when(clash, F.raise_error(F.lit("two prefixes share a digest"))).otherwise(F.col("depth"))).drop("_lo", "_hi")
    none = F.lit(None).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), none.alias("pa"), none.alias("pb"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"), "n_convs", "conv_id")
    return checked.unionByName(root)


def end_digests(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """a, b, ends_sha256: of the conv_ids that end at a node, ascending, comma-joined; nodes without any are absent.

    Ids are put together in chunks of at most ``CHUNK`` neighbouring numbers, and the chunks of a node
    pass through one hash in order, one after another: a digest of a list is sequential by nature, its memory is one chunk.
    """
    last = prefixes.join(splittable(convs.where("length > 0"), "conv_id").select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select("a", "b", "conv_id")
    none = convs.where("length = 0").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    chunks = last.unionByName(none).groupBy("a", "b", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(ids.alias("ids"))

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])
        now, state = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
                if (a, b) == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, state.hexdigest()), schema.types, strict=True)], schema=schema)

    in_order = chunks.repartition(shuffle_width(prefixes.sparkSession), "a", "b").sortWithinPartitions("a", "b", "chunk")
    return in_order.mapInArrow(run, "a long, b long, ends_sha256 string")


class NodeTable:
    """Slots 0..n-1 for distinct 128-bit digests: a minimal perfect hash of 64 bits, verified against the whole digest."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        for seed in range(64):
            keys = self.keys(a, b, seed)
            if len(np.unique(keys)) == len(keys):
                break
        else:
            raise ValueError("digests repeat")
        self.seed, self.table = seed, PerfectHash.build(keys)
        self.a, self.b = np.zeros_like(a), np.zeros_like(b)
        slots = self.table.lookup(keys)
        self.a[slots], self.b[slots] = a, b

    @staticmethod
    def keys(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
        return mix(a.view(np.uint64) ^ mix(b.view(np.uint64), 2 * seed + 1), 2 * seed)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 for digests that have none."""
        if not len(self.a):
            return np.full(len(a), -1, dtype=np.int64)
        found = self.table.lookup(self.keys(a, b, self.seed))
        at = np.maximum(found, 0)
        return np.where((found >= 0) & (self.a[at] == a) & (self.b[at] == b), found, -1)


def accumulate(a, b, pa, pb, depth, leaves, saved) -> tuple[np.ndarray, ...]:
    """(a, b, leaves, saved) summed over subtrees; rows of one digest are added up. Parents of topmost rows need no row of their own."""
    order = np.lexsort((b, a))
    first = np.ones(len(a), bool)
    first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    rows = order[first]
    nodes = NodeTable(a[rows], b[rows])
    slot, mine = nodes.slots(a, b), nodes.slots(a[rows], b[rows])
    if (slot < 0).any():
        raise ValueError("a digest has no slot")
    n = len(rows)
    total = np.zeros((n, 2), dtype=np.int64)
    np.add.at(total, slot, np.stack([leaves, saved], axis=1))
    parent, level = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    parent[mine], level[mine] = nodes.slots(pa[rows], pb[rows]), depth[rows]
    deepest = np.argsort(-level, kind="stable")
    for part in np.split(deepest, np.flatnonzero(np.diff(level[deepest])) + 1):
        part = part[parent[part] >= 0]
        np.add.at(total, parent[part], total[part])
    return nodes.a, nodes.b, total[:, 0], total[:, 1]


def subtree_sums(nodes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """a, b, n_leaves, saved_tokens of every node with two members or more, and of some others.

    ``nodes`` is a node table with ``n_children``. The shard of a conversation follows its hundred, so
    that conversations with first turns in common meet.
    """
    spark = nodes.sparkSession
    inner = nodes.where("depth > 0")
    shared = inner.where("n_convs > 1").select("conv_id", "a", "b", "pa", "pb", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    single = inner.where("n_convs = 1").groupBy("conv_id").agg(F.min(F.struct("depth", "a", "b", "pa", "pb")).alias("s"))
    single = single.select("conv_id", "s.a", "s.b", "s.pa", "s.pb", "s.depth", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    tops = inner.groupBy("conv_id").agg(F.min("depth").alias("top"))
    above = prefixes.join(splittable(tops, "conv_id"), "conv_id").where("depth < top").select("conv_id", "a", "b", "pa", "pb", "depth", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    n = max(shuffle_width(spark), nodes.count() // SHARD_ROWS + 1)
    rows = shared.unionByName(single).unionByName(above)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.col("conv_id") - F.col("conv_id") % 100), F.lit(n)).cast("int"))
    rows = rows.groupBy("shard", "a", "b").agg(*[F.max(c).alias(c) for c in ("pa", "pb", "depth", "leaves", "saved")])

    def run(batches):
        import pyarrow as pa

        names = ["a", "b", "pa", "pb", "depth", "leaves", "saved"]
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64())])

        def done(parts):
            sums = accumulate(*[np.concatenate([p[c] for p in parts]) for c in names])
            for lo in range(0, len(sums[0]), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 10_000], pa.int64()) for x in sums], schema=schema)

        now, parts = None, []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if shard[lo] != now and parts:
                    yield from done(parts)
                    parts = []
                now = shard[lo]
                parts.append({c: batch.column(c).slice(lo, hi - lo).to_numpy().astype(np.int64) for c in names})
        if parts:
            yield from done(parts)

    found = rows.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long, leaves long, saved long")
    return found.groupBy("a", "b").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def build(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt ``conversations`` (conv_id, turn, role, text, ...), one row each.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Turns are ordered by ``turn``, null first; turns that tie are ordered by
    the digest of role and text, so equal rows are two turns. A null role or text is empty. Rows
    without a conv_id belong to no conversation. A conversation may end with no turns: it is a member of
    the root. No conversations: no rows. Other columns are ignored.
    """
    prefixes, convs = rebuilt(conversations)
    nodes = node_table(prefixes, convs)
    counts = nodes.where("depth > 0").groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children"))
    counts = counts.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children")
    nodes = materialize(nodes.join(counts, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    sums = materialize(subtree_sums(nodes, prefixes), "subtrees")
    root = sums.join(nodes.where("depth = 1").select("a", "b"), ["a", "b"]).agg(F.sum("n_leaves"), F.sum("saved_tokens")).first()  # one row
    parents = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    whole = nodes.join(splittable(parents, "pa"), ["pa", "pb"], "left").join(sums, ["a", "b"], "left").join(end_digests(prefixes, convs), ["a", "b"], "left")
    is_root, alone = F.col("depth") == 0, F.coalesce("n_leaves", F.lit(1))
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.when(is_root, F.lit(root[0] or 1).cast("long")).otherwise(alone).alias("n_leaves"),
        F.when(is_root, F.lit(root[1] or 0).cast("long")).otherwise(F.coalesce("saved_tokens", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
