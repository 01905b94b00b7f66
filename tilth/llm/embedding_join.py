"""Near-duplicate embeddings by an exact metric range join.

Vectors are grouped by value first. The distinct ones go to the cell of their nearest pivot and are
packed there into blocks, a row each, so that a vector is stored and shuffled once whatever its number of
neighbours. Blocks meet in a Cartesian product, which reads them again and shuffles nothing. A vector within
the radius of a member of cell j lies, by the triangle inequality, at most twice the radius farther from
pivot j than from its own pivot, and at most the radius beyond the plane between the two: a block
knows the cells that any of its vectors can reach so, blocks that can't reach each other do not meet, and of
those that meet only the vectors that can reach the other's cell are compared: by blocked matrix products,
in single precision with a margin to find candidates and in double precision to decide. Large cells are cut again
by pivots of their own; what these leave large is split by a hash. A task emits link counts and a spanning forest,
never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilth.llm.common import bounded_batches, connected_components, materialize, shuffle_width

MARGIN = 1e-4
#: Above the rounding of angles and distances; it can only add guests.
SLACK = 1e-7
#: Bytes of the vectors of a block.
BLOCK_BYTES = 4 << 20


def usable(v: Column) -> Column:
    """True for vectors that can link: not null or empty, every component finite, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    # scaled first, so that no square overflows or vanishes
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def apart_only(pivots: np.ndarray) -> np.ndarray:
    """The unit rows without those that lie on an earlier one, so that each is surely nearest to itself."""
    return pivots[~(np.tril(pivots @ pivots.T, -1) > 1 - 1e-9).any(axis=1)]


def reachable(x: np.ndarray, pivots: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each unit vector, matrix of the cells whose members it may be linked with)."""
    apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))
    home, reach = np.zeros(len(x), np.int64), np.zeros((len(x), len(pivots)), bool)
    for at in range(0, len(x), 1024):
        some = slice(at, at + 1024)
        near = np.clip(x[some] @ pivots.T, -1, 1)
        home[some] = near.argmax(axis=1)
        own = near.max(axis=1)[:, None]
        by_triangle = np.arccos(near) - np.arccos(own) <= 2 * angle + SLACK
        reach[some] = by_triangle & (own - near <= 2 * math.sin(angle / 2) * apart[home[some]] + SLACK)
    return home, reach


def leaves(x: np.ndarray, pivots: np.ndarray | None, inner: dict[int, np.ndarray], angle: float):
    """(cell, inner cell, places of members, places of guests) of unit vectors.

    A cell with pivots of its own is cut by them as the whole is by its pivots: members of an inner
    cell are nearest to its pivot among those, so the same two bounds hold for all that the cell gets.
    """
    if pivots is None:
        yield 0, 0, np.arange(len(x)), np.zeros(0, np.int64)
        return
    home, reach = reachable(x, pivots, angle)
    for cell in range(len(pivots)):
        at = np.flatnonzero(reach[:, cell])
        own = home[at] == cell
        if cell not in inner:
            yield cell, 0, at[own], at[~own]
            continue
        near, within = reachable(x[at], inner[cell], angle)
        for sub in range(len(inner[cell])):
            mine = own & (near == sub)
            yield cell, sub, at[mine], at[within[:, sub] & ~mine]


def reaching(x: np.ndarray, home: tuple[int, int], leaf: tuple[int, int], pivots: np.ndarray | None, inner: dict[int, np.ndarray], angle: float) -> np.ndarray:
    """Places of the unit vectors, all of the leaf (cell, inner cell) ``home``, that may be linked with members of another leaf."""
    at = np.arange(len(x))
    if pivots is None or home == leaf:
        return at

    def across(own: np.ndarray, other: np.ndarray) -> np.ndarray:
        to_own, to_other = np.clip(x @ own, -1, 1), np.clip(x @ other, -1, 1)
        by_triangle = np.arccos(to_other) - np.arccos(to_own) <= 2 * angle + SLACK
        apart = math.sqrt(max(0, 2 - 2 * (own @ other)))
        return by_triangle & (to_own - to_other <= 2 * math.sin(angle / 2) * apart + SLACK)

    if home[0] == leaf[0]:
        return at[across(inner[home[0]][home[1]], inner[home[0]][leaf[1]])]
    at = at[across(pivots[home[0]], pivots[leaf[0]])]
    if leaf[0] in inner and len(at):
        at = at[reachable(x[at], inner[leaf[0]], angle)[1][:, leaf[1]]]
    return at


def linked(a: np.ndarray, b: np.ndarray, least: float, b_single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of unit rows whose inner product in double precision is at least ``least``."""
    hits = a.astype(np.float32) @ (b.astype(np.float32) if b_single is None else b_single).T >= least - MARGIN
    rows = np.flatnonzero(hits.any(axis=1))
    i, j = np.nonzero(hits[rows])
    i = rows[i]
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 16):  # the same sum in the same order for a pair, whichever side and however many
        some = slice(at, at + (1 << 16))
        keep[some] = (a[i[some]] * b[j[some]]).sum(axis=1) >= least
    return i[keep], j[keep]


class Block:
    """Vectors of one leaf, the links found of them so far, and a spanning forest of what these connect."""

    def __init__(self, leaf: tuple[int, int], ids: np.ndarray, names: np.ndarray, weights: np.ndarray, x: np.ndarray):
        self.leaf, self.ids, self.names, self.weights, self.x = leaf, ids, names, weights, x
        self.links = np.zeros(len(ids), np.int64)
        self.parent = list(range(len(ids)))
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def meet(self, other: Block, own: np.ndarray, theirs: np.ndarray, least: float) -> None:
        """Links between the vectors at the places ``own`` and those at ``theirs`` of another block, or of this one."""
        x = self.x[own]
        single = x.astype(np.float32)
        for at in range(0, len(theirs), 512):
            some = theirs[at : at + 512]
            g, m = linked(other.x[some], x, least, single)
            g, m = some[g], own[m]
            if other is self:
                g, m = g[g != m], m[g != m]
            if not len(g):
                continue
            self.links += np.bincount(m, weights=other.weights[g], minlength=len(self.ids)).astype(np.int64)
            if other is not self:
                other.links += np.bincount(g, weights=self.weights[m], minlength=len(other.ids)).astype(np.int64)
            guests, at_first, of = np.unique(g, return_index=True, return_inverse=True)
            first = m[at_first]  # one member of each
            self.edges += zip(other.names[guests].tolist(), self.names[first].tolist(), strict=True)
            size = len(self.ids)
            for pair in np.unique(m * size + first[of]).tolist():
                a, b = self.root(pair // size), self.root(pair % size)
                if a != b:
                    self.parent[max(a, b)] = min(a, b)

    def forest(self) -> list[tuple[int, int]]:
        own = [(int(self.names[i]), int(self.names[self.root(i)])) for i in range(len(self.ids)) if self.root(i) != i]
        return [e for e in self.edges + own if e[0] != e[1]]


def near_duplicates(vectors: DataFrame, least: float = 0.9, cell_rows: int = 5000, most_pivots: int = 1024, most_inner: int = 16_384) -> DataFrame:
    """``vectors`` (vec_id, embedding, ...) -> vec_id, n_links, component_id, kept; a row per row.

    Links are pairs of rows with cosine of at least ``least``; vectors of different lengths, null,
    empty or zero vectors and those with a null or non-finite component have none and are their own
    component. Rows of one vec_id are separate vectors, but one node of the components. A null
    vec_id is in its equal vectors' component. At most ``most_pivots`` pivots cut the whole, and at most
    as many each cell of over twice ``cell_rows`` members, ``most_inner`` in all; only these, and a row
    per cell, reach the driver. What is still larger is split by hash.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    grouped = rows.where(usable(F.col("embedding"))).groupBy("embedding").agg(F.min("vec_id").alias("name"), F.count(F.lit(1)).alias("weight"))
    distinct = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    total = distinct.count()
    angle = math.acos(least)
    n_pivots = max(1, min(most_pivots, -(-total // cell_rows)))
    # a bounded sample of pivots, at most most_pivots vectors
    chosen = [r["embedding"] for r in distinct.select("embedding").orderBy(F.xxhash64("cid"), "cid").limit(n_pivots).collect()]
    pivots = {size: apart_only(unit(np.array([p for p in chosen if len(p) == size], dtype=np.float64))) for size in {len(p) for p in chosen}}
    shared = spark.sparkContext.broadcast(pivots)

    def matrix(column) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, flat values) of a list column."""
        offsets = column.offsets.to_numpy()
        return np.diff(offsets), column.values.to_numpy()[offsets[0] : offsets[-1]]

    def by_size(batch, column: int, within: dict):
        """(vector length, places in the batch, leaves) of the vectors of each length."""
        sizes, flat = matrix(batch.column(column))
        starts = np.cumsum(sizes) - sizes
        for size in np.unique(sizes).tolist():
            pick = np.flatnonzero(sizes == size)
            x = unit(flat[starts[pick][:, None] + np.arange(size)])
            yield size, pick, leaves(x, shared.value.get(size), within.get(size, {}), angle)

    def members_by_leaf(inner) -> dict:
        """Members of each (size, cell, inner cell): a row for each reaches the driver."""

        def count(batches):
            import pyarrow as pa

            for batch in batches:
                rows = [(size, cell, sub, len(own)) for size, _, found in by_size(batch, 0, inner.value) for cell, sub, own, _ in found if len(own)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int32())] * 4, ["size", "cell", "inner", "n"])

        counts = distinct.select("embedding").mapInArrow(count, "size int, cell int, inner int, n int").groupBy("size", "cell", "inner")
        return {(r["size"], r["cell"], r["inner"]): r["n"] for r in counts.agg(F.sum("n").alias("n")).collect()}

    inner = spark.sparkContext.broadcast({})
    found = members_by_leaf(inner)
    large = {key[:2] for key, n in found.items() if n > 2 * cell_rows and key[0] in pivots}
    if large:
        every = max(cell_rows, -(-2 * total // most_inner))
        some = distinct.where(F.pmod(F.xxhash64("cid", F.lit(2)), F.lit(every)) == 0).select("embedding").limit(most_inner).collect()
        cut: dict = {}
        for size in {size for size, _ in large}:
            # with a pivot in front, so that a size without samples is no case of its own
            x = unit(np.array([pivots[size][0], *[r["embedding"] for r in some if len(r["embedding"]) == size]], dtype=np.float64))[1:]
            home = reachable(x, pivots[size], angle)[0]
            of = {cell: apart_only(x[home == cell][:most_pivots]) for s, cell in large if s == size}
            cut[size] = {cell: p for cell, p in of.items() if len(p) > 1}
        inner = spark.sparkContext.broadcast(cut)
        found = members_by_leaf(inner)
    parts = {key: -(-n // (2 * cell_rows)) for key, n in found.items()}
    layout = spark.sparkContext.broadcast({key: (i, parts[key]) for i, key in enumerate(sorted(parts))})

    def place(batches):
        """Each vector with its leaf: (size, cell, inner cell, part) and the vector's row."""
        import pyarrow as pa

        for batch in batches:
            turn = batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
            of = np.zeros((4, len(batch)), np.int32)
            for size, pick, found in by_size(batch, 3, inner.value):
                for cell, sub, own, _ in found:
                    n = layout.value.get((size, cell, sub), (-1, 1))[1]
                    of[:3, pick[own]] = np.array([[size], [cell], [sub]], np.int32)
                    of[3, pick[own]] = turn[pick[own]] % np.uint64(n)
            yield pa.RecordBatch.from_arrays([*map(pa.array, of), *batch.columns], ["size", "cell", "inner", "part", "cid", "name", "weight", "embedding"])

    def pack(batches):
        """Rows of blocks from vectors by leaf: (size, cell, inner, leaf's number, numbers it reaches as bits, ids, names, weights, unit vectors)."""
        import pyarrow as pa

        words = -(-len(layout.value) // 64)

        def block(key, some):
            size, cell, sub, _ = key
            ids, names, weights, x = (np.concatenate(c) for c in zip(*some, strict=True))
            reach = np.zeros(words * 64, np.uint8)
            for to, inside, own, guests in leaves(x, shared.value.get(size), inner.value.get(size, {}), angle):
                number = layout.value.get((size, to, inside), (-1, 1))[0]
                if number >= 0 and len(own) + len(guests):
                    reach[number] = 1
            bits = np.packbits(reach, bitorder="little").view(np.int64).tolist()
            number = layout.value.get((size, cell, sub), (-1, 1))[0]
            cols = [[size], [cell], [sub], [number], [bits], *[[c.tobytes()] for c in (ids, names, weights, x)]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 4 + [pa.list_(pa.int64())] + [pa.binary()] * 4, strict=True)], block_names)

        where, held, n = None, [], 0
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], axis=1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                at = lo
                while at < hi:
                    most = max(1, BLOCK_BYTES // (8 * int(key[lo][0])))
                    if held and (tuple(key[lo].tolist()) != where or n >= most):
                        yield block(where, held)
                        held, n = [], 0
                    where = tuple(key[lo].tolist())
                    some = batch.slice(at, min(hi - at, most - n))
                    _, flat = matrix(some.column(7))
                    names = some.column(5).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
                    held.append((some.column(4).to_numpy(), names, some.column(6).to_numpy(), unit(flat.reshape(len(some), -1))))
                    at, n = at + len(some), n + len(some)
        if held:
            yield block(where, held)

    block_names = ["size", "cell", "inner", "leaf", "reach", "ids", "names", "weights", "x"]
    block_schema = "size int, cell int, inner int, leaf int, reach array<long>, ids binary, names binary, weights binary, x binary"
    placed = distinct.select("cid", "name", "weight", "embedding").mapInArrow(place, "size int, cell int, inner int, part int, cid long, name long, weight long, embedding array<double>")
    keys = ["size", "cell", "inner", "part"]
    packed = placed.repartition(max(shuffle_width(spark), sum(parts.values())), *keys).sortWithinPartitions(*keys).mapInArrow(pack, block_schema)
    blocks = materialize(packed.withColumn("block", F.monotonically_increasing_id()), "vector-blocks")

    out_schema = T.StructType([T.StructField(n, T.LongType()) for n in ("cid", "links", "a", "b")])

    def join(batches):
        """Links of pairs of blocks: what a task finds of a vector is one row."""
        import pyarrow as pa

        counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def add(number: int, block: Block) -> None:
            if block.links.any():
                ids, links = counts.get(number, (block.ids, 0))
                counts[number] = ids, links + block.links

        def edges(block: Block):
            pairs = block.forest()
            if pairs:
                none = pa.array([None] * len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *(pa.array(c, pa.int64()) for c in zip(*pairs, strict=True))], out_schema.names)

        now, number = None, None
        for batch in batches:
            for i in range(len(batch)):

                def read(first: int, i: int = i, batch=batch) -> Block:
                    size, cell, sub = (batch.column(first + c)[i].as_py() for c in range(3))
                    ids, names, weights, x = (np.frombuffer(batch.column(first + 3 + c)[i].as_buffer(), t) for c, t in enumerate([np.int64] * 3 + [np.float64]))
                    return Block((cell, sub), ids.copy(), names.copy(), weights.copy(), x.reshape(-1, size).copy())

                size, one, two = batch.column(0)[i].as_py(), batch.column(7)[i].as_py(), batch.column(15)[i].as_py()
                if one != number:
                    if now:
                        add(number, now)
                        yield from edges(now)
                    now, number = read(0), one
                if one == two:
                    now.meet(now, np.arange(len(now.ids)), np.arange(len(now.ids)), least)
                    continue
                if size != batch.column(8)[i].as_py():
                    continue
                other = read(8)
                table, within = shared.value.get(size), inner.value.get(size, {})
                own = reaching(now.x, now.leaf, other.leaf, table, within, angle)
                theirs = reaching(other.x, other.leaf, now.leaf, table, within, angle)
                if len(own) and len(theirs):
                    now.meet(other, own, theirs, least)
                    add(two, other)
        if now:
            add(number, now)
            yield from edges(now)
        for ids, links in counts.values():
            none = pa.array([None] * int((links > 0).sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[links > 0]), pa.array(links[links > 0]), none, none], out_schema.names)

    def reaches(a: str, b: str) -> Column:
        leaf = F.col(f"{b}.leaf")
        word = F.get(F.col(f"{a}.reach"), F.shiftright(leaf, 6))
        # a leaf that had no members when they were counted has no number
        return (leaf < 0) | (F.call_function("getbit", word, leaf.bitwiseAND(F.lit(63))) == 1)

    # of two blocks either may come first, so that each task of the product has about half of its pairs
    first, second = F.col("a.block"), F.col("b.block")
    once = (first == second) | F.when((first + second) % 2 == 0, first < second).otherwise(first > second)
    sides = ["size", "cell", "inner", "ids", "names", "weights", "x", "block"]
    pairs = blocks.alias("a").join(
        blocks.alias("b").hint("shuffle_replicate_nl"),
        once & reaches("a", "b") & reaches("b", "a"),
    )
    chosen_columns = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "ab" for c in sides]
    joined = materialize(pairs.select(*chosen_columns).mapInArrow(join, out_schema), "vector-links")
    edges = joined.where(f"a is not null and least(a, b) > {np.iinfo(np.int64).min}").select("a", "b").distinct()
    groups = connected_components(edges, "vector-components").withColumnRenamed("node", "name")
    counted = joined.where("cid is not null").groupBy("cid").agg(F.sum("links").alias("links"))
    known = (
        distinct.select("cid", "name", "weight", "embedding")
        .join(counted, "cid", "left")
        .join(groups, "name", "left")
        .select("embedding", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "name").alias("component"))
    )
    return rows.join(known, "embedding", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"),
    )
