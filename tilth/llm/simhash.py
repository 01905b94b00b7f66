"""SimHash near-duplicates linked through BK-trees.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Fingerprints
within a few bits of each other agree on all but a few of the blocks their bits are cut into, so
distinct fingerprints are dealt into shards by every choice of agreeing blocks; a shard's BK-tree is
grown in the task that holds it and searched along edges within the radius before each insertion.
A shard with many members is dealt again by a finer cut of its free bits, which bounds any shard at
2 to the power of ten members. Shards yield the edges of a spanning forest, not pairs.
"""

from __future__ import annotations

import uuid
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilth.llm.common import bounded_batches, connected_components, materialize, shuffle_width, splittable

HOT_SHARD = 512


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of each of a whole text's word shingles, repeats included; fewer words make one, no words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a whole text; 0 for one without words."""
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, fp (signed 64-bit), a row per row. A null text is empty."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class BkTree:
    """Children keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the values at most ``radius`` bits away."""
        found, open_ = [], [0] if self.values else []
        while open_:
            node = open_.pop()
            gap = (self.values[node] ^ value).bit_count()
            if gap <= radius:
                found.append(node)
            for edge, child in self.children[node].items():
                if gap - radius <= edge <= gap + radius:
                    open_.append(child)
        return found

    def touches(self, value: int, radius: int) -> bool:
        """Whether any value is at most ``radius`` bits away."""
        open_ = [0] if self.values else []
        while open_:
            node = open_.pop()
            gap = (self.values[node] ^ value).bit_count()
            if gap <= radius:
                return True
            open_ += [child for edge, child in self.children[node].items() if gap - radius <= edge <= gap + radius]
        return False

    def add(self, value: int) -> int:
        node, place = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while place:
            edge = (self.values[node] ^ value).bit_count()
            if edge not in self.children[node]:
                self.children[node][edge] = place
                break
            node = self.children[node][edge]
        return place


def shard_links(values: list[int], names: list[int], radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``values``, as (name, name); each edge is a link."""
    tree, parent, found = BkTree(), [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value in values:
        near = tree.within(value, radius)
        me = tree.add(value)
        parent.append(me)
        for other in near:
            a, b = root(me), root(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((names[me], names[other]))
    return found


def _masks(bits: list[int], blocks: int, free: int) -> list[int]:
    """For each choice of ``free`` blocks, the mask of ``bits`` in the other blocks."""
    cut = [bits[i * len(bits) // blocks : (i + 1) * len(bits) // blocks] for i in range(blocks)]
    return [sum(1 << b for k in range(blocks) if k not in loose for b in cut[k]) for loose in combinations(range(blocks), free)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_edges(first: DataFrame, radius: int = 2) -> DataFrame:
    """``first`` (fp distinct, name) -> a, b: names whose fingerprints differ in at most ``radius`` bits, enough of them to reach all others that do."""
    masks = _masks(list(range(64)), radius + 3, radius)
    shards = F.array(*[F.struct(F.lit(i).alias("cut"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    dealt = first.select("fp", "name", F.explode(shards).alias("s")).select("fp", "name", "s.cut", "s.key")
    sizes = splittable(dealt.groupBy("cut", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key")
    met = dealt.join(sizes, ["cut", "key"])
    finer = F.lit(None)
    for i, m in enumerate(masks):
        loose = [b for b in range(64) if not m >> b & 1]
        sub = [_signed(m | x) for x in _masks(loose, 6, radius)]
        finer = F.when(F.col("cut") == i, F.array(*map(F.lit, sub))).otherwise(finer) if i else F.when(F.col("cut") == 0, F.array(*map(F.lit, sub)))
    plain = F.array(F.struct(F.lit(-1).alias("sub"), F.col("key").alias("key")))
    again = F.transform(finer, lambda mask, j: F.struct(j.alias("sub"), F.col("fp").bitwiseAND(mask).alias("key")))
    spread = met.select("fp", "name", "cut", F.explode(F.when(F.col("n") > HOT_SHARD, again).otherwise(plain)).alias("s")).select("cut", "s.sub", "s.key", "fp", "name")

    def grow(batches):
        import pyarrow as pa

        shard, values, names = None, [], []

        def flush():
            if len(values) > 1 and (found := shard_links(values, names, radius)):
                a, b = zip(*found, strict=True)
                return [pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])]
            return []

        for batch in batches:
            for *where, fp, name in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if where != shard:
                    yield from flush()
                    shard, values, names = where, [], []
                values.append(fp & (1 << 64) - 1)
                names.append(name)
        yield from flush()

    return (
        spread.repartition(shuffle_width(first.sparkSession), "cut", "sub", "key")
        .sortWithinPartitions("cut", "sub", "key", "name")
        .mapInArrow(grow, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
        .distinct()
    )


def link(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``prints`` (doc_id, fp) -> doc_id, fp, component_id: the smallest doc_id reachable by links.

    Equal fingerprints are linked; so are those at most ``radius`` bits apart. Rows with a null
    doc_id take the component of their fingerprint's other documents, null if there are none.
    """
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("name")), "prints")
    edges = near_edges(first.where("name is not null"), radius)
    parts = connected_components(materialize(edges, "links"), "components")
    of_print = first.join(parts.withColumnRenamed("node", "name"), "name", "left").select("fp", F.coalesce("component", "name").alias("component_id"))
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, fingerprint (16 hex digits), component_id; a row per row."""
    prints = materialize(fingerprints(docs, width, seed), "doc-prints")
    return link(prints, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- similarity of 0.8 and more -----------------------------------------------------------------
#: Texts are near-duplicates from a Jaccard similarity of 4 / 5 of their distinct shingles.
TOKEN_BYTES = 5
CHUNK = 4096
SAMPLE, COMMON = 10_000, 200_000
#: Other pairs that a member of a list proposes at most, round by round; the last round takes all.
ROUNDS = (4, 64, None)


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct 40-bit tokens of shingle hashes."""
    return np.unique(hashes & np.uint64((1 << 8 * TOKEN_BYTES) - 1))


def _packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // TOKEN_BYTES, 8), np.uint8)
    wide[:, :TOKEN_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, TOKEN_BYTES)
    return wide.view("<u8").ravel()


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens in as many bits as there are tokens, at least 512, a power of two.

    Two sets differ in at least as many tokens as their sketches, folded to one size, in bits.
    """
    bits = 512 << max(0, (len(tokens) - 1).bit_length() - 9)
    at = ((tokens * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches of one length as rows of ``words`` 64-bit words."""
    rows = np.frombuffer(b"".join(sketches), "<u8").reshape(len(sketches), -1)
    while rows.shape[1] > words:
        rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
    return rows


def _apart(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """In how many bits the sketches of each pair differ."""
    sizes = np.array([(len(x), len(y)) for x, y in zip(xs, ys, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(xs), np.int64)
    for p, q in np.unique(sizes, axis=0).tolist():
        pick = np.flatnonzero((sizes == (p, q)).all(axis=1)).tolist()
        x, y = (_folded([s[i] for i in pick], min(p, q) // 8) for s in (xs, ys))
        out[pick] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def alike(a: bytes, b: bytes) -> bool:
    """Whether the Jaccard similarity of two packed sets is 4 / 5 or more."""
    x, y = _unpacked(a), _unpacked(b)
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def _prefixes(sets: list[np.ndarray], common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each set the tokens first in order of (rank, token) that no set as similar can miss: tokens, places, of which set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    ranks = np.zeros(len(tokens), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        ranks = np.where(common[at] == tokens, rank[at], 0)
    order = np.lexsort((tokens, ranks, of))
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = place < np.repeat(sizes - (4 * sizes + 4) // 5 + 1, sizes)
    return tokens[order][keep], place[keep], of[keep]


def _could_be(n, at, m, to) -> np.ndarray:
    """Whether sets of n and m tokens that share those at these places as their first can be similar."""
    return 9 * np.minimum(n - at, m - to) >= 4 * (n + m)


def _whole(batches, keys: int):
    """The sorted rows in tables that end where a run of rows that agree in their first ``keys`` columns ends, and where each run starts."""
    import pyarrow as pa

    def starts(table):
        new = np.zeros(table.num_rows - 1, bool)
        for i in range(keys):
            c = table.column(i).to_numpy()
            new |= c[1:] != c[:-1]
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    pending = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        if pending and all(pending[-1].column(i)[-1] == table.column(i)[-1] for i in range(keys)):
            pending.append(table)  # the run goes on over all of it
            continue
        table = pa.concat_tables([*pending, table]).combine_chunks()
        marks = starts(table)
        if marks[-1]:
            yield table.slice(0, marks[-1]), marks[:-1]
        pending = [table.slice(marks[-1])]
    if pending:
        table = pa.concat_tables(pending).combine_chunks()
        yield table, starts(table)


def _batches_of(table, rows: int = 1 << 16):
    return table.combine_chunks().to_batches(max_chunksize=rows)


def _shared(batches):
    """Lists of a token (n, node, place; by n) with two and more nodes: each row once, the list's size, its first node and the one before if they can be similar.

    The first and the last list of a partition may go on in others: ``edge`` marks their rows, one alone too.
    """
    import pyarrow as pa

    tables = _whole(batches, 1)
    now, first = next(tables, None), True
    while now is not None:
        after = next(tables, None)
        table, marks = now
        token, n, node, at = (table.column(i).to_numpy() for i in range(4))
        new = np.ones(len(node), bool)  # copies from other tasks stand next to each other
        new[1:] = (node[1:] != node[:-1]) | (token[1:] != token[:-1])
        sizes = np.add.reduceat(new.astype(np.int64), marks)
        edges = np.zeros(len(marks), bool)
        edges[0], edges[-1] = edges[0] | first, edges[-1] | (after is None)
        lengths = np.diff([*marks, len(node)])
        keep = new & np.repeat((sizes > 1) | edges, lengths)
        token, n, node, at, edge = token[keep], n[keep], node[keep], at[keep], np.repeat(edges, lengths)[keep]
        sizes = sizes[(sizes > 1) | edges]
        head = np.repeat(np.cumsum(sizes) - sizes, sizes)
        here = np.arange(len(node))
        before = np.maximum(here - 1, head)
        of_head = (here > head) & _could_be(n[head], at[head], n, at)
        of_before = (before > head) & _could_be(n[before], at[before], n, at)
        cols = [pa.array(token), pa.array(n), pa.array(node), pa.array(at), pa.array(np.repeat(sizes, sizes))]
        cols += [pa.array(node[head], mask=~of_head), pa.array(node[before], mask=~of_before), pa.array(edge)]
        yield from _batches_of(pa.table(cols, ["token", "n", "node", "at", "size", "head", "before", "edge"]))
        now, first = after, False


def _lists(prefixes: DataFrame) -> DataFrame:
    """``prefixes`` (token, n, node, at) as lists: token, n, node, at, size, head, before. A list is cut where a partition ends.

    Rows go to tasks by ranges of (token, n, node), so a very common token is many tasks with as many rows as others have.
    Only the lists at the two edges of a partition can be cut; what they are together is summed up over at most two
    rows a partition, which is broadcast. A cut list counts as longer than three, so that all its pairs are sought.
    """
    entry = "token long, n int, node long, at int"
    dealt = prefixes.repartitionByRange(shuffle_width(prefixes.sparkSession), "token", "n", "node").sortWithinPartitions("token", "n", "node")
    lists = materialize(dealt.mapInArrow(_shared, f"{entry}, size long, head long, before long, edge boolean"), "shared-shingles")
    cut = lists.where("edge").groupBy("token").agg(F.count(F.lit(1)).alias("total"), F.min(F.struct("n", "node", "at")).alias("h"))
    cut = materialize(cut, "cut-lists").where("total > 1")
    similar_to_head = (F.col("node") != F.col("h.node")) & (9 * F.least(F.col("n") - F.col("at"), F.col("h.n") - F.col("h.at")) >= 4 * (F.col("n") + F.col("h.n")))
    joined = lists.where("edge").join(F.broadcast(cut), "token").select("token", "n", "node", "at", F.greatest("total", F.lit(4)).alias("size"), F.when(similar_to_head, F.col("h.node")).alias("head"), "before")
    return lists.where("not edge").drop("edge").union(joined)


def _other_pairs(batches, most: int | None):
    """From each cell (token, i, j; block, n, node, place, component, sketch) pairs of components apart that can be similar.

    Each member of a component but the largest gives its ``most`` nearest by sketch, None: all.
    A row of nulls says that some cell had more.
    """
    import pyarrow as pa

    def pairs(a, b):
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    more = False
    for table, lo, hi in ((t, a, b) for t, marks in _whole(batches, 3) for a, b in zip(marks.tolist(), [*marks[1:].tolist(), t.num_rows], strict=True)):
        low, high = (int(table.column(i)[lo].as_py()) for i in (1, 2))
        block, n, node, at, part = (table.column(i).to_numpy()[lo:hi] for i in (3, 4, 5, 6, 7))
        raw = table.column(8).slice(lo, hi - lo).to_pylist()
        _, of, count = np.unique(part, return_inverse=True, return_counts=True)
        words = np.array([len(r) // 8 for r in raw])
        groups = {}  # similar sets' sketches have one size or differ by one fold
        for w in np.unique(words).tolist():
            rows = [np.flatnonzero(words == v) for v in (w, 2 * w)]
            bits = [_folded([raw[i] for i in r.tolist()], w) for r in rows if len(r)]
            groups[w] = np.concatenate(rows), np.concatenate(bits), len(rows[0])
        a, b, held = [], [], 0
        for i in np.flatnonzero(of != count.argmax()).tolist():
            ok = _could_be(n[i], at[i], n, at) & (of != of[i])
            if low != high:
                ok &= block != block[i]
            found, gaps = [], []
            for w in {int(words[i]), int(words[i]) // 2} & groups.keys():
                rows, bits, own = groups[w]
                pick = np.flatnonzero(ok[rows] if w == words[i] else ok[rows[:own]])
                if len(pick):
                    apart = np.bitwise_count(bits[pick] ^ _folded([raw[i]], w)).sum(axis=1, dtype=np.int64)
                    j = rows[pick]
                    near = 9 * apart <= n[i] + n[j]
                    found.append(j[near])
                    gaps.append(apart[near])
            j = np.concatenate(found) if found else np.zeros(0, np.int64)
            if most is not None and len(j) > most:
                more = True
                j = j[np.lexsort((node[j], np.concatenate(gaps)))[:most]]
            if len(j):
                a.append(np.full(len(j), node[i]))
                b.append(node[j])
                held += len(j)
            if held > 1 << 16:
                yield pairs(a, b)
                a, b, held = [], [], 0
        if held:
            yield pairs(a, b)
    if more:
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 2, ["a", "b"])


def _sketched(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that the sketches leave, and in how many bits these differ."""

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            if len(batch):
                apart = _apart(batch.column(3).to_pylist(), batch.column(5).to_pylist())
                ok = 9 * apart <= batch.column(2).to_numpy().astype(np.int64) + batch.column(4).to_numpy()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart)], ["a", "b", "apart"]).filter(pa.array(ok))

    one = marks.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("sketch").alias("x"))
    two = marks.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n", "x", "m", "y").mapInArrow(check, "a long, b long, apart long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar, as a table."""

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            ok = [alike(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    wanted = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "compared")
    few = wanted.count() <= 500_000  # 4 MB
    whole = materialize(sets.join(F.broadcast(wanted) if few else wanted, "node", "left_semi").select("node", "tokens").dropDuplicates(["node"]), "compared-sets")
    one = whole.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    two = whole.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    return materialize(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "alike")


def similar(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, component_id: documents linked by similar word shingles.

    Documents whose sets of distinct shingles have a Jaccard similarity of 0.8 or more are linked,
    all of them and no others, up to collisions of 40-bit hashes. The candidates: sets whose SimHash
    fingerprints a BK-tree finds within two bits, and, for those it can't find, an exact filter. In any
    order of all shingles, similar sets of n and m share one of the first n - ceil(0.8 n) + 1 and
    m - ceil(0.8 m) + 1, so pairs are sought in the lists of those only; shingles common in a sample come
    last in the order. Of each list the pairs with its first member and of neighbours come first, the
    nearest by sketch of each document before the others; then lists that hold more than one component
    give pairs between components that neither sizes, places nor sketches rule out, nearest first, at last
    all. Whole sets decide. Tasks get ranges of lists, cut anywhere; lists of over ``CHUNK`` members are compared in cells of two blocks each.
    A null text is empty; texts without words are one node. Rows with a null doc_id have the
    component of their text, null if no other document is in it.
    """
    return _components(_prints(docs, width)).select("doc_id", "component_id")


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark (a hash of the text), node (a hash of the set), n, fp, and, in a task's first row of the node, tokens and sketch; a row per row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        import xxhash

        seen = set()
        for batch in batches:
            nodes, sizes, prints, raws, bits = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_hashes(text, width, 42)
                tokens = shingle_set(hashes)
                raw = _packed(tokens)
                node = xxhash.xxh3_64_intdigest(raw, 7)
                new = node not in seen
                nodes.append(node)
                sizes.append(len(tokens))
                prints.append(majority(hashes) if new else None)
                raws.append(raw if new else None)
                bits.append(sketch(tokens) if new else None)
                seen.add(node)
            fps = pa.array([None if p is None else _signed(p) for p in prints], pa.int64())
            cols = [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), fps, pa.array(raws, pa.binary()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "mark", "node", "n", "fp", "tokens", "sketch"])

    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return materialize(cols.mapInArrow(run, "doc_id long, mark long, node long, n int, fp long, tokens binary, sketch binary"), "shingle-sets")


def _common(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens found three times and more in a sample of the sets, sorted, and how often. Their choice bears on speed only."""
    every = max(1, -(-sets.count() // SAMPLE))

    def spell(batches):
        import pyarrow as pa

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_unpacked(raw).astype(np.int64))], ["token"])

    counts = sets.where(F.pmod("node", F.lit(every)) == 0).select("tokens").mapInArrow(spell, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    rows = counts.where("k > 2").orderBy(F.desc("k"), "token").limit(COMMON).toArrow().sort_by("token")
    return rows["token"].to_numpy().astype(np.uint64), rows["k"].to_numpy()


def _tree_pairs(marks: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): nodes with equal fingerprints and links of the BK-trees."""
    first = materialize(marks.where("n > 0").groupBy("fp").agg(F.min("node").alias("name")), "node-prints")
    same = marks.where("n > 0").join(splittable(first, "fp"), "fp").where("node <> name").select(F.col("name").alias("a"), F.col("node").alias("b"))
    return same.union(near_edges(first, radius)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _components(prints: DataFrame) -> DataFrame:
    """``prints`` with component_id: the smallest doc_id of the rows whose nodes reach each other by links."""
    spark = prints.sparkSession
    width = shuffle_width(spark)
    sets = prints.where("tokens is not null").select("node", "n", "tokens")
    common = spark.sparkContext.broadcast(_common(sets))

    def index(batches):
        import pyarrow as pa

        order, rank = common.value
        for batch in batches:
            node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            block = np.cumsum(n, dtype=np.int64) // 250_000  # tokens at once
            for lo, hi in zip(*(np.searchsorted(block, np.unique(block), side=side).tolist() for side in ("left", "right")), strict=True):
                token, place, of = _prefixes([_unpacked(raw) for raw in batch.column(2).slice(lo, hi - lo).to_pylist()], order, rank)
                of += lo
                yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(n[of]), pa.array(node[of]), pa.array(place.astype(np.int32))], ["token", "n", "node", "at"])

    lists = _lists(materialize(sets.where("n > 0").mapInArrow(index, "token long, n int, node long, at int"), "prefixes"))
    marks = materialize(prints.where("sketch is not null").select("node", "n", "fp", "sketch").dropDuplicates(["node"]), "sketches")

    def pairs_of(other: str) -> DataFrame:
        return lists.where(f"{other} is not null").select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b"))

    near = materialize(_sketched(_tree_pairs(marks).union(pairs_of("head")).union(pairs_of("before")).distinct(), marks), "first-pairs")
    done = near.limit(0).select("a", "b")  # pairs compared
    parts = near.limit(0).select(F.col("a").alias("node"), F.col("b").alias("part"))

    def join_up(pairs: DataFrame, label: str) -> None:
        nonlocal done, parts
        pairs = materialize(pairs, f"{label}-pairs")
        if pairs.isEmpty():
            return
        links = _verified(pairs, sets)
        done = done.union(pairs)
        grown = connected_components(links.union(parts.select(F.col("node").alias("a"), F.col("part").alias("b"))), f"{label}-components")
        parts = materialize(grown.select("node", F.col("component").alias("part")), f"{label}-parts")

    def apart(pairs: DataFrame) -> DataFrame:
        """Pairs not compared yet whose nodes are in different components."""
        of = lambda key: parts.select(F.col("node").alias(key), F.col("part").alias(f"of_{key}"))
        both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return both.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b").join(done, ["a", "b"], "left_anti")

    nearest = near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    join_up(nearest, "nearest")

    # lists of up to three have given all their pairs
    rest = near.select("a", "b")
    long = lists.where("size > 3").select("token", "n", "node", "at", "size")
    k = F.ceil(F.col("size") / CHUNK)
    mine = F.pmod(F.xxhash64("node", F.lit(1)), k).cast("int")
    cells = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: F.struct(F.least(j, F.col("block")).cast("int").alias("low"), F.greatest(j, F.col("block")).cast("int").alias("high")))
    for most in ROUNDS:
        placed = long.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
        placed = materialize(placed, "long-lists")
        open_ = splittable(placed.groupBy("token").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least < most"), "token").select("token")
        spread = (
            placed.join(open_, "token").join(marks.select("node", "sketch"), "node").withColumn("block", mine).withColumn("cell", F.explode(cells))
            .select("token", "cell.low", "cell.high", "block", "n", "node", "at", "part", "sketch")
            .repartition(width, "token", "low", "high").sortWithinPartitions("token", "low", "high")
        )
        found = spread.mapInArrow(lambda batches, most=most: _other_pairs(batches, most), "a long, b long")
        rest = materialize(found.union(rest).distinct(), "other-pairs")
        join_up(apart(rest.where("a is not null")), "other")
        if rest.where("a is null").isEmpty():
            break
        rest = near.limit(0).select("a", "b")
    linked = prints.select("doc_id", "mark", "node").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    least = splittable(linked.groupBy("part").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first")), "part")
    return linked.join(least, "part").select("doc_id", "mark", "component_id", F.col("first.mark").alias("first_mark"))


def keep_first(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of ``docs`` per group of similar documents, the one with the smallest doc_id.

    Rows with a null doc_id come after all others. Of rows that agree in doc_id and text one stays;
    of rows that share a doc_id but are not similar, one of each group.
    """
    rows = _components(_prints(docs, width))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("first_mark"))
    keys = materialize(rows.groupBy("doc_id", "mark").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("times")), "kept-keys")
    gone, repeated = keys.where("not stays").select("doc_id", "mark"), keys.where("stays and times > 1").select("doc_id", "mark")

    doc, mark = (f"{name}_{uuid.uuid4().hex}" for name in ("doc", "mark"))  # no column of docs has these names

    def keyed(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
        few = other.count() <= 1_000_000  # 16 MB
        side = (F.broadcast(other) if few else other).toDF(doc, mark)
        return df.join(side, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(mark)), how)

    kept = keyed(docs, gone, "left_anti")
    if repeated.isEmpty():
        return kept
    one = keyed(kept, repeated, "left_semi").withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark]).drop(mark)
    return keyed(kept, repeated, "left_anti").union(one)
