"""SimHash near-duplicates with pivot distance tables.

Words of the lower-cased text (A-Z only) form shingles; a bit of the fingerprint is 1 where more than half of the shingle
hashes have it set. Documents of equal fingerprint are one node; where a similarity is set, those of equal shingle sets are
(by a hash of the sorted set), and fingerprints are those of the sets, so repetitions do not count. Two nodes are compared
only where they share a key:

* ``blocks``: five blocks of the 64 bits, a key for each pair of blocks. Fingerprints that differ in three bits or fewer
  agree in two blocks at least, so no link is lost. A key that very many nodes have is refined: its other 38 bits are cut
  into four parts, one of which a linked pair shares.
* ``anchors``: where a similarity is set: bands of three least shingle hashes. The nodes of a key are a candidate group
  only, and ``confirmed`` links its members by the exact similarity of their shingle sets.

Within a key, each node's distances to the reference fingerprints (the pivot table) are computed once; a pair whose
distances to any reference differ by more than the radius is discarded by the triangle inequality, the others are
verified: bit by bit, and by their shingle sets where a similarity is set. A node that has been reached is not compared
again, so a key with m near copies gives m - 1 edges and not all pairs. Components come from alternating large-star and
small-star steps over the edges, as tables.

Defined results: a null or empty text has fingerprint zero, linked like any other; fewer words than a shingle are one
shingle; repeated rows and ties share node and component; a component's id is the least non-null id in it; an empty table
gives no rows; a very long text is one set of shingles in memory, 8 bytes each; other columns are not read.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_PIECE = 1 << 15
#: Nodes of a key that one task compares, and shingles of a block of a candidate group: what bounds the memory of a task.
CROWDED = 1 << 16
BLOCK_NODES, BLOCK_SHINGLES = 1024, 1 << 18
BROADCAST_ROWS = 500_000  # of five numbers at most: under 50 MB


@dataclass(frozen=True)
class Near:
    """What counts as near. ``words`` fingerprint words of 64 bits each; links at ``radius`` or fewer differing bits."""

    shingle: int = 3
    words: int = 1
    radius: int = 3
    keys: str = "blocks"
    bands: int = 12
    pivots: int = 64
    similarity: float | None = None


#: The contract: three-word shingles, 64 bits, three differing bits.
CLOSE = Near()
#: Five-word shingles; the exact similarity of the sets decides. Sets of similarity 0.8 differ in 39 of 256 bits on average
#: (deviation 6), so that 84 lets such pairs through and only keeps unlike ones (128, deviation 8) from the exact check.
SIMILAR = Near(shingle=5, words=4, radius=84, keys="anchors", similarity=0.8)


def _odd(seed: int, n: int) -> np.ndarray:
    draw = random.Random(seed)
    return np.array([draw.getrandbits(64) | 1 for _ in range(n)], dtype=np.uint64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the six separators
    parts = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)] * bool(words)
    return np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), dtype=np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Majority bits; the words after the first use hashes remixed by odd multipliers."""
    out = np.zeros(words, dtype=np.uint64)
    for k, odd in enumerate(_odd(7, words)):
        ones = np.zeros(64, dtype=np.int64)
        for lo in range(0, len(hashes), _PIECE):
            h = hashes[lo : lo + _PIECE]
            if k:
                h = h * odd
                h ^= h >> np.uint64(32)
                h *= odd
            ones += np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def _block_keys(fp: int) -> list[int]:
    parts = [(fp >> at) & ((1 << n) - 1) for at, n in _BLOCKS]
    return [(t << 52) | (parts[i] << 26) | parts[j] for t, (i, j) in enumerate(itertools.combinations(range(5), 2))]


def _anchor_keys(hashes: np.ndarray, odd: np.ndarray, bands: int) -> list[int]:
    if not len(hashes):
        return [0]
    least = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[lo : lo + 2048, None] * odd[None, :]).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(bands, -1))]


def _signed(values: list[int] | np.ndarray) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64).view(np.int64)


def _sketcher(near: Near) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = _odd(11, 3 * near.bands)
        for batch in batches:
            node, words, keys, ties, sizes = [], [], [], [], []
            for text in batch.column(1):
                text = text.as_py()
                h = shingle_hashes(text, near.shingle)
                if near.similarity is None:
                    fp = fingerprint(h, near.words)
                    node.append(int(fp[0]) if near.words == 1 else xxhash.xxh64_intdigest(fp.tobytes(), 1))
                else:
                    h, fp = np.unique(h), np.array([], dtype=np.uint64)  # members of candidate groups get theirs later
                    node.append(xxhash.xxh64_intdigest(h.tobytes(), 1))
                words.append(_signed(fp))
                sizes.append(len(h))
                keys.append(_signed(_block_keys(int(fp[0])) if near.keys == "blocks" else _anchor_keys(h, odd, near.bands)))
                ties.append(xxhash.xxh64_intdigest((text or "").encode(), 42))
            columns = [batch.column(0), _signed(ties), _signed(node), pa.array(words, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), sizes]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns], ["doc_id", "tie", "node", "words", "keys", "size"])
        pa.default_memory_pool().release_unused()

    return run


def sketches(docs: DataFrame, near: Near = CLOSE) -> DataFrame:
    """doc_id, tie (hash of the text), node, fingerprint words (none with a similarity), keys and number of shingles; written once."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return stored(rows.mapInArrow(_sketcher(near), "doc_id long, tie long, node long, words array<long>, keys array<long>, size long"), "sketch")


class Pivots:
    """Distances of fingerprints (n x words) to the reference fingerprints, and what they and the bits leave over."""

    def __init__(self, fps: np.ndarray, near: Near):
        pivots = _odd(13, near.pivots * near.words).reshape(near.pivots, near.words)
        self.fps, self.radius = fps, near.radius
        self.table = np.stack([np.bitwise_count(fps ^ p).sum(axis=1, dtype=np.int16) for p in pivots], axis=1)

    def close(self, x: int, others: np.ndarray) -> np.ndarray:
        """A mask of ``others`` within the radius of ``x``."""
        near = np.abs(self.table[others] - self.table[x]).max(axis=1) <= self.radius
        near[near] = np.bitwise_count(self.fps[others[near]] ^ self.fps[x]).sum(axis=1) <= self.radius
        return near


def linked(n: int, close: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Edges, as index pairs, of a spanning forest of n nodes; ``close`` says which of the given nodes are near one."""
    left = np.arange(n)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = close(int(x), left)
            for y in left[near]:
                yield int(x), int(y)
            queue.extend(left[near])
            left = left[~near]


def _linker(near: Near) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None

        def groups(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            pairs: list[tuple[int, int]] = []
            for lo, n in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
                own = nodes[lo : lo + n]
                pairs += [(int(own[a]), int(own[b])) for a, b in linked(n, Pivots(fps[lo : lo + n], near).close)]
            a, b = zip(*pairs, strict=True) if pairs else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            fps = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, near.words)
            if rest is not None:
                keys, nodes, fps = (np.concatenate(x) for x in zip(rest, (keys, nodes, fps), strict=True))
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            rest = keys[cut:], nodes[cut:], fps[cut:]
            if cut:
                yield groups(keys[:cut], nodes[:cut], fps[:cut])
        if rest is not None:
            yield groups(*rest)

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node reachable, for every node of ``edges`` (a, b). Large-star and small-star in turn.

    Each step keeps or lowers the number of edges and works on counts per node; every round is written, so that the plan
    stays short and lost executors cost one round. The least neighbours are written before they are joined to the edges:
    both sides of the join are then plain exchanges, of which Spark splits the one that holds the edges of a hub.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(stored(low, "least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stored(large.distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = stored(small, "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        seen = state


class Sets:
    """Sets (sorted, distinct) with an inverted index: which others have a Jaccard similarity of ``similarity`` or more."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.similarity, self.sizes = similarity, np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        _, item = np.unique(np.concatenate(sets), return_inverse=True)
        self.posted = owner[np.argsort(item, kind="stable")]
        self.ends = np.cumsum(np.bincount(item))
        self.own = np.split(item, np.cumsum(self.sizes)[:-1])

    def close(self, x: int, others: np.ndarray) -> np.ndarray:
        ends = self.ends[self.own[x]]
        starts = np.where(self.own[x] > 0, self.ends[self.own[x] - 1], 0)
        lengths = ends - starts
        at = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        shared = np.bincount(self.posted[at], minlength=len(self.sizes))[others]
        return shared >= self.similarity * (self.sizes[x] + self.sizes[others] - shared) - 1e-9


def alike(sets: list[np.ndarray], near: Near) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the sets: pivots and bits discard, the sets themselves verify."""
    pivots, exact = Pivots(np.stack([fingerprint(x, near.words) for x in sets]), near), Sets(sets, near.similarity)

    def close(x: int, others: np.ndarray) -> np.ndarray:
        found = pivots.close(x, others)
        if found.any():
            found[found] = exact.close(x, others[found])
        return found

    return linked(len(sets), close)


def _confirmer(near: Near) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def edges(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        pairs = [(nodes[a], nodes[b]) for a, b in alike(sets, near)] if len(nodes) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets = None, [], []
        for batch in batches:
            for key, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if key != now:
                    if nodes:
                        yield edges(nodes, sets)
                    now, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.unique(shingle_hashes(text.as_py(), near.shingle)))  # one text is held, and not those of a batch
        if nodes:
            yield edges(nodes, sets)
        pa.default_memory_pool().release_unused()

    return run


def _small(table: DataFrame) -> DataFrame:
    """A stored table of short rows, marked for broadcast if it is small: texts need not move then. Else it is shuffled."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def shared_keys(nodes: DataFrame) -> DataFrame:
    """node, first, size, root of the nodes of every key that two or more have. Keys of the same nodes count once."""
    keyed = nodes.select(F.explode(F.array_distinct("keys")).alias("root"), "node", "first", "size")
    who = F.xxhash64("node")
    held = keyed.groupBy("root").agg(F.count("*").alias("m"), F.sum(who.cast("decimal(38,0)")).alias("s"), F.bit_xor(who).alias("x"))
    return keyed.join(held.where("m > 1").groupBy("m", "s", "x").agg(F.min("root").alias("root")), "root").select("node", "first", "size", "root")


def _blocks(groups: DataFrame) -> DataFrame:
    """``groups`` (node, first, size, root) of two nodes or more, in blocks (``mine`` of ``blocks``) of bounded nodes and shingles.

    Sizes are written before they are joined, so that the rows of a large group are not tied to the task that counted them.
    """
    sizes = groups.groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("n")).where("m > 1")
    most = F.greatest(F.ceil(F.col("m") / BLOCK_NODES), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int")
    dealt = groups.join(stored(sizes.select("root", most.alias("blocks")), "sizes"), "root")
    return stored(dealt.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "members")


def _compared(docs: DataFrame, asked: DataFrame, near: Near) -> DataFrame:
    """Edges (a, b) among the nodes of equal ``key``. ``asked``: node, first, key. One text is read for each row."""
    asked = stored(asked.select("key", "node", F.col("first.doc_id").alias("id"), F.col("first.tie").alias("t")), "asked")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("t"))
    dealt = rows.join(_small(asked), same).select("key", "node", "text").repartition("key").sortWithinPartitions("key", "node")
    return stored(dealt.mapInArrow(_confirmer(near), "a long, b long").where("a <> b").distinct(), "confirmed")


def confirmed(docs: DataFrame, candidates: DataFrame, near: Near) -> DataFrame:
    """Edges (a, b) that connect all pairs of exact similarity inside candidate groups; groups may overlap.

    ``candidates``: node, first, size, root. A large group is cut into blocks, so that memory is bounded. First each block
    is compared within itself, then one node of each component of each block with those of the group's other blocks. Only
    blocks that still hold different components are compared whole, every pair of them; a group of near copies is one
    component by then. So no pair that would connect two components is left out, and texts are not copied for the others.
    """
    members = _blocks(candidates)
    edges = _compared(docs, members.withColumn("key", F.xxhash64("root", "mine")), near)
    large = members.where("blocks > 1")
    if large.isEmpty():
        return edges
    label = lambda found, rows: _groups(rows.select("node", "first", "size", F.col("root").alias("group"), "blocks", "mine"), found)
    least = label(edges, large).groupBy("group", "mine", "root").agg(F.min(F.struct("node", "first", "size")).alias("s"))
    heads = _blocks(least.select("s.*", F.col("group").alias("root")))
    edges = stored(edges.union(_compared(docs, _pairs(heads, heads), near)).distinct(), "links")
    now = stored(label(edges, large), "labels")
    held = now.groupBy("group", "mine").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = held.groupBy("group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("group")
    rest = stored(now.join(mixed, "group").select("node", "first", "size", F.col("group").alias("root"), "blocks", "mine"), "mixed")
    if rest.isEmpty():
        return edges
    held = held.withColumnRenamed("group", "root")
    return edges.union(_compared(docs, _pairs(rest, held), near)).distinct()


def _pairs(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Rows with the ``key`` of every pair of blocks of their group. ``held`` with lo and hi: but for blocks of one component."""
    known = "lo" in held.columns
    blocks = held if known else held.select("root", "mine").distinct()
    one, two = blocks.alias("one"), blocks.alias("two")
    open_ = F.col("one.mine") <= F.col("two.mine")
    if known:  # within a block all has been compared
        same = (F.col("one.lo") == F.col("two.lo")) & (F.col("one.hi") == F.col("two.hi")) & (F.col("one.lo") == F.col("one.hi"))
        open_ = (F.col("one.mine") < F.col("two.mine")) & ~same
    pairs = one.join(two, (F.col("one.root") == F.col("two.root")) & open_)
    pairs = pairs.select("one.root", F.array_distinct(F.array("one.mine", "two.mine")).alias("both"))
    pairs = pairs.withColumn("key", F.xxhash64("root", F.element_at("both", 1), F.element_at("both", -1)))
    return rows.join(pairs.select("root", "key", F.explode("both").alias("mine")), ["root", "mine"]).select("node", "first", "key")


def _groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``root``, the least node of their component; nodes without edges are components of their own."""
    if edges.isEmpty():
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _free_parts(key: int, fp: int) -> list[int]:
    """The 38 bits of a fingerprint outside of a block key, in four parts: three differing bits leave one part equal."""
    taken = list(itertools.combinations(range(5), 2))[key >> 52]
    rest, at = 0, 0
    for k, (start, n) in enumerate(_BLOCKS):
        if k not in taken:
            rest |= ((fp >> start) & ((1 << n) - 1)) << at
            at += n
    cuts = [at * k // 4 for k in range(5)]
    return [(rest >> lo) & ((1 << (hi - lo)) - 1) for lo, hi in itertools.pairwise(cuts)]


def _refiner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [
            _signed([xxhash.xxh64_intdigest(f"{key}:{k}:{part}".encode(), 3) for k, part in enumerate(_free_parts(key, words[0] & (2**64 - 1)))])
            for key, words in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int64())), batch.column(1), batch.column(2)], ["keys", "node", "words"])


def _keyed(nodes: DataFrame) -> DataFrame:
    """key, node, words: a row for each key of each node; keys that more than ``CROWDED`` nodes have are refined."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node", "words")
    crowded = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("key"), "crowded")
    if crowded.isEmpty():
        return keyed
    fine = keyed.join(crowded, "key", "left_semi").mapInArrow(_refiner, "keys array<long>, node long, words array<long>")
    return keyed.join(crowded, "key", "left_anti").unionByName(fine.select(F.explode("keys").alias("key"), "node", "words"))


def near_duplicates(docs: DataFrame, near: Near = CLOSE) -> DataFrame:
    """doc_id, tie, words and the component's least member (first_id, first_tie) of every document."""
    rows = sketches(docs, near)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("first")
    nodes = stored(rows.groupBy("node").agg(first, F.min(F.struct("words", "keys", "size")).alias("s")).select("node", "first", "s.*"), "nodes")
    if near.similarity is None:
        keyed = _keyed(nodes).repartition("key").sortWithinPartitions("key")
        edges = stored(keyed.mapInArrow(_linker(near), "a long, b long").distinct(), "links")
    else:
        edges = confirmed(docs, stored(shared_keys(nodes), "candidates"), near)
    labelled = stored(_groups(nodes.select("node", "first"), edges), "labelled")
    least = stored(labelled.groupBy("root").agg(F.min("first").alias("of")), "roots")  # as in ``_blocks``
    roots = labelled.join(least, "root").select("node", "of")
    return rows.select("doc_id", "tie", "node", "words").join(roots, "node").select(
        "doc_id", "tie", "words", F.col("of.doc_id").alias("first_id"), F.col("of.tie").alias("first_tie")
    )


def keep_one(docs: DataFrame, near: Near = SIMILAR) -> DataFrame:
    """The document of least id of each group of near-duplicates, columns unchanged.

    Documents to drop are found as ids and hashes; texts are shuffled only where that list is too long to broadcast.
    """
    found = stored(near_duplicates(docs, near).select("doc_id", "tie", "first_id", "first_tie"), "groups")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("tie") == F.col("first_tie"))
    counted = found.groupBy(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie")).agg(F.bool_or(is_first).alias("first"), F.count("*").alias("n"))
    gone = stored(counted.where("not first or n > 1"), "gone")
    tie = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = lambda k: docs["doc_id"].cast("long").eqNullSafe(k["__id"]) & (tie == k["__tie"])
    kept = docs.join(_small(gone), same(gone), "left_anti")
    again = stored(gone.where("first"), "again")  # firsts that are there more than once
    if again.isEmpty():
        return kept
    twins = docs.join(_small(again), same(again), "left_semi")
    return kept.unionByName(twins.withColumn("__t", F.xxhash64("text")).dropDuplicates(["doc_id", "__t"]).drop("__t"))
