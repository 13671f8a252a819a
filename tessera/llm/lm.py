"""Stupid-backoff language-model scores from the corpus's own counts.

Model: bigrams over whole texts. A bigram seen twice or more scores its count over that of its first word; any other
backs off to 0.4 times the frequency of its second word. Every word has its own count, however rare it is.

Words and bigrams both grow with the corpus, so neither is broadcast. They are keys of 64 bits: a word is its hash, a bigram
the mixed hashes of its two words (two of 10^9 different keys are equal with probability 0.03 in all). Workers cut the
documents into chunks of about a million words, written once as the hashes of a chunk's words and the places where they
stand. A chunk asks for the counts of its distinct keys, sorted, so that equal ranges of hashes are parts: one row for a chunk
and a part. Each part adds up what all chunks have of a key and answers every chunk in its own order; each chunk joins the
answers to its occurrences and sums per document. A key that every document has makes its part larger by one entry a chunk.

Defined results: a null or empty text has no words, no score (null) and zero counts; repeated rows count and are scored
one by one; an empty table gives no rows; other columns are not read. A finite ``RAREST`` merges words rarer than one in
so many into one symbol, which makes a smaller model; as it is set, no words are merged.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored, words

ALPHA = 0.4
SEEN = 2
RAREST = math.inf  # a word has an entry of its own if it makes up at least one in so many words
PART = 3_000_000
CHUNK = 4096
CHUNK_WORDS = 1 << 20

_START, _RARE = (np.uint64(xxhash.xxh64_intdigest(b, 42)) for b in (b"", b" "))  # no words: a word has no blank
_CHUNK = {"chunk": pa.int64(), "docs": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "vocab": pa.binary(), "at": pa.binary()}
_CHUNK_DDL = "chunk long, docs array<long>, sizes array<int>, vocab binary, at binary"


def _squeezed(x: np.ndarray) -> bytes:
    """Bytes of equal rank together, compressed: most of the high ones are zero."""
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), asbytes=True)


def _loosened(raw: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def _word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def frequent(docs: DataFrame) -> np.ndarray | None:
    """Sorted hashes of the words that stay apart under a finite ``RAREST`` (so many at most); None if all do."""
    if RAREST == math.inf:
        return None
    counts = stored(docs.select(F.explode(words(docs["text"])).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "unigrams")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= max(1, -(-total // RAREST))).select("w").collect()
    return np.sort(np.array([_word_hash(r[0].encode()) for r in rows], dtype=np.uint64))


def _chunker(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks: their documents, numbers of words, hashes of distinct words, and the place of each word in these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if shared is None else shared.value
        chunk = TaskContext.get().partitionId() << 33

        def emit() -> pa.RecordBatch:
            vocab = np.fromiter(map(_word_hash, ids), dtype=np.uint64, count=len(ids))
            if own is not None:
                vocab = np.where(np.isin(vocab, own), vocab, _RARE)
            at = np.concatenate(found)
            row = (chunk, docs, [len(x) for x in found], vocab.tobytes(), _squeezed(at))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _CHUNK.values(), strict=True)], list(_CHUNK))

        def fresh() -> defaultdict[bytes, int]:
            new: defaultdict[bytes, int] = defaultdict()
            new.default_factory = new.__len__
            return new

        ids, docs, found, held = fresh(), [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                each = (text.as_py() or "").encode().split()
                docs.append(doc.as_py())
                found.append(np.fromiter(map(ids.__getitem__, each), dtype=np.uint32, count=len(each)))
                held += len(each)
                if len(docs) == CHUNK or held >= CHUNK_WORDS:
                    yield emit()
                    ids, docs, found, held, chunk = fresh(), [], [], 0, chunk + 1
        if docs:
            yield emit()

    return run


def _keys(sizes: np.ndarray, vocab: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the first word, the second word and the bigram at each word of a chunk."""
    second = np.frombuffer(vocab, dtype=np.uint64)[_loosened(at, int(sizes.sum()), "<u4")]
    first = np.r_[_START, second[:-1]] if len(second) else second
    first[np.r_[0, np.cumsum(sizes)[:-1]][sizes > 0]] = _START
    both = first * np.uint64(0x9E3779B97F4A7C15) + second
    for _ in range(2):
        both ^= both >> np.uint64(32)
        both *= np.uint64(0xD6E8FEB86659FD93)
    return first, second, both ^ (both >> np.uint64(32))


def _asker(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one by one: a row is megabytes
                (row,) = batch.slice(k, 1).to_pylist()
                sizes = np.array(row["sizes"], dtype=np.int64)
                first, second, both = _keys(sizes, row["vocab"], row["at"])
                starts = np.full(np.count_nonzero(sizes), _START)
                keys, n = np.unique(np.concatenate([second, starts, both]), return_counts=True)
                part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # grows with the key
                cuts = np.searchsorted(part, np.arange(parts + 1))
                steps = np.r_[keys[:1], np.diff(keys)]  # shorter than keys
                steps[cuts[:-1][cuts[:-1] < len(keys)]] = keys[cuts[:-1][cuts[:-1] < len(keys)]]
                n = n.astype("<i4")
                rows = [(p, row["chunk"], b - a, _squeezed(steps[a:b]), _squeezed(n[a:b])) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
                if rows:
                    columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["part", "chunk", "size", "keys", "n"])

    return run


def _counter(rows: pa.Table) -> pa.Table:
    """What all chunks have of the keys of one part, told to each chunk in the order of its own keys."""
    sizes = rows.column("size").to_pylist()
    asked, n = (zip(rows.column(c).to_pylist(), sizes, strict=True) for c in ("keys", "n"))
    own, at = np.unique(np.concatenate([np.cumsum(_loosened(x, m, "<u8"), dtype=np.uint64) for x, m in asked]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([_loosened(x, m, "<i4") for x, m in n]), minlength=len(own)).astype("<i8")[at]
    told = pa.array([_squeezed(x) for x in np.split(n, np.cumsum(sizes)[:-1])], pa.binary())
    return pa.table({**{c: rows.column(c) for c in ("chunk", "part", "size")}, "n": told})


def _scorer(n_words: int) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        (row,) = rows.filter(rows.column("part").is_null()).to_pylist()
        told = rows.filter(rows.column("part").is_valid()).select(["part", "size", "n"]).sort_by("part").to_pylist()
        counts = np.concatenate([np.zeros(0), *(_loosened(x["n"], x["size"], "<i8") for x in told)])
        sizes = np.array(row["sizes"], dtype=np.int64)
        first, second, both = _keys(sizes, row["vocab"], row["at"])
        keys = np.unique(np.concatenate([second, first[first == _START], both]))
        n_first, n_second, n_both = (counts[np.searchsorted(keys, x)] for x in (first, second, both))
        seen = n_both >= SEEN
        score = np.where(seen, np.log(n_both / n_first), math.log(ALPHA) + np.log(n_second / max(1, n_words)))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        hits, total = (np.bincount(doc, weights=x, minlength=len(sizes)) for x in (seen, score))
        columns = [pa.array(row["docs"], pa.int64()), pa.array(sizes), pa.array(hits.astype(np.int64)), pa.array(total, pa.float64(), mask=sizes == 0)]
        return pa.table(columns, names=["doc_id", "n_words", "n_seen", "log_score"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_seen (bigrams that did not back off), log_score (natural) of every document."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    own = frequent(rows)
    shared = None if own is None else docs.sparkSession.sparkContext.broadcast(own)
    chunks = stored(rows.mapInArrow(_chunker(shared), _CHUNK_DDL), "chunks")
    n_words = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    asked = chunks.mapInArrow(_asker(max(1, math.ceil(n_words / PART))), "part long, chunk long, size long, keys binary, n binary")
    told = asked.groupBy("part").applyInArrow(_counter, "chunk long, part long, size long, n binary")
    both = chunks.unionByName(told, allowMissingColumns=True)
    return both.groupBy("chunk").applyInArrow(_scorer(n_words), "doc_id long, n_words long, n_seen long, log_score double")
