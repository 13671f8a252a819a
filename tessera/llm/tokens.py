"""Token counts: batch encoding in Arrow functions that returns lengths only.

A text is cut before single spaces between two non-space characters. No pre-token of a byte-level vocabulary reaches
across such a place and no special string holds a space, so lengths of the pieces add up to that of the text. A piece that
is still long is cut further before other blanks and between letters and sentence marks, where no pre-token reaches across
either. Short pieces that a worker has counted before come from its memory, which is bounded; the others are encoded in
batches of bounded bytes. So neither many texts nor one very long text make a large call; only a single run of letters,
digits or symbols does, which is one pre-token and has no safe boundary.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted one by one; an empty table
gives no rows; a very long text is cut like any other; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

BATCH_BYTES = 1 << 18
MEMORY = 1_000_000  # pieces
REMEMBERED, LONG = 64, 4096  # characters up to which a piece is remembered, and beyond which it is cut further

_marks = ".,;:!?。，、；：！？"
_fine = regex.compile(rf"(?<=\S)(?=\s)|(?<=\p{{L}})(?=[{_marks}])|(?<=[{_marks}])(?=\p{{L}})", regex.V1)
_seams = re.compile(r"(?<=\S)(?= \S)")


@cache
def _tokenizer(path: str) -> Tokenizer:
    """Loaded once in each worker, without truncation or padding."""
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def pieces(text: str) -> list[str]:
    """The text cut at its seams; joined again they are the text."""
    if not text:
        return []
    parts = text.split(" ")
    if "" not in parts and all(p == p.strip() for p in parts):  # every space stands alone between non-spaces
        parts = [parts[0], *map(" ".__add__, parts[1:])]
    else:
        parts = _seams.split(text)
    if len(text) > LONG and max(map(len, parts)) > LONG:
        parts = [fine for p in parts for fine in ([p] if len(p) <= LONG else joined(_fine.split(p), LONG))]
    return parts


def joined(parts: Iterable[str], most: int) -> Iterator[str]:
    """Neighbours put together again up to ``most`` characters."""
    held, size = [], 0
    for p in parts:
        if held and size + len(p) > most:
            yield "".join(held)
            held, size = [], 0
        held.append(p)
        size += len(p)
    yield "".join(held)


def by_bytes(items: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of about equal bytes: a batch is closed before it would pass the limit."""
    batch, size = [], 0
    for item in items:
        n = 4 * len(item)
        if batch and size + n > limit:
            yield batch
            batch, size = [], 0
        batch.append(item)
        size += n
    if batch:
        yield batch


class Lengths:
    """Token counts of pieces; a worker remembers ``MEMORY`` short ones, and when these are too many, those of its last texts."""

    def __init__(self, path: str):
        self.tokenizer, self.known = _tokenizer(path), {}

    def of(self, texts: list[str]) -> list[int]:
        known = self.known
        cut = [pieces(t) for t in texts]
        new = {p for parts in cut for p in parts if p not in known}
        for batch in by_bytes(new):
            for p, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                known[p] = len(e)
        out = [sum(map(known.__getitem__, parts)) for parts in cut]
        for p in [p for p in new if len(p) > REMEMBERED]:
            del known[p]
        if len(known) > MEMORY:
            self.known = {p: known[p] for parts in cut for p in parts if p in known}
        return out


@cache
def _lengths(path: str) -> Lengths:
    return Lengths(path)


def _counter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                counted = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(lengths.of(texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *counted], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document. ``path``: a tokenizer file that every executor can open."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(_counter(path), "doc_id long, n_bytes long, n_tokens long")
