"""Vector bin packing of training examples by the dot-product heuristic.

A sequence has limits on tokens, segments and loss-bearing tokens at once. The open sequence takes, of all examples that
still fit under every limit, the one whose demands have the greatest dot product with what is left of the limits, each
dimension weighed by its average demand; when none fits, the next sequence is opened. Examples of equal demands are one
type, so a step looks at types. Blocks of bounded size are packed apart from each other, which costs a few half-filled
sequences a block and makes memory and time of a task independent of the input.

Defined results: a null or empty text is its end token alone; repeated rows are packed one by one; an example beyond a
limit raises; an empty table gives no rows; a very long text is encoded word by word and its ids are held by one task;
other columns of the examples are carried along.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import one_key, stored
from tessera.llm.tokens import LONG, REMEMBERED, by_bytes, joined

END = 2
BLOCK = 8192
MEMORY = 1_000_000  # words that a worker remembers


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 64
    loss: int = 4096


#: A word of Latin letters with trailing marks: two pre-tokens at most, and lower case is the same in every library.
_plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: Where a long word without blanks is cut: no pre-token and no composed character reaches across.
_fine = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[。，、；：！？])|(?<=[。，、；：！？])(?=\p{L})", regex.V1)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order."""
    kept = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    moved = (b for b in range(256) if b not in kept)
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(moved)}


class Ids:
    """Ids of texts as little-endian 32-bit bytes; words that a worker has met are not encoded again.

    Blanks and line ends separate pre-tokens of a word vocabulary and are dropped, so a text's ids are those of its words.
    A plain word goes straight to the vocabulary's merges, any other through the whole tokenizer.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        self.memory = memory
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.known: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _core(self, core: str) -> bytes:
        raw = self.cores.get(core)
        if raw is None:
            spelled = core if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
            raw = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            if len(core) <= REMEMBERED:
                self.cores[core] = raw
        return raw

    def _learn(self, new: set[str]) -> None:
        other = []
        for w in new:
            if (m := _plain.fullmatch(w)) and (not m[2] or m[2] in self.cores):
                self.known[w] = self._core(m[1].lower()) + (self.cores[m[2]] if m[2] else b"")
            else:
                other.append(w)
        for batch in by_bytes(other):
            for w, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                self.known[w] = array("I", e.ids).tobytes()
                if (m := _plain.fullmatch(w)) and m[2] and m[2] not in self.cores:
                    self.cores[m[2]] = array("I", self.tokenizer.encode(m[2], add_special_tokens=False).ids).tobytes()

    def of(self, texts: list[str]) -> list[bytes]:
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        for k, words in enumerate(cut):
            if len(texts[k]) > LONG and max(map(len, words)) > LONG:
                cut[k] = [fine for w in words for fine in ([w] if len(w) <= LONG else joined(_fine.split(w), LONG))]
        known = self.known
        new = {w for words in cut for w in words if w not in known}
        if new:
            self._learn(new)
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for w in [w for w in new if len(w) > REMEMBERED]:
            del known[w]
        if len(known) > self.memory:
            self.known = {w: known[w] for words in cut for w in words if w in known}
        if len(self.cores) > self.memory:
            self.cores.clear()
        return out


@cache
def _ids(path: str, memory: int) -> Ids:
    return Ids(path, memory)


def _cutter(path: str, most: int, memory: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path, memory)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows = []
                for doc, raw in zip(batch.column(0).to_pylist(), ids.of([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    for start in range(0, n, most):
                        piece = raw[4 * start : 4 * (start + most)]
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), n, len(piece) // 4 - (start == 0)))
                columns = zip(*rows, strict=True) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss"])

    return run


def document_pieces(docs: DataFrame, path: str, most: int = 4096, memory: int = MEMORY) -> DataFrame:
    """Every document's ids and its end token, cut into pieces of ``most``; a first token bears no loss.

    ``memory``: words a worker remembers, of about 200 bytes each. It keeps them for its next task, so a chain of stages
    in one session takes a smaller number, at the price of encoding rare words more often.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(_cutter(path, most, memory), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long")


def place(demands: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Rows of ``demands`` (n x dimensions) by sequence, in the order in which they were placed."""
    if (demands > limits).any():
        raise ValueError("an example is beyond the limits of a sequence; cut it first")
    types, kind, counts = np.unique(demands, axis=0, return_inverse=True, return_counts=True)
    members = np.split(np.argsort(kind, kind="stable"), np.cumsum(counts)[:-1])
    waiting = [list(m[::-1]) for m in members]
    scaled = types / limits
    scaled = scaled * np.maximum((scaled * counts[:, None]).sum(axis=0), 1e-12) / len(demands)
    alive = np.ones(len(types), dtype=bool)
    sequences: list[list[int]] = []
    while alive.any():
        room, own = limits.copy(), []
        while True:
            fits = alive & (types <= room).all(axis=1)
            if not fits.any():
                break
            best = int(np.argmax(np.where(fits, scaled @ (room / limits), -1.0)))
            own.append(int(waiting[best].pop()))
            alive[best] = bool(waiting[best])
            room = room - types[best]
        sequences.append(own)
    return sequences


def _packer(limits: Limits, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(block: pa.Table) -> pa.Table:
        lengths = block.column("length").to_numpy()
        demands = np.stack([lengths, np.ones_like(lengths), block.column("loss").to_numpy()], axis=1)
        order = np.lexsort([block.column(c).to_numpy() for c in ("loss", "length")])
        number, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        first = block.column(names[0])[0].as_py() << 32
        for k, own in enumerate(place(demands[order], np.array([limits.tokens, limits.segments, limits.loss]))):
            rows = order[own]
            number[rows] = first + k
            offset[rows] = np.r_[0, np.cumsum(lengths[rows])[:-1]]
        return block.drop_columns([names[0]]).append_column(names[1], pa.array(number)).append_column(names[2], pa.array(offset))

    return run


def pack(examples: DataFrame, limits: Limits, block: int = BLOCK) -> DataFrame:
    """``examples`` (long columns length and loss, and others) with sequence_id and offset, the place in the sequence."""
    rows = stored(examples, "pieces")
    blocks = max(1, math.ceil(rows.count() / block))
    # Dealt by row number of the stored table, so that equal rows spread as evenly as others.
    name = one_key("block", rows.columns)
    dealt = rows.withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + ["sequence_id long", "offset long"])
    return dealt.groupBy(name).applyInArrow(_packer(limits, [name, "sequence_id", "offset"]), schema)
