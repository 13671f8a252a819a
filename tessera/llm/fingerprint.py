"""Document fingerprints: one-permutation MinHash with optimal densification, with DataFrame functions only.

Shingles of five words are hashed once. The upper bits of a hash choose a bin, the least hash of each bin is its sample;
an empty bin borrows from the first filled one on a probing order of its own (a full cycle, so it ends), and of each
sample only the lowest bits are stored, packed. Chance agreement of those bits is corrected in ``likeness``.

Defined results: a text of fewer words than a shingle is one shingle; a text without words (null, empty) has the empty
fingerprint, which is like itself (1.0) and unlike all others (0.0). Repeated rows and ties in id are ordered by the
hash of their text, null ids come first; ids are any 64-bit numbers. In an empty table there is nothing to order. A very
long text is one row of one task, 8 bytes for each of its words. Other columns are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import let, stored, words

SHINGLE = 5
BINS = 128
BITS = 8
_BIN_BITS = 7
_PER_WORD = 64 // BITS
_UNROLLED = 12


def shingle_hashes(w: Column, size: int = SHINGLE) -> Column:
    """XXH64 of each shingle of an array of words; of the whole array if it is shorter; none of an empty one."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    one = F.array(F.xxhash64(F.array_join(w, " ")))
    return F.when(F.size(w) >= size, each).when(F.size(w) > 0, one).otherwise(F.array().cast("array<bigint>"))


def _longs(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def packed(text: Column) -> Column:
    """The fingerprint as ``BINS * BITS / 64`` longs; an empty array for a text without words."""
    marks = [((b - BINS // 2 + 1) << (64 - _BIN_BITS)) - 1 for b in range(BINS)]  # the greatest hash of each bin: "empty"
    draw = random.Random(42)
    starts, strides = [draw.randrange(BINS) for _ in range(BINS)], [2 * draw.randrange(BINS // 2) + 1 for _ in range(BINS)]
    empty, start, stride = _longs(marks), _longs(starts), _longs(strides)
    upper = lambda x: F.shiftright(x, 64 - _BIN_BITS)

    def least(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (upper(x) != upper(F.get(s, i - 1))))

    def dense(d: Column) -> Column:
        sample = lambda j: F.when(F.get(d, j) != F.get(empty, j), F.get(d, j))
        probe = lambda b, t: (F.get(start, b) + F.get(stride, b) * t).cast("int").bitwiseAND(F.lit(BINS - 1))
        rest = lambda b: F.element_at(
            F.filter(F.transform(F.sequence(F.lit(_UNROLLED), F.lit(BINS - 1)), lambda t: sample(probe(b, t))), lambda v: v.isNotNull()), 1
        )
        return F.transform(
            F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(sample(b), *[sample(probe(b, F.lit(t))) for t in range(_UNROLLED)], rest(b))
        )

    def pack(v: Column) -> Column:
        def word(q: int) -> Column:
            out = F.lit(0).cast("long")
            for k in range(_PER_WORD):
                out = out.bitwiseOR(F.shiftleft(F.get(v, F.lit(q * _PER_WORD + k)).bitwiseAND(F.lit((1 << BITS) - 1)), BITS * k))
            return out

        return F.array(*[word(q) for q in range(BINS // _PER_WORD)])

    hashes = let(words(text), shingle_hashes)
    made = lambda h: let(let(let(F.sort_array(F.concat(h, empty)), least), dense), pack)
    return let(hashes, lambda h: F.when(F.size(h) > 0, made(h)).otherwise(F.array().cast("array<bigint>")))


def as_text(fingerprint: Column) -> Column:
    """A packed fingerprint as lower-case hex digits."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, corrected for bits that agree by chance."""

    def differing(s: Column, q: int) -> Column:
        x = F.get(s["a"], F.lit(q)).bitwiseXOR(F.get(s["b"], F.lit(q)))
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            x = let(x, lambda v: v.bitwiseOR(F.shiftrightunsigned(v, shift).bitwiseAND(F.lit(mask))))  # noqa: B023 - used at once
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    def compared(s: Column) -> Column:
        total = differing(s, 0)
        for q in range(1, BINS // _PER_WORD):
            total = total + differing(s, q)
        chance = 2.0**-BITS
        score = F.greatest(F.lit(0.0), ((BINS - total) / F.lit(float(BINS)) - chance) / (1 - chance))
        none = (F.size(s["a"]) == 0) | (F.size(s["b"]) == 0)
        return F.when(none, (F.size(s["a"]) == F.size(s["b"])).cast("double")).otherwise(score)

    return let(F.struct(a.alias("a"), b.alias("b")), compared)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and packed fingerprint of every document. A narrow map, no shuffle."""
    return docs.select(docs[id_col].alias(id_col), packed(docs[text_col]).alias("fingerprint"))


_KEY = ("has", "id", "tie")
_COPIES = 1024


def _order(keyed: DataFrame) -> DataFrame:
    """Distinct documents in order, without texts: their key, how often they are there (``held``), the fingerprint of each
    and of the next one, and the key and length of the one before. The ends are joined to a ring.

    Ranges of keys are cut by Spark from a sample of them, so ids may lie anywhere and one id may be there very often.
    Neighbours across two ranges come from a table of one row a range.
    """
    narrow = keyed.select(*_KEY, F.length("text").alias("n"), packed(F.col("text")).alias("fp"))
    once = narrow.groupBy(*_KEY).agg(F.count("*").alias("held"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    ranged = stored(once.repartitionByRange(*_KEY).withColumn("part", F.spark_partition_id()), "order")
    key = F.struct(*_KEY)
    ends = ranged.groupBy("part").agg(F.min(F.struct(key.alias("k"), "fp")).alias("head"), F.max(F.struct(key.alias("k"), "n")).alias("tail"))
    parts = Window.partitionBy(F.lit(0)).orderBy("part")
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("head").over(parts), F.first("head").over(whole)).alias("head"),
        F.coalesce(F.lag("tail").over(parts), F.last("tail").over(whole)).alias("tail"),
    )
    inside = Window.partitionBy("part").orderBy(*_KEY)
    linked = ranged.withColumns({"next_fp": F.lead("fp").over(inside), "before": F.lag(F.struct(key.alias("k"), "n")).over(inside)})
    linked = linked.join(ends, "part").withColumns({"next_fp": F.coalesce("next_fp", "head.fp"), "before": F.coalesce("before", "tail")})
    return stored(linked.select(*_KEY, "held", "n", "fp", "next_fp", "before"), "links")


def with_next(docs: DataFrame) -> DataFrame:
    """Each document with the fingerprints of itself and of the next by id (after the last: the first), and ``next_head``:
    as many first characters of the next one as are a quarter of its own.

    Texts are shuffled once, by a hash of id and text, and their heads once more. Of equal rows one takes part, its copies
    follow one another and so are next to themselves.
    """
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    keyed = keyed.withColumns({"has": F.col("doc_id").isNotNull(), "id": F.coalesce("doc_id", F.lit(0)), "tie": F.xxhash64("text")})
    order = _order(keyed)
    twins = stored(order.where("held > 1").select(*_KEY), "twins")
    several = not twins.isEmpty()
    texts = keyed.select(*_KEY, "text")
    if several:
        listed = F.broadcast(twins) if twins.count() <= 1_000_000 else twins  # three numbers a row
        one = texts.join(listed, [*_KEY], "left_semi").groupBy(*_KEY).agg(F.first("text").alias("text"))
        texts = texts.join(listed, [*_KEY], "left_anti").unionByName(one)
    placed = texts.join(order, [*_KEY])
    quarter = lambda n: F.floor(n / 4).cast("int")
    heads = placed.select(*[F.col(f"before.k.{c}").alias(c) for c in _KEY], F.left("text", quarter(F.col("before.n"))).alias("next_head"))
    rows = placed.join(heads, [*_KEY])
    out = [F.when(F.col("has"), F.col("id")).alias("doc_id"), "text", "fp", "next_head", "next_fp"]
    made = rows.select(*out)
    if not several:
        return made
    own = {"next_head": F.left("text", quarter(F.col("n"))), "next_fp": F.col("fp")}
    more = placed.where("held > 1").withColumns(own).withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("held") - 2) / _COPIES))))
    each = F.explode(F.sequence(F.lit(1), F.least(F.lit(_COPIES), F.col("held") - 1 - F.col("lot") * _COPIES)))
    return made.unionByName(more.repartition(*_KEY, "lot").select(*out, each.alias("copy")).drop("copy"))


def edited(text: Column, other: Column) -> Column:
    """The text with its last quarter replaced by as many first characters of another one."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.left(text, F.length(text) - cut), F.when(cut > 0, F.left(other, cut)).otherwise(F.lit("")))
