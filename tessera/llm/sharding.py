"""Consistent hashing with bounded loads, with DataFrame functions only.

Keys hash to the slots of a ring. Every shard has many virtual nodes on it; a key belongs to the first node clockwise of
its slot, and where that node's shard is full it continues clockwise to the next shard with room. Which rows continue
follows from counts per slot alone, so the ring is filled on the driver over ``slots`` counts, a number that does not
depend on the data, and what comes back is one interval of ranks per (slot, shard).

With ``epsilon=0`` the capacities add up to the rows: every shard is filled and sizes differ by one row at most. A larger
``epsilon`` moves fewer rows when shards are added, at the price of that balance.

Defined results: null ids hash alike; repeated rows are placed one by one; a null text has no bytes; an empty table gives
no rows; very long texts are read for their size and checksum only. Slots that hold far more rows than others (one id very often) are ranked in salted parts.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

SLOT_BITS = 14
NODES = 128
SALTS = 64
Segment = tuple[int, int, int]


def ring(shards: int, nodes: int = NODES, slot_bits: int = SLOT_BITS) -> list[tuple[int, int, int]]:
    """The virtual nodes clockwise as (slot, tie-break, shard); they depend on nothing but shard and node number."""

    def place(shard: int, node: int) -> tuple[int, int, int]:
        h = int.from_bytes(hashlib.blake2b(f"shard {shard} node {node}".encode(), digest_size=8).digest(), "big")
        return h >> (64 - slot_bits), h, shard

    return sorted(place(s, v) for s in range(shards) for v in range(nodes))


def capacities(n: int, shards: int, epsilon: float) -> list[int]:
    if epsilon > 0:
        return [math.ceil((1 + epsilon) * n / shards)] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def fill(counts: dict[int, int], shards: int, epsilon: float = 0.0, nodes: int = NODES, slot_bits: int = SLOT_BITS) -> Iterator[tuple[int, int, int, int, int]]:
    """Yield (slot, first rank, end rank, shard, place of the first rank in the shard).

    Each round, every node takes what waits at it, clockwise and as far as its shard has room; the rest goes on to the
    next node whose shard has room. A round fills a shard or is the last, so there are as many rounds as shards at most.
    """
    at = ring(shards, nodes, slot_bits)
    slots = [x[0] for x in at]
    room, used = capacities(sum(counts.values()), shards, epsilon), [0] * shards
    waiting: dict[int, list[Segment]] = {}
    for slot in sorted(counts):
        waiting.setdefault(bisect.bisect_left(slots, slot) % len(at), []).append((slot, 0, counts[slot]))
    while waiting:
        rest: dict[int, list[Segment]] = {}
        for node in sorted(waiting):
            shard = at[node][2]
            for slot, lo, hi in waiting[node]:
                end = min(hi, lo + room[shard])
                if end > lo:
                    yield slot, lo, end, shard, used[shard]
                    used[shard] += end - lo
                    room[shard] -= end - lo
                if end < hi:
                    rest.setdefault(node, []).append((slot, end, hi))
        waiting = {}
        for node, segments in rest.items():
            while not room[at[node][2]]:
                node = (node + 1) % len(at)
            waiting.setdefault(node, []).extend(segments)


def assign(rows: DataFrame, key: Column, order: list[str], shards: int, epsilon: float = 0.0, slot_bits: int = SLOT_BITS) -> DataFrame:
    """``rows`` (narrow: it is stored once) with ``shard`` and ``slot``, the row's place in its shard from 0."""
    spark = rows.sparkSession
    given = list(rows.columns)
    hashed = rows.withColumn("__h", F.xxhash64(key)).withColumn("__slot", F.shiftrightunsigned("__h", 64 - slot_bits).cast("int"))
    kept = stored(hashed.withColumn("__row", F.monotonically_increasing_id()), "ring")  # written: the salt is the same in every scan
    counts = {r[0]: r[1] for r in kept.groupBy("__slot").count().collect()}  # as many rows as slots at most
    usual = 1000 + 4 * sum(counts.values()) // max(1, len(counts))
    crowded = [s for s, n in counts.items() if n > usual]
    salt = F.when(F.col("__slot").isin(crowded), F.pmod("__row", F.lit(SALTS))) if crowded else F.lit(None).cast("long")
    kept = kept.withColumn("__salt", F.coalesce(salt, F.lit(0).cast("long")))
    inside = F.row_number().over(Window.partitionBy("__slot", "__salt").orderBy("__h", *order)).cast("long") - 1
    ranked = kept.withColumn("__rank", inside)
    if crowded:
        parts = kept.where(F.col("__slot").isin(crowded)).groupBy("__slot", "__salt").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("__slot").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.select("__slot", "__salt", F.coalesce(before, F.lit(0)).alias("__before"))
        ranked = ranked.join(F.broadcast(parts), ["__slot", "__salt"], "left")  # SALTS rows for each of the crowded slots, a quarter of all at most
        ranked = ranked.withColumn("__rank", F.col("__rank") + F.coalesce("__before", F.lit(0).cast("long")))
    pieces = list(fill(counts, shards, epsilon, slot_bits=slot_bits))
    table = spark.createDataFrame(pieces, "__slot int, __lo long, __hi long, shard int, __first long")
    inner = ["__slot"], (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi"))
    joined = ranked.alias("r").join(F.broadcast(table).alias("p"), (F.col("r.__slot") == F.col("p.__slot")) & inner[1])  # bounded by slots, nodes and shards
    return joined.select(*[F.col(f"r.`{c}`") for c in given], F.col("p.shard").alias("shard"), (F.col("__first") + F.col("__rank") - F.col("__lo")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int, epsilon: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(
        docs["doc_id"].alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return assign(rows, F.col("doc_id"), ["doc_id", "text_crc32", "size"], shards, epsilon)
