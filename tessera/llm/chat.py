"""Chat formatting of reply trees.

Messages point to their parents. Self-joins enumerate root-to-leaf paths: a table of ancestors 1, 2, 4, ... steps up is
joined with itself, so a thread of depth d takes log2(d) rounds, and every round is a table. Branches are ranked within
their tree by the mean score along the path, then each chosen path is expanded by the same tables and formatted as one
conversation, first in runs of turns, then as a whole.

Template: ``<|turn role|>text<|end|>\\n``. Inside roles and texts, ``\\`` is written ``\\\\`` and ``<`` is written ``\\l``, and
inside roles ``|`` is written ``\\p``, so a control string cannot occur in them and ``read_back`` restores every role and
text. The loss mask covers assistant texts.

Defined results: null texts and roles are empty; turns of equal number are ordered by role and text, null turns first;
repeated rows are turns of their own; messages whose parent is missing are roots; messages on a cycle are on no path;
an empty table gives no rows; very long texts are cells of one row, which is one conversation; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

OPEN, CLOSE, END = "<|turn ", "|>", "<|end|>\n"
RUN = 64


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("\\p"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "p": "|"}.get(m[1], m[1]), text, flags=re.DOTALL) if "\\" in text else text


_TURN = re.compile(r"<\|turn ([^<|]*)\|>([^<]*)<\|end\|>\n")


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text and the place of the escaped text of each turn; raises if the string is not what the template makes."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2]), *m.span(2)))
        at = m.end()
    return turns


def as_messages(turns: DataFrame) -> DataFrame:
    """Conversations by turn as reply chains: tree, id, parent, role, text, score.

    Places are counted in runs of turn numbers first, so a conversation with very many turns is not sorted in one task.
    """
    rows = turns.select(turns["conv_id"].alias("tree"), turns["turn"].cast("long").alias("turn"), turns["role"].alias("role"), turns["text"].alias("text"))
    rows = rows.withColumn("run", F.coalesce(F.floor(F.col("turn") / RUN), F.lit(-(2**62))).cast("long"))
    before = Window.partitionBy("tree").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("tree", "run").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("tree", "run").orderBy("turn", "role", "text")) - 1
    placed = rows.withColumn("inside", inside).alias("r").join(
        runs.alias("b"), F.col("r.tree").eqNullSafe(F.col("b.tree")) & (F.col("r.run") == F.col("b.run"))
    )
    id_ = (F.col("before") + F.col("inside")).cast("long")
    return placed.select("r.tree", id_.alias("id"), F.when(id_ > 0, id_ - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def ancestors(messages: DataFrame) -> list[DataFrame]:
    """Tables tree, id, up: the message 1, 2, 4, ... steps above, until no message has one."""
    links = messages.select("tree", "id", F.col("parent").alias("up"))
    known = messages.select(F.col("tree").alias("t"), F.col("id").alias("k"))
    step = stored(links.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("k"))).select("tree", "id", "up"), "up")
    tables, most = [], messages.count()
    while not step.isEmpty() and 2 ** len(tables) <= most:  # a cycle would go on for ever
        tables.append(step)
        upper = step.select(F.col("tree").alias("t"), F.col("id").alias("k"), F.col("up").alias("over"))
        step = stored(step.join(upper, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("k"))).select("tree", "id", F.col("over").alias("up")), "up")
    return tables


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """tree, leaf, id, depth (steps above the leaf) for the ``best`` branches of each tree by mean score, or all.

    Scores along a path are summed by doubling over (message, sum above it) before any path is written out.
    """
    tables = ancestors(messages)
    parents = messages.select(F.col("tree").alias("t"), F.col("parent").alias("k")).where("k is not null").distinct()
    leaves = messages.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("k")), "left_anti").select("tree", F.col("id").alias("leaf"))
    if best is not None:
        leaves = _ranked(messages, leaves, tables, best)
    found = stored(leaves.select("tree", "leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("depth")), "paths")
    for k, table in enumerate(tables):
        up = table.select(F.col("tree").alias("t"), F.col("id").alias("k"), "up")
        above = found.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("k")))
        found = stored(found.unionByName(above.select("tree", "leaf", F.col("up").alias("id"), (F.col("depth") + 2**k).alias("depth"))), "paths")
    return found


def _ranked(messages: DataFrame, leaves: DataFrame, tables: list[DataFrame], best: int) -> DataFrame:
    sums = messages.select("tree", "id", F.coalesce("score", F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("n"))
    for table in tables:
        up = table.select(F.col("tree").alias("t"), F.col("id").alias("k"), "up")
        reach = sums.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("k")), "left").drop("t", "k")
        over = sums.select(F.col("tree").alias("t"), F.col("id").alias("k"), F.col("total").alias("more"), F.col("n").alias("m"))
        reach = reach.join(over, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("k")), "left")
        more = [(F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("n") + F.coalesce("m", F.lit(0).cast("long"))).alias("n")]
        sums = stored(reach.select("tree", "id", *more), "scores")
    scored = leaves.join(sums.withColumnRenamed("tree", "t"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("id")))
    scored = scored.select("tree", "leaf", (F.col("total") / F.col("n")).alias("mean"))
    # The top of each tree is found among the tops of salted parts, so a tree with very many leaves is not one task.
    part = Window.partitionBy("tree", F.pmod(F.xxhash64("leaf"), F.lit(64))).orderBy(F.desc("mean"), "leaf")
    tops = scored.withColumn("r", F.row_number().over(part)).where(F.col("r") <= best)
    whole = Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")
    return tops.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= best).select("tree", "leaf")


def format_paths(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """tree, leaf, n_turns and ``formatted`` of each path. Runs of turns are joined first, then runs of one path."""
    turn = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(CLOSE), escape(F.col("text")), F.lit(END))
    made = messages.select(F.col("tree").alias("t"), F.col("id").alias("k"), turn.alias("turn"))
    lines = chosen.join(made, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("k"))).select("tree", "leaf", (-F.col("depth")).alias("at"), "turn")
    in_order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "turn"))), lambda s: s["turn"]), "")
    runs = lines.groupBy("tree", "leaf", F.floor(F.col("at") / RUN).alias("run")).agg(in_order.alias("turn"), F.count("*").alias("n"))
    joined = runs.withColumnRenamed("run", "at").groupBy("tree", "leaf").agg(in_order.alias("formatted"), F.sum("n").alias("n_turns"))
    return joined.select("tree", "leaf", "n_turns", "formatted")


def conversations(turns: DataFrame) -> DataFrame:
    """Tables of conversations by turn (conv_id, turn, role, text): one formatted row for each."""
    messages = stored(as_messages(turns), "messages")
    return format_paths(messages, paths(messages)).select(F.col("tree").alias("conv_id"), "n_turns", "formatted")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for tree, formatted in zip(batch.column(0), batch.column(1), strict=True):
            whole = formatted.as_py()
            turns = read_back(whole)
            every, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            for role, text, start, end in turns:
                every.update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    under_mask = unescape(whole[start:end])
                    loss.update(under_mask.encode())
                    chars += len(under_mask)
            rows.append((tree.as_py(), len(turns), every.hexdigest(), chars, loss.hexdigest(), len(whole)))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the output back gives: counts and hashes of turns and of the text under the loss mask."""
    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "formatted").mapInArrow(_digests, kinds)
