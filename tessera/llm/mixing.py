"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document draws an exponential key from a hash of itself, divided by its quality weight; within a source, ascending
keys are a weighted sample without replacement. A source first gives its complete epochs, then documents in key order
until its budget is met. Where the budget ends is found by prefix sums over ever finer ranges of the key's logarithm:
sixteenths of an octave, thousandths of the one in which it ends, and so on, whatever the weights are. What is left after
three levels is a 2**-24 part of an octave, and only its distinct documents are ordered: a hot source is never sorted.

Defined results: a null text has no words; a null source is a source, last in order; a document is taken if that comes
nearer to the target; equal keys are ordered by id and text; of rows equal in id and text as many are taken as come
nearest; documents whose weight is not positive come last; sources without words get nothing; an empty table gives no
rows; a very long text is one document like any other, however far it overshoots; other columns are not read by ``rows``
and are carried along by ``apply``. Draws depend on id, text and seed only, so reruns agree. The plan of targets has one
row a source and is made in one task: sources may be many, but not as many as documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD_SEPARATORS, let, stored

MOST_EPOCHS = 3
#: Bits of a key's place that each level of ranges looks at, after those above.
LEVELS = (20, 10, 0)
_OCTAVES, _STEPS = 512, 24  # logarithms from -512 to 512, in steps of 2**-24


def size_in_words(text: Column) -> Column:
    """Words of a text; splitting leaves one empty string at each end that has separators."""
    return let(
        F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS),
        lambda w: (F.size(w) - (F.element_at(w, 1) == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")).cast("long"),
    )


def quality_weight(text: Column) -> Column:
    """From 0.1 to 1: the share of lines that are not repetitions. The default weight; any positive column will do."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.greatest(F.lit(0.1), let(lines, lambda x: F.size(F.array_distinct(x)) / F.size(x)))


def sampling_key(weight: Column, seed: int) -> Column:
    """Exponential with rate ``weight``, drawn from id and text; infinite where the weight is not positive."""
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11)
    return F.when(weight > 0, -F.log((bits + 0.5) / F.lit(float(2**53))) / weight).otherwise(F.lit(float("inf")))


def _place(key: Column) -> Column:
    """A whole number that never falls as the key grows: its logarithm in steps."""
    octave = F.least(F.greatest(F.log2(key), F.lit(-float(_OCTAVES))), F.lit(_OCTAVES - 2.0**-_STEPS))
    return F.floor((octave + _OCTAVES) * F.lit(float(1 << _STEPS))).cast("long")


def _with_weights(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row a source: its target, the complete epochs in it and the rest. Windows run over sources, not documents."""
    by_name = Window.partitionBy("all").orderBy(F.asc_nulls_last("source"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    w = sizes.withColumn("all", F.lit(0)).withColumn("w", F.get(F.array(*[F.lit(float(x)) for x in weights]), turn))
    every = Window.partitionBy("all").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = MOST_EPOCHS * F.col("source_size")
    # Level L of the water: targets are min(most, L * w). Sources by the level at which they are full; the level holds
    # from the first source on that is not full at it; after that source the quotients fall, so the level is the greatest
    # that holds.
    by_full = Window.partitionBy("all").orderBy(most / F.col("w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    full, rest = F.coalesce(F.sum(most).over(by_full), F.lit(0)), F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_full), F.lit(0.0))
    level = w.withColumn("level", (F.sum("source_size").over(every) - full) / rest).withColumn("holds", F.col("level") <= most / F.col("w"))
    level = level.withColumn("level", F.max(F.when(F.col("holds"), F.col("level"))).over(every))
    target = F.when(F.col("level").isNull(), most.cast("double")).otherwise(F.least(most.cast("double"), F.col("level") * F.col("w")))
    out = level.select("source", "source_size", target.alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    return out.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))


def _on_source(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` and, under the names that only it has, the plan of their source."""
    other = plan.withColumnRenamed("source", "__plan_source")
    return rows.join(other, rows["source"].eqNullSafe(other["__plan_source"]), how).drop("__plan_source")


class Mix:
    """The decision for a table of documents: ``rows`` per document, and ``plan``, per source, to apply to texts.

    The plan has source, source_size, target, epochs, and ``last``: the document (key, doc_id, tie) at which the budget
    ends, of whose ``held`` equal rows ``some`` are taken. Documents before it are taken, those after it are not.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), weight: Column | None = None, seed: int = 42):
        self.weight, self.seed = weight, seed
        narrow = self._keyed(docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), docs["text"].alias("text")))
        narrow = narrow.withColumns({"place": _place(F.col("key")), "row": F.monotonically_increasing_id()})
        self.narrow = stored(narrow.drop("text"), "mix")
        sizes = self.narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
        plan = stored(_with_weights(sizes, weights), "targets")
        # rest: what is left of the budget at the start of the range; range: the upper bits of the places in it
        inside, ends = self.narrow, None
        for bits in LEVELS:
            by_range = inside.groupBy("source", F.shiftright("place", bits).alias("range")).agg(F.sum("size").alias("n"))
            budget = plan.select("source", "rest") if ends is None else ends.select("source", "rest")
            ends = stored(self._crossing(by_range, ["range"], budget), "ends")
            inside = _on_source(self.narrow, ends.select("source", "range")).where(F.shiftright("place", bits) == F.col("range")).drop("range")
        equal = inside.groupBy("source", "key", "doc_id", "tie").agg(F.sum("size").alias("n"), F.count("*").alias("held"))
        last = self._crossing(equal, ["key", "doc_id", "tie", "held"], ends.select("source", "rest"))
        some = F.floor(F.col("rest") * F.col("held") / F.col("n") + 0.5)  # n / held is the size of one
        last = last.select("source", F.struct("key", "doc_id", "tie").alias("last"), "held", some.alias("some"))
        self.plan = stored(_on_source(plan, last, "left"), "plan")

    @staticmethod
    def _crossing(sums: DataFrame, order: list[str], budget: DataFrame) -> DataFrame:
        """source, the columns of ``order``, n and rest: the first row whose running sum exceeds the budget, and what is left before it."""
        run = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = _on_source(sums.withColumn("upto", F.sum("n").over(run)), budget).where("upto > rest")
        first = upto.groupBy("source").agg(F.min(F.struct(*order, "n", "upto", "rest")).alias("e"))
        return first.select("source", *[f"e.{c}" for c in order], "e.n", (F.col("e.rest") - F.col("e.upto") + F.col("e.n")).alias("rest"))

    def _keyed(self, docs: DataFrame) -> DataFrame:
        weight = quality_weight(F.col("text")) if self.weight is None else self.weight
        return docs.withColumns({"size": size_in_words(F.col("text")), "key": sampling_key(weight, self.seed), "tie": F.xxhash64("text")})

    def _chosen(self, rows: DataFrame) -> DataFrame:
        """``rows`` with their plan and ``chosen``: null for the equal rows of which some are taken."""
        mine = F.struct("key", "doc_id", "tie")
        edge = F.when(F.col("some") <= 0, False).when(F.col("some") >= F.col("held"), True)
        chosen = F.when(F.col("last").isNull() | (mine > F.col("last")), False).when(mine < F.col("last"), True).otherwise(edge)
        return _on_source(rows, self.plan).withColumn("chosen", chosen)

    @staticmethod
    def _some(equal: DataFrame) -> DataFrame:
        """Rows on the edge, a stored table with a number ``row``: the first ``some`` of each source are chosen.

        They are counted by the task that wrote them, so equal rows, however many, are not numbered in one task.
        """
        part = F.shiftright("row", 33)
        before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = equal.groupBy("source", part.alias("part")).agg(F.count("*").alias("m"))
        parts = parts.select("source", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before"))
        inside = F.row_number().over(Window.partitionBy("source", "part").orderBy("row"))
        numbered = equal.withColumn("part", part).withColumn("inside", inside)
        other = parts.select(F.col("source").alias("s"), F.col("part").alias("p"), "before")
        joined = numbered.join(other, numbered["source"].eqNullSafe(other["s"]) & (numbered["part"] == other["p"]))
        return joined.withColumn("chosen", F.col("before") + F.col("inside") <= F.col("some")).drop("s", "p", "before", "part", "inside")

    def rows(self) -> DataFrame:
        """doc_id, source, size, key, tie, source_size, target, epochs, chosen, taken: one row per document."""
        rows = self._chosen(self.narrow)
        whole = rows.where("chosen is not null").unionByName(self._some(rows.where("chosen is null")))
        taken = F.col("size") * (F.col("epochs") + F.col("chosen").cast("int"))
        return whole.select("doc_id", "source", "size", "key", "tie", "source_size", "target", "epochs", "chosen", taken.alias("taken"))

    def apply(self, docs: DataFrame) -> DataFrame:
        """The mixed documents: each row as often as it is taken, columns unchanged. Texts are not shuffled."""
        whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
        keyed = self._keyed(whole.select("whole", F.col("whole.doc_id").alias("doc_id"), F.col("whole.source").alias("source"), F.col("whole.text").alias("text")))
        rows = self._chosen(keyed.drop("text"))
        copies = rows.where("chosen is not null").select("whole", "epochs", "chosen")
        if not self.plan.where("some > 0 and some < held").isEmpty():
            edge = rows.where("chosen is null").withColumn("row", F.monotonically_increasing_id())
            copies = copies.unionByName(self._some(stored(edge, "edge")).select("whole", "epochs", "chosen"))
        copies = copies.withColumn("copies", F.col("epochs") + F.col("chosen").cast("int")).where("copies > 0")
        return copies.select("whole", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")
