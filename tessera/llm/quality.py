"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document. The ledger, a stored table, keeps the measurements and one bit per failed rule,
so a policy is a mask: applying it, comparing versions and ablating single rules are bitwise operations that never touch a
text again.

Defined results: a null or empty text has no words and all counts are 0; repeated rows are judged one by one; an empty
table gives an empty ledger; a very long text is one row, n log n in its words; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, stored, words

WINDOW = 3


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, the first occurrence included.

    Windows are compared by their 64-bit hash: sort (hash, position), keep positions whose neighbour has the same hash,
    and add up the lengths of the union of those windows. n log n in the words of the text.
    """
    windows = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")),
        )
    )

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    return F.when(F.size(w) >= WINDOW, let(windows, repeated)).otherwise(F.lit(0))


def measurements(text: Column) -> Column:
    """A struct with everything that the rules look at; each part of the text is scanned once."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    of_words = let(
        words(text),
        lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("c"), _repeat_words(w).alias("r")),
    )
    n_symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l"), n_symbols.alias("s")),
        lambda m: F.struct(
            m["w"]["n"].cast("long").alias("n_words"),
            m["w"]["c"].cast("long").alias("word_chars"),
            m["s"].cast("long").alias("n_symbols"),
            m["l"]["n"].cast("long").alias("n_lines"),
            m["l"]["d"].cast("long").alias("n_dup_lines"),
            m["w"]["r"].cast("long").alias("n_repeat_words"),
        ),
    )


#: Bit k of the ledger is set where RULES[k] holds, i.e. where the document fails it. Append only: bits keep their meaning.
RULES = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 15 * m["n_words"],
    "symbols": lambda m: 100 * m["n_symbols"] > 20 * m["n_words"],
    "repeated_lines": lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"],
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the decision: the rules that reject, and how many of them must fail."""

    name: str
    rules: tuple[str, ...]
    at_least: int = 1

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)

    def rejects(self, failures: Column) -> Column:
        return F.bit_count(failures.bitwiseAND(F.lit(self.mask))) >= self.at_least


POLICIES = {
    "v1": Policy("v1", ("few_words", "repeated_windows")),
    "v2": Policy("v2", tuple(RULES)),
}


def _failures(m: Column) -> Column:
    bits = F.lit(0).cast("long")
    for name, rule in RULES.items():
        bits = bits.bitwiseOR(F.when(rule(m), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return bits


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the measurements and ``failures``, the bits of all rules. A narrow map, no shuffle."""
    entry = let(measurements(F.col("text")), lambda m: F.struct(m.alias("m"), _failures(m).alias("failures")))
    made = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).select("doc_id", entry.alias("e"))
    return made.select(F.col("doc_id").alias(id_col), "e.m.*", "e.failures")


def stored_ledger(docs: DataFrame) -> DataFrame:
    """The ledger written once: what policies, their versions and ablations are derived from."""
    return stored(ledger(docs), "ledger")


def only_rule(failures: Column, policy: Policy) -> Column:
    """The ablation of one document: the rule without which the policy would keep it; null if there is no such rule."""
    failed = failures.bitwiseAND(F.lit(policy.mask))
    alone = [F.when(failed.bitwiseAND(F.lit(BIT[r])) != 0, F.lit(r)) for r in policy.rules]
    return F.when(F.bit_count(failed) == policy.at_least, F.coalesce(*alone) if policy.at_least == 1 else F.lit(None))


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with ``kept``: false where the policy rejects."""
    return entries.withColumn("kept", ~policy.rejects(F.col("failures")))


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, that the policy rejects, and that only this rule keeps out.

    Failure patterns are counted first (2 ** rules at most), so what follows is of constant size.
    """
    patterns = entries.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("p")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules]))
    rejected = policy.rejects(F.col("p"))
    without = F.bit_count(F.col("p").bitwiseAND(F.bitwise_not(F.col("r.bit")))) >= policy.at_least
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0).cast("long"))
    return (
        patterns.select("p", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            total(F.col("p").bitwiseAND(F.col("r.bit")) != 0).alias("n_fail"),
            total(rejected).alias("n_rejected"),
            total(rejected & ~without).alias("n_only_this"),
            F.bit_or("p").alias("patterns_seen"),
        )
    )


def keep(docs: DataFrame, policy: Policy, text_col: str = "text") -> DataFrame:
    """The rows that the policy keeps, with their columns unchanged."""
    return docs.where(~policy.rejects(let(measurements(docs[text_col]), _failures)))
