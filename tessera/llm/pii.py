"""Personal data: patterns, and terms that give protected entities away.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. Each found value is a protected entity.
Words within a few places of its mentions are candidate terms, numbers and short words too, without the punctuation around
them. Over the whole corpus, p(e|t) is the share of a term's occurrences that lie near the entity e: the probability with
which the term gives the entity away, and, over p(e), their mutual information. What is compared with the thresholds is
its lower confidence bound (Wilson), with as many observations as there are distinct surroundings of the entity, so copies
of one page count once and rare terms need more evidence. The bound does not depend on the size of the corpus, as a ratio
to the information of the entity would. Terms above one threshold are generalised, above a higher one removed, wherever
they stand in the documents that mention the entity; in other documents they stay.

Defined results: a null or empty text has no spans; repeated rows are treated one by one; an empty table gives no rows; a
very long text is searched in time linear in it; other columns, whatever their names, are not read by ``find`` and are
carried along by ``sanitise``.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import string
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import stored, words

KINDS = ("email", "ip", "card", "phone")
MOST_BROADCAST = 32 << 20  # bytes of told terms, as measured
Span = tuple[int, int]

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
# The part after "@", and the other kinds; possessive and anchored forms of the contract's patterns that match the same
# spans without trying every position inside a run of digits.
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")
_word = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Disclosure:
    """Words on each side of a mention, the two thresholds of p(e|t), and the normal quantile of the confidence bound (95 %).

    At these thresholds a term that stands nowhere else is generalised from two different surroundings on and removed from
    five on. One surrounding alone (bound 0.27) is no evidence: every rare word stands beside something once.
    """

    reach: int = 8
    generalise: float = 0.4
    remove: float = 0.6
    z: float = 1.645


def emails(text: str) -> list[Span]:
    """Linear in the text: a match ends its local part at an "@", so its start is the first local character before it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text: str) -> dict[str, list[Span]]:
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if _digit.search(text):
        found["ip"] = [m.span() for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _card.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        found["phone"] = [m.span() for m in _phone.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def _entity(kind: str, value: str) -> int:
    plain = value.lower() if kind == "email" else "".join(filter(str.isdigit, value)) if kind in ("card", "phone") else value
    return xxhash.xxh64_intdigest(f"{kind}:{plain}".encode(), 42) - (1 << 63)


def _merged(found: dict[str, list[Span]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, disjoint and in order."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted(x for spans in found.values() for x in spans):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return starts, ends


def open_words(text: str, found: dict[str, list[Span]]) -> list[tuple[int, int, str]]:
    """Start, end and term of the words that no span touches; the term is the word without the punctuation around it."""
    starts, ends = _merged(found)
    out = []
    for m in _word.finditer(text):
        a, b = m.span()
        k = bisect.bisect_right(ends, a)
        if k == len(ends) or starts[k] >= b:
            out.append((a, b, m[0].strip(string.punctuation)))
    return out


def _terms(text: str, found: dict[str, list[Span]], reach: int) -> Counter[tuple[int, int, str]]:
    """Candidate terms: how often each stands near an entity (entity, surroundings, term)."""
    out: Counter[tuple[int, int, str]] = Counter()
    if not any(found.values()):
        return out
    free = open_words(text, found)
    starts = [a for a, _, _ in free]
    for kind, spans in found.items():
        for s, e in spans:
            lo, hi = bisect.bisect_left(starts, s), bisect.bisect_left(starts, e)
            terms = [t for _, _, t in free[max(0, lo - reach) : hi + reach] if t]
            around = xxhash.xxh64_intdigest("\n".join(terms).encode(), 1) - (1 << 63)
            entity = _entity(kind, text[s:e])
            out.update((entity, around, t) for t in terms)
    return out


_FOUND = "doc_id long, tie long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, "
_FOUND += "entities array<long>, arounds array<long>, terms array<string>, times array<long>"


def _tie(text: str) -> int:
    tie = xxhash.xxh64_intdigest(text.encode(), 42)
    return tie - ((tie >> 63) << 64)


def _finder(reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = base_spans(text)
                base = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])
                sha = hashlib.sha256(base.encode()).hexdigest()
                terms = _terms(text, found, reach)
                near = [list(x) for x in zip(*terms, strict=True)] or [[], [], []]
                rows.append((doc.as_py(), _tie(text), *(len(found[k]) for k in KINDS), base, sha, *near, list(terms.values())))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 12
            longs = pa.list_(pa.int64())
            kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [longs, longs, pa.list_(pa.string()), longs]
            names = ["doc_id", "tie", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "entities", "arounds", "terms", "times"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def term_counts(docs: DataFrame) -> DataFrame:
    """term, n: occurrences over the whole corpus. Raw words are counted first, so stripping sees each of them once."""
    raw = docs.select(F.explode(words(docs["text"])).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return raw.groupBy(F.regexp_replace("w", r"^\p{Punct}+|\p{Punct}+$", "").alias("term")).agg(F.sum("n").alias("n"))


def decisions(candidates: DataFrame, counts: DataFrame, rule: Disclosure) -> DataFrame:
    """entity, term, disclosure and action of the pairs above a threshold. ``candidates``: entity, around, term, times."""
    each = candidates.groupBy("entity", "term", "around").agg(F.sum("times").alias("times"))
    pairs = each.groupBy("entity", "term").agg(F.count("*").alias("support"), F.sum("times").alias("together"))
    known = pairs.join(counts, "term", "left")
    share = F.col("together") / F.greatest("together", F.coalesce("n", F.lit(0)))
    z2 = rule.z**2
    seen = F.col("support") / F.col("share")  # distinct observations of the term
    spread = F.lit(rule.z) * F.sqrt(F.col("share") * (1 - F.col("share")) / seen + z2 / 4 / seen / seen)
    bound = (F.col("share") + z2 / 2 / seen - spread) / (1 + z2 / seen)
    scored = known.withColumn("share", share).withColumn("disclosure", bound).where(F.col("disclosure") >= rule.generalise)
    return scored.select("entity", "term", "disclosure", F.when(F.col("disclosure") >= rule.remove, "remove").otherwise("generalise").alias("action"))


def _searched(docs: DataFrame, rule: Disclosure) -> tuple[DataFrame, DataFrame]:
    """Base spans per row, and ``told``: doc_id, tie and the disclosed terms of the documents that have any."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    found = stored(rows.mapInArrow(_finder(rule.reach), _FOUND), "pii")
    near = F.explode(F.arrays_zip("entities", "arounds", "terms", "times")).alias("x")
    candidates = found.where(F.size("terms") > 0).select("doc_id", "tie", near)
    candidates = candidates.select("doc_id", "tie", F.col("x.entities").alias("entity"), F.col("x.arounds").alias("around"), F.col("x.terms").alias("term"), "x.times")
    chosen = stored(decisions(candidates, stored(term_counts(rows), "terms"), rule).select("entity", "term", "action"), "chosen")
    hits = candidates.join(chosen, ["entity", "term"]).groupBy("doc_id", "tie", "term").agg(F.max("action").alias("action"))  # "remove" is the greater
    told = hits.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("term", "action")).alias("told"))  # terms of one document
    return found, stored(told, "told")


def _beside(rows: DataFrame, told: DataFrame, how: str) -> DataFrame:
    """``rows`` (a struct ``row``) with the terms told of them. A list of bounded bytes goes to every task, else rows are shuffled."""
    size = told.agg(F.sum(F.aggregate("told", F.lit(64).cast("long"), lambda n, x: n + F.length(x["term"]) + 48))).first()[0] or 0
    other = told.select(F.col("doc_id").alias("i"), F.col("tie").alias("t"), "told")
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("i")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("t"))
    return rows.join(F.broadcast(other) if size <= MOST_BROADCAST else other, same, how).select("row", "told")


def term_spans(text: str, told: list[dict]) -> list[tuple[int, int, str]]:
    """Start, end and action of every occurrence of the told terms outside of base spans."""
    actions = {x["term"]: x["action"] for x in told}
    out = []
    for a, b, term in open_words(text, base_spans(text)):
        if term in actions:
            at = a + text[a:b].index(term)
            out.append((at, at + len(term), actions[term]))
    return out


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, told in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            text = text.as_py() or ""
            rows.append((doc, _tie(text), [{"start": a, "stop": b, "action": x} for a, b, x in term_spans(text, told.as_py())]))
        doc, tie, extra = zip(*rows, strict=True) if rows else ((), (), ())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("action", pa.string())]))
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tie, pa.int64()), pa.array(extra, kind)], ["doc_id", "tie", "extra"])


def find(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """One row per document: counts, base spans as text, and ``extra``, the disclosed terms (start, stop, action) in order."""
    found, told = _searched(docs, rule)
    rows = docs.select(F.struct(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).alias("row"))
    beside = _beside(rows, told, "inner").select("row.doc_id", "row.text", "told")
    kind = "doc_id long, tie long, extra array<struct<start:long,stop:long,action:string>>"
    extra = stored(beside.mapInArrow(_locate, kind), "extra").groupBy("doc_id", "tie").agg(F.first("extra").alias("extra"))
    extra = extra.select(F.col("doc_id").alias("i"), F.col("tie").alias("t"), "extra")
    base = found.drop("entities", "arounds", "terms", "times")
    return base.join(extra, base["doc_id"].eqNullSafe(extra["i"]) & (base["tie"] == extra["t"]), "left").drop("i", "t")


def _shape(term: str) -> str:
    return "[CODE]" if _digit.search(term) else "[NAME]" if term[0].isupper() else "[TERM]"


def rewritten(text: str | None, told: list[dict] | None) -> str | None:
    """The text with base spans replaced by their kind and told terms by a tag or nothing."""
    if not text:
        return text
    spans = [(a, b, f"[{k.upper()}]") for k, found in base_spans(text).items() for a, b in found]
    if told:
        spans += [(a, b, "" if action == "remove" else _shape(text[a:b])) for a, b, action in term_spans(text, told)]
    out, at = [], 0
    for a, b, tag in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], tag]
        at = max(at, b)
    return "".join([*out, text[at:]]) if spans else text


def _rewriter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = batch.column(0)
        texts = [rewritten(t.as_py(), x.as_py()) for t, x in zip(row.field("text"), batch.column(1), strict=True)]
        sizes = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([row, pa.array(texts, pa.string()), sizes], ["row", "text", "n"])


def sanitise(docs: DataFrame, rule: Disclosure = Disclosure()) -> DataFrame:
    """The documents with every span replaced by its kind and disclosed terms generalised or removed; n_chars follows."""
    _, told = _searched(docs, rule)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n", T.LongType())])
    made = _beside(rows, told, "left").mapInArrow(_rewriter, kind)
    new = {"text": F.col("text"), "n_chars": F.col("n")}
    return made.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
