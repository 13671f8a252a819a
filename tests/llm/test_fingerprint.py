import hashlib
import random
import re

import xxhash
from llm_data import ODD
from pyspark.sql import functions as F

from tessera.llm import fingerprint
from tessera.llm.queries import op8_fingerprints


def words(n, seed):
    draw = random.Random(seed)
    return [f"{draw.randrange(10**6):x}" for _ in range(n)]


def jaccard(a, b):
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_estimates_are_near_exact_jaccard(spark):
    base = words(600, 1)
    pairs = [(" ".join(base), " ".join(base[:n] + words(600 - n, n))) for n in range(0, 601, 40)]
    df = spark.createDataFrame(pairs, "a string, b string")
    made = df.select("a", "b", fingerprint.likeness(fingerprint.packed(F.col("a")), fingerprint.packed(F.col("b"))).alias("near"))
    errors = [abs(r["near"] - jaccard(r["a"], r["b"])) for r in made.collect()]
    assert max(errors) < 0.16 and sum(errors) / len(errors) < 0.05


def test_sparse_texts_are_densified(spark):
    base = words(40, 2)
    df = spark.createDataFrame([(" ".join(base), " ".join(base[:35] + words(5, 3)))], "a string, b string")
    fp = df.select(fingerprint.packed(F.col("a")).alias("a"), fingerprint.packed(F.col("b")).alias("b"))
    row = fp.select("a", fingerprint.likeness(F.col("a"), F.col("b")).alias("near")).first()
    assert len(row["a"]) == 16 and 0.5 < row["near"] < 1.0


def test_equal_texts_and_texts_without_words(make):
    out = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(make(ODD)).collect()}
    assert out[5] == out[6] and len(out[5]) == 16
    assert out[0] == out[1] == out[2] == []
    assert len(out[3]) == 16 and out[3] != out[4]


def edited(text, other):
    cut = len(text) // 4
    return text[: len(text) - cut] + other[:cut]


def brute(text):
    """The stored samples of a text, bin by bin: least hash of each, empty bins filled along their own probing order."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [w[k : k + 5] for k in range(len(w) - 4)] if len(w) >= 5 else [[" ".join(w)]] if w else []
    bins = {}
    for s in shingles:
        h = 42
        for word in s:
            h = xxhash.xxh64_intdigest(word.encode(), h)
        h -= (h >> 63) << 64
        bins[h >> 57] = min(bins.get(h >> 57, h), h)
    if not bins:
        return []
    draw = random.Random(42)
    starts, strides = [draw.randrange(128) for _ in range(128)], [2 * draw.randrange(64) + 1 for _ in range(128)]
    orders = ([b, *((starts[b] + strides[b] * t) % 128 for t in range(128))] for b in range(128))
    return [next(bins[j - 64] for j in order if j - 64 in bins) & 0xFF for order in orders]


def brute_text(samples):
    return "".join(f"{sum(v << 8 * k for k, v in enumerate(samples[q : q + 8])):016x}" for q in range(0, len(samples), 8))


def brute_likeness(a, b):
    if not a or not b:
        return float(a == b)
    share = sum(x == y for x, y in zip(a, b, strict=True)) / 128
    return max(0.0, (share - 1 / 256) / (1 - 1 / 256))


def check(rows, docs):
    """``rows`` of the query against every document, its edited text and its neighbour."""
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, tie(d[1])))
    expected = []
    for k, (i, text) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        new = edited(text, other)
        one, two, three = brute(text), brute(new), brute(other)
        expected.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), brute_text(one), brute_text(two), round(brute_likeness(one, two), 9), round(brute_likeness(one, three), 9)))
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")
    found = [(*(r[n] for n in names), round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows]
    by = lambda x: (x[0] is not None, *x[1:], x[0] or 0)
    assert sorted(found, key=by) == sorted(expected, key=by)


def tie(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - ((h >> 63) << 64)


def test_query_matches_brute_force(make, tmp_path, spark):
    texts = [*ODD, *(" ".join(words(50 + 7 * k, k)) for k in range(60))]
    ids = [7 * k + (k > 40) * 1000 for k in range(len(texts))]
    make(texts, ids=ids).write.parquet(str(tmp_path / "documents.parquet"))
    check(op8_fingerprints(spark, str(tmp_path)).collect(), [(i, t or "") for i, t in zip(ids, texts, strict=True)])


def test_any_ids_and_repeated_rows(make, tmp_path, spark, monkeypatch):
    """Ids of hashes, one far away, one very often, and equal rows."""
    monkeypatch.setattr(fingerprint, "_COPIES", 3)
    draw = random.Random(4)
    ids = [draw.getrandbits(64) - 2**63 for _ in range(30)] + [2**63 - 1, -(2**63), None, None, *range(20), *[5] * 40, *[77] * 11]
    texts = [" ".join(words(20 + k, k)) for k in range(len(ids) - 11)] + ["one text there often, one text there often"] * 11
    texts[31] = texts[33] = texts[32]
    make(texts, ids=ids).write.parquet(str(tmp_path / "documents.parquet"))
    check(op8_fingerprints(spark, str(tmp_path)).collect(), list(zip(ids, texts, strict=True)))


def test_empty_table(make):
    assert fingerprint.with_next(make(ODD).where("false")).count() == 0
