import re
from collections import Counter

from pyspark.sql import functions as F

from llm_data import ODD
from tessera.llm import quality


def brute(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


TEXTS = [*ODD, "a b c a b c a b c", "x y z\n\nx y z\n x y z", "#a * b\n#a * b\n<c>", "p q r s p q r t q r s", "word " * 60, " ".join(f"w{k}" for k in range(60))]


def test_measurements_match_brute_force(make):
    out = {r["doc_id"]: r.asDict() for r in quality.ledger(make(TEXTS)).collect()}
    for k, text in enumerate(TEXTS):
        expected = brute(text)
        assert {n: out[k][n] for n in expected} == expected, text and text[:40]


def test_policies_and_ledger_bits(make):
    entries = quality.apply_policy(quality.ledger(make(TEXTS)), quality.POLICIES["v2"])
    for r in entries.collect():
        failed = {n for n, rule in quality.RULES.items() if rule(r.asDict())}
        assert r["failures"] == sum(quality.BIT[n] for n in failed)
        assert r["kept"] == (not failed)


def test_keep_leaves_rows_and_columns(make):
    docs = make(TEXTS)
    kept = quality.keep(docs, quality.POLICIES["v1"])
    assert kept.columns == docs.columns
    expected = [k for k, t in enumerate(TEXTS) if (b := brute(t))["n_words"] >= 50 and 100 * b["n_repeat_words"] <= 50 * b["n_words"]]
    assert sorted(r["doc_id"] for r in kept.collect()) == expected


def test_ablations(make):
    policy = quality.POLICIES["v2"]
    entries = quality.ledger(make(TEXTS)).cache()
    rows = entries.collect()
    for r in quality.ablations(entries, policy).collect():
        bit = quality.BIT[r["rule"]]
        assert r["n_fail"] == sum(bool(x["failures"] & bit) for x in rows)
        assert r["n_rejected"] == sum(x["failures"] != 0 for x in rows)
        assert r["n_only_this"] == sum(x["failures"] == bit for x in rows)


def test_empty_table(make):
    docs = make(TEXTS).where("false")
    assert quality.ledger(docs).count() == 0
    assert quality.ablations(quality.ledger(docs), quality.POLICIES["v1"]).count() == 0


def test_no_shuffle(make):
    plan = quality.ledger(make(TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    assert quality.ledger(make(TEXTS)).where(F.col("failures") == 0).count() >= 1
