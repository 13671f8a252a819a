import math
from collections import Counter

import pytest
from llm_data import ODD

from tessera.llm import lm

TEXTS = [*ODD, *(" ".join(f"w{(k * j) % 17}" for j in range(1, 40)) for k in range(30)), "rare1 w1 rare2"]


def brute(texts):
    own = [(t or "").encode().split() for t in texts]
    total = sum(map(len, own))
    counts = Counter(w for ws in own for w in ws)
    unit = max(1, -(-total // lm.RAREST))
    name = lambda w: w if counts[w] >= unit else b"<rare>"
    own = [[name(w) for w in ws] for ws in own]
    one = Counter(w for ws in own for w in ws) + Counter({b"<s>": sum(map(bool, own))})
    two = Counter(p for ws in own for p in zip([b"<s>", *ws], ws, strict=False))
    out = []
    for ws in own:
        seen = [two[p] >= lm.SEEN for p in zip([b"<s>", *ws], ws, strict=False)]
        score = [math.log(two[p] / one[p[0]]) if s else math.log(lm.ALPHA * one[p[1]] / total) for p, s in zip(zip([b"<s>", *ws], ws, strict=False), seen, strict=True)]
        out.append((len(ws), sum(seen), sum(score) if ws else None))
    return out


@pytest.mark.parametrize(("part", "chunk", "rarest"), [(10**6, 4096, 10**6), (50, 7, 10**6), (300, 3, 2000)])
def test_scores_match_brute_force(make, monkeypatch, part, chunk, rarest):
    monkeypatch.setattr(lm, "PART", part)
    monkeypatch.setattr(lm, "CHUNK", chunk)
    monkeypatch.setattr(lm, "RAREST", rarest)
    texts = TEXTS if part > 100 else [t for t in TEXTS if not t or len(t) < 10_000]
    out = {r["doc_id"]: r for r in lm.score(make(texts)).collect()}
    assert len(out) == len(texts)
    for k, (n, seen, score) in enumerate(brute(texts)):
        assert (out[k]["n_words"], out[k]["n_seen"]) == (n, seen)
        assert out[k]["log_score"] == (None if score is None else pytest.approx(score))


def test_repeated_rows_and_empty_tables(make):
    docs = make(["a b", "a b", None], ids=[1, 1, None])
    rows = lm.score(docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"]) for r in rows) == [(0, 0), (1, 2), (1, 2)]
    assert lm.score(docs.where("false")).count() == 0


def test_rare_words_of_a_large_corpus_keep_their_counts(make):
    texts = [" ".join(f"w{(k * j) % 97}" for j in range(7_000)) for k in range(1, 301)] + ["rare1 w1 rare2", "rare3 w1 rare1"]
    total = sum(len(t.split()) for t in texts)
    counts = Counter(w for t in texts for w in t.split())
    out = {r["doc_id"]: r for r in lm.score(make(texts)).where("doc_id >= 300").collect()}
    two = Counter(p for t in texts for p in zip(t.split(), t.split()[1:]))
    for k in (300, 301):
        a, b, c = texts[k].split()
        assert total > 2_000_000 and two[a, b] == two[b, c] == 1 and out[k]["n_seen"] == 0
        assert out[k]["log_score"] == pytest.approx(sum(math.log(lm.ALPHA * counts[w] / total) for w in (a, b, c)))
