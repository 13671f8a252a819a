import hashlib
import math
import re
import string
import time
from collections import Counter, defaultdict

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import ODD

from tessera.llm import pii
from tessera.llm.queries import op5_pii, pii_sql

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out[kind].append(m.span())
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("a1.@+-_ 0()%é2"), max_size=40))
def test_base_spans_are_those_of_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


def brute_terms(texts, reach=8, threshold=0.4, z=1.645):
    """Spans of disclosed terms of each text, by plain counting."""
    strip = lambda w: w.strip(string.punctuation)
    counts, near, around, free = Counter(), Counter(), defaultdict(set), []
    for text in texts:
        text = text or ""
        spans = [(kind, *s) for kind, found in brute(text).items() for s in found]
        counts.update(strip(m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text))
        open_ = [m for m in re.finditer(r"[^\x20\x09-\x0D]+", text) if not any(s < m.end() and m.start() < e for _, s, e in spans)]
        free.append(([(kind, entity(kind, text[s:e])) for kind, s, e in spans], open_))
        for kind, s, e in spans:
            terms = [strip(m[0]) for m in [m for m in open_ if m.start() < s][-reach:] + [m for m in open_ if m.start() >= e][:reach]]
            for t in filter(None, terms):
                near[entity(kind, text[s:e]), t] += 1
                around[entity(kind, text[s:e]), t].add(tuple(filter(None, terms)))

    def bound(e, t):
        share = near[e, t] / max(near[e, t], counts[t])
        n = len(around[e, t]) / share
        return (share + z * z / 2 / n - z * math.sqrt(share * (1 - share) / n + z * z / 4 / n / n)) / (1 + z * z / n)

    told = {(e, t) for e, t in near if bound(e, t) >= threshold}
    return [
        [(m.start() + m[0].index(strip(m[0])), m.start() + m[0].index(strip(m[0])) + len(strip(m[0]))) for m in open_ if any((e, strip(m[0])) in told for _, e in entities)]
        for entities, open_ in free
    ]


def entity(kind, value):
    return kind, value.lower() if kind == "email" else "".join(filter(str.isdigit, value)) if kind in ("card", "phone") else value


CARD = "4532 0151 1283 0366"
TEXTS = [*ODD, f"é🙂 mail a.b@c.de, ip 10.0.0.1 and 1.2.3.999 card {CARD} tel +47 (22) 33-44-55", "a@b.c@d.e.f x@y", "4532015112830366" * 2, "+1 2", "@" * 500 + "a" * 5000 + "@b", "write Jane at jane@c.de now, Jane", "ask (Jane) jane@c.de then", "ask then at once now", "Jane 4711 jane@c.de", "4711 jane@c.de"]


def test_query(make, tmp_path, spark):
    make(TEXTS).write.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: r for r in op5_pii(spark, str(tmp_path)).collect()}
    terms = brute_terms(TEXTS)
    for k, text in enumerate(TEXTS):
        found = brute(text)
        base = ",".join(f"{kind}:{a}:{b}" for kind in PATTERNS for a, b in found[kind])
        r = out[k]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(map(len, found.values()))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert r["spans"] == ",".join(filter(None, [base, *(f"term:{a}:{b}" for a, b in terms[k])]))
    assert sum(map(len, terms)) > 3


def give_away():
    """An entity whose name stands beside it in three different surroundings, among common words."""
    near = [f"we saw Jane Roe jroe@mail.example {x} yesterday" for x in ("alpha", "beta", "gamma")]
    rest = [f"people we saw yesterday {k} with the usual words of text number {k}" for k in range(400)]
    return near + ["Jane Roe writes elsewhere without address"] + rest


def test_sql_says_the_same(make, tmp_path, spark):
    for n, texts in enumerate((TEXTS, give_away() * 2, [f"{w} {x}@c.de {w}" for w in ("", "Jane,", "(Bo)", "--", "4711") for x in ("a", "b", "A") for _ in range(3)])):
        folder = tmp_path / str(n)
        make(texts).write.parquet(str(folder / "documents.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
        expected = con.execute(pii_sql()).fetchall()
        assert sorted(map(tuple, op5_pii(spark, str(folder)).collect())) == sorted(expected)
        assert n > 0 or any("term:" in r[-1] for r in expected)


def test_terms_that_reveal_an_entity(make):
    texts = give_away()
    out = {r["doc_id"]: r["extra"] for r in pii.find(make(texts), pii.Disclosure(generalise=0.35, remove=0.9)).collect()}
    for k in range(3):
        assert {texts[k][x["start"] : x["stop"]] for x in out[k]} == {"Jane", "Roe"}
    assert all(out[k] is None for k in range(3, len(texts)))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(make(texts), pii.Disclosure(generalise=0.35, remove=0.9)).collect()}
    assert clean[0] == "we saw [NAME] [NAME] [EMAIL] alpha yesterday"
    assert all(clean[k] == texts[k] for k in range(3, len(texts)))
    removed = {r["doc_id"]: r["text"] for r in pii.sanitise(make(texts), pii.Disclosure(generalise=0.3, remove=0.35)).collect()}
    assert "Jane" not in removed[0] and "[NAME]" not in removed[0]


def test_copies_are_one_piece_of_evidence(make):
    texts = [give_away()[0]] * 10 + give_away()[4:]
    assert all(r["extra"] is None for r in pii.find(make(texts), pii.Disclosure(generalise=0.35)).collect())


def test_sanitise_keeps_columns_and_follows_lengths(make):
    docs = make([*TEXTS, *["é🙂 mail ip and 1.2.3.999 card tel"] * 3])  # words that stand elsewhere as well
    out = pii.sanitise(docs)
    assert out.schema == docs.schema
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[len(ODD)]["text"] == "é🙂 mail [EMAIL], ip [IP] and 1.2.3.999 card [CARD] tel [PHONE]"
    for k, r in rows.items():
        if k >= len(TEXTS):
            continue
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        if not any(brute(TEXTS[k]).values()):
            assert r["text"] == TEXTS[k]
    assert pii.sanitise(docs.where("false")).count() == 0
    assert pii.sanitise(make([TEXTS[len(ODD)]] * 3, ids=[None, 1, 1])).count() == 3


def test_numbers_and_short_names_reveal_an_entity(make):
    near = [f"we saw 84711 Bo jroe@mail.example {x} yesterday" for x in ("alpha", "beta", "gamma")]
    texts = near + give_away()[4:]
    out = {r["doc_id"]: r["extra"] for r in pii.find(make(texts), pii.Disclosure(generalise=0.35, remove=0.9)).collect()}
    for k in range(3):
        assert {texts[k][x["start"] : x["stop"]] for x in out[k]} == {"84711", "Bo"}
    assert all(out[k] is None for k in range(3, len(texts)))


def test_disclosed_terms_go_from_the_whole_document(make):
    texts = [*give_away(), "Jane Roe jroe@mail.example " + "we saw people yesterday " * 20 + "Roe"]
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(make(texts), pii.Disclosure(generalise=0.3, remove=0.9)).collect()}
    assert out[len(texts) - 1].endswith("yesterday [NAME]") and out[3] == texts[3]


def test_many_mentions_in_one_text_and_columns_of_any_name(spark):
    text = " ".join(f"name{k} u{k}@mail.example" for k in range(40_000))
    began = time.monotonic()
    found = pii.base_spans(text)
    assert len(found["email"]) == 40_000 and len(pii._terms(text, found, 8)) > 40_000
    assert time.monotonic() - began < 20
    docs = spark.createDataFrame([(1, "a b@c.de x", "p", "q", "r", "s")], "doc_id long, text string, __id string, __tie string, row string, told string")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.first()["__id"] == "p" and out.first()["text"].count("[EMAIL]") == 1
