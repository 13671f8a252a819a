import re
from collections import Counter, defaultdict

import pytest
from llm_data import ODD

from tessera.llm import mixing


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(1, 2, 3)):
    """Share all words by weight, stop at three times a source's size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        share = {s: (total - sum(out.values())) * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
            open_.discard(s)
    return out


TEXTS = [*ODD, *("x " * (5 + k % 40) for k in range(900))]
SOURCES = ["a", "b", None, "c", "c", "c", "c", "c", "c", "é", "d", "d"]


def test_targets_and_taken(make):
    rows = mixing.Mix(make(TEXTS, SOURCES)).rows().collect()
    assert len(rows) == len(TEXTS)
    sizes, taken, most = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == n_words(TEXTS[r["doc_id"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
    expected = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(expected[r["source"]])
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= most[s], s


def test_epochs_come_first_and_reruns_agree(make):
    docs = make(TEXTS[10:], SOURCES)
    a = {r["doc_id"]: (r["taken"], r["size"], r["source"], r["epochs"]) for r in mixing.Mix(docs).rows().collect()}
    b = {r["doc_id"]: (r["taken"], r["size"], r["source"], r["epochs"]) for r in mixing.Mix(docs.repartition(7)).rows().collect()}
    assert a == b
    for taken, size, _, epochs in a.values():
        assert taken in (epochs * size, (epochs + 1) * size)


def test_apply_repeats_rows_as_taken(make):
    docs = make(TEXTS[10:], SOURCES)
    mix = mixing.Mix(docs)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mix.rows().collect()}
    out = mix.apply(docs)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({k: n for k, n in taken.items() if n})


def test_weights_change_what_is_sampled(make, spark):
    from pyspark.sql import functions as F

    docs = make([f"{'good' if k % 2 else 'bad'} " * 10 for k in range(4000)], ["only"])
    weight = F.when(F.col("text").startswith("good"), F.lit(3.0)).otherwise(F.lit(1.0))
    rows = mixing.Mix(docs, weight=weight).rows()
    half = rows.orderBy("key").limit(1000).collect()
    assert 0.68 < sum(r["doc_id"] % 2 for r in half) / 1000 < 0.82  # 3 to 1


def test_odd_tables(make):
    assert mixing.Mix(make(TEXTS).where("false")).rows().count() == 0
    assert mixing.Mix(make([None, "", " "])).rows().count() == 3
    docs = make(["a b"] * 20, ["s"], ids=[1] * 20)
    mix = mixing.Mix(docs)
    assert mix.rows().count() == 20
    assert mix.apply(docs).count() == 20


def brute_taken(rows):
    """Words taken of each (source, document): complete epochs, then whole documents by ascending key up to the budget."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append(r)
    out = Counter()
    for source, own in by_source.items():
        left = own[0]["target"] - own[0]["epochs"] * own[0]["source_size"]
        for r in sorted(own, key=lambda r: (r["key"], r["doc_id"], r["tie"])):
            once = left is not None and r["size"] / 2 <= left and left > 0
            left = None if left is None or r["size"] > left else left - r["size"]
            out[source, r["doc_id"], r["tie"]] += r["size"] * (r["epochs"] + once)
    return +out


def taken_of(rows):
    out = Counter()
    for r in rows:
        out[r["source"], r["doc_id"], r["tie"]] += r["taken"]
    return +out


@pytest.mark.parametrize("scale", [0.01, 1.0, 100.0])
def test_documents_are_those_of_the_smallest_keys(make, scale):
    from pyspark.sql import functions as F

    texts = TEXTS + [f"w{k % 7} " * 9 for k in range(300)]
    ids = [*range(len(TEXTS)), *[10_000 + k % 7 for k in range(300)]]  # of the last ones many are equal rows
    docs = make(texts, SOURCES, ids=ids)
    weight = F.lit(scale) * F.when(F.length("text") % 3 == 0, F.lit(0.1)).otherwise(F.lit(1.0))
    mix = mixing.Mix(docs, weight=weight)
    rows = mix.rows().collect()
    assert len(rows) == len(texts) and taken_of(rows) == brute_taken(rows)
    assert Counter((r["source"], r["doc_id"]) for r in mix.apply(docs).collect() if n_words(r["text"])) == Counter(
        (r["source"], r["doc_id"]) for r in rows if r["size"] for _ in range(r["taken"] // r["size"])
    )


def test_of_equal_rows_as_many_are_taken_as_needed(make):
    """Two sources of weights 1 and 2 and one very often repeated row."""
    docs = make(["a b"] * 30 + ["c d e"] * 5 + ["f g"] * 5, ["s"] * 30 + ["t"] * 10, ids=[1] * 30 + [2] * 5 + [3] * 5)
    mix = mixing.Mix(docs)
    taken = Counter()
    for r in mix.rows().collect():
        taken[r["source"]] += r["taken"]
    words = Counter()
    for r in mix.apply(docs).collect():
        words[r["source"]] += n_words(r["text"])
    assert taken == words and abs(taken["s"] - 85 / 3) <= 1 and abs(taken["t"] - 170 / 3) <= 1.5


def test_weights_that_are_not_positive_come_last(make):
    from pyspark.sql import functions as F

    docs = make([f"word{k} " * 10 for k in range(90)], ["s"] * 45 + ["t"] * 45)
    weight = F.when(F.col("doc_id") % 3 == 0, F.lit(0.0)).when(F.col("doc_id") % 3 == 1, F.lit(None)).otherwise(F.lit(1.0))
    rows = [r for r in mixing.Mix(docs, weight=weight).rows().collect() if r["source"] == "s"]
    assert {r["doc_id"] % 3 for r in rows if r["taken"] > r["epochs"] * r["size"]} >= {2} and taken_of(rows) == brute_taken(rows)
