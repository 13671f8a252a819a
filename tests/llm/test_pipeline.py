"""Every stage on a small fixture against brute force, and stages on odd tables."""

import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from llm_data import ODD, SCHEMA, rows
from test_mixing import n_words, targets
from test_pii import brute as personal
from test_quality import brute as measured
from test_simhash import groups, jaccard
from tokenizers import Tokenizer

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    draw = random.Random(4)
    texts = list(ODD)
    for k in range(60):
        base = [f"w{draw.randrange(10**5)}" for _ in range(60 + k)]
        texts.append(" ".join(base))
        if k % 3 == 0:
            texts.append(" ".join(base[:-1] + ["end"]))
        if k % 7 == 0:
            texts.append(" ".join(base))
        if k % 5 == 0:
            texts.append(" ".join(base[: len(base) // 2] * 2))
        if k % 4 == 0:
            texts[-1] += f" mail user{k}@mail.example.com"
    return texts


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    spark.createDataFrame(rows(corpus()), SCHEMA).select(*COLUMNS).write.parquet(str(folder / "documents.parquet"))
    made, docs = {}, spark.read.parquet(str(folder / "documents.parquet"))
    made["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(folder))
        if name != "pack_sequences":
            assert out.columns == COLUMNS
        out.write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        made[name] = docs.collect()
    return made, str(folder)


def test_quality(run):
    made, _ = run

    def fails(t):
        m = measured(t)
        n = m["n_words"]
        return (
            n < 50 or 100 * m["n_repeat_words"] > 50 * n or m["word_chars"] < 2 * n or m["word_chars"] > 15 * n
            or 100 * m["n_symbols"] > 20 * n or 100 * m["n_dup_lines"] > 50 * m["n_lines"]
        )

    assert {r["doc_id"] for r in made["quality_rules"]} == {r["doc_id"] for r in made["documents"] if not fails(r["text"])}


def test_near_duplicates(run):
    made, _ = run
    rows = sorted(made["quality_rules"], key=lambda r: r["doc_id"])
    texts, ids = [r["text"] for r in rows], [r["doc_id"] for r in rows]
    expected = groups(len(rows), lambda a, b: texts[a] == texts[b] or jaccard(texts[a], texts[b]) >= 0.8, ids)
    assert sorted(r["doc_id"] for r in made["near_dedup"]) == sorted(set(expected))
    assert len(set(expected)) < len(rows)


def test_personal_data(run):
    made, _ = run
    before, after = ({r["doc_id"]: r["text"] for r in made[s]} for s in ("near_dedup", "remove_personal_data"))
    assert before.keys() == after.keys()
    for k, text in before.items():
        assert not any(personal(after[k]).values())
        expected = re.sub(r"user\d+@mail\.example\.com", "[EMAIL]", text)
        assert after[k] == expected


def test_mixing(run):
    made, _ = run
    before, after = made["remove_personal_data"], Counter(r["doc_id"] for r in made["mix_sources"])
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in before:
        n = n_words(r["text"])
        sizes[r["source"]] += n
        taken[r["source"]] += n * after[r["doc_id"]]
        most[r["source"]] = max(most[r["source"]], n)
        assert after[r["doc_id"]] <= 3
    for s, target in targets(sizes).items():
        assert abs(taken[s] - target) <= most[s]


def test_packing(run):
    made, _ = run
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = sum(len(tk.encode(r["text"], add_special_tokens=False).ids) + 1 for r in made["mix_sources"])
    fill = Counter()
    for r in made["pack_sequences"]:
        fill[r["sequence_id"]] += r["length"]
    assert sum(fill.values()) == wanted and max(fill.values()) <= 4096


def test_run_is_the_stages_in_turn(run, spark):
    made, folder = run
    out = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, out)) == Counter(map(key, made["pack_sequences"]))


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_tables(make, spark, name):
    docs = make(ODD, ids=[None, 1, 1, 2, 3, 4, 4, 5, 6, 7])
    out = STAGES[name](spark, docs, "")
    if name != "pack_sequences":
        assert out.columns == docs.columns
    out.collect()
    assert STAGES[name](spark, docs.where("false"), "").collect() == []
