import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import ODD
from tokenizers import Tokenizer

from tessera.llm import packing, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [*ODD, "it's  we'll\n\n\tx", "<|endoftext|> a<|endoftext|>b", "Größe, ÉTÉ! naïve... ΑΣ İstanbul 12 345", "ab " * 9000 + "z", "x" * 3000, "  nbsp em", "a\n b \n", "don't 'll s's"]


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(WORDS)


def test_token_counts(make, byte_bpe):
    out = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(make(TEXTS), BYTES).collect()}
    for k, t in enumerate(TEXTS):
        assert out[k] == (len((t or "").encode()), len(byte_bpe.encode(t or "", add_special_tokens=False)))
    assert tokens.count_tokens(make(TEXTS).where("false"), BYTES).count() == 0


_chars = st.text(st.sampled_from("ab 'Zé\n\t.,!ß1漢 Σσς<|>"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(_chars)
def test_pieces_are_safe(text):
    tk = tokens._tokenizer(BYTES)
    parts = tokens.pieces(text)
    assert "".join(parts) == text
    assert sum(len(tk.encode(p, add_special_tokens=False)) for p in parts) == len(tk.encode(text, add_special_tokens=False))


@settings(max_examples=150, deadline=None)
@given(_chars)
def test_ids_of_words_are_ids_of_the_text(text):
    ids = packing._ids(WORDS, packing.MEMORY)
    expected = ids.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids.of([text])[0], dtype="<u4").tolist() == expected
    assert np.frombuffer(ids.of([text])[0], dtype="<u4").tolist() == expected  # from memory


def test_batches_are_of_bounded_bytes():
    made = list(tokens.by_bytes(["x" * 100] * 50 + ["y" * 10_000], limit=2000))
    assert sum(map(len, made)) == 51 and all(len(b) <= 5 for b in made) and made[-1] == ["y" * 10_000]


def test_pieces_and_packing(make, word_bpe):
    rows = packing.pack(packing.document_pieces(make(TEXTS), WORDS, most=512), packing.Limits(tokens=512, segments=8, loss=512)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for k, t in enumerate(TEXTS):
        ids = np.array([*word_bpe.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512 and len(own) <= 8 and sum(r["loss"] for r in own) <= 512


def test_all_limits_hold_at_once():
    draw = np.random.default_rng(3)
    demands = np.stack([draw.integers(1, 400, 3000), np.ones(3000, dtype=int), draw.integers(0, 200, 3000)], axis=1)
    limits = np.array([2048, 12, 700])
    made = packing.place(demands, limits)
    assert sorted(x for own in made for x in own) == list(range(3000))
    sums = np.array([demands[own].sum(axis=0) for own in made])
    assert (sums <= limits).all()
    least = (demands.sum(axis=0) / limits).max()
    assert len(made) <= 1.06 * least + 2
    with pytest.raises(ValueError, match="beyond the limits"):
        packing.place(np.array([[5000, 1, 0]]), limits)


def test_other_columns_and_empty_tables(spark, make):
    rows = spark.createDataFrame([(5, 3, "a", None), (6, 6, "b", 1)], "length long, loss long, block string, place int")
    out = packing.pack(rows, packing.Limits())
    assert out.columns == ["length", "loss", "block", "place", "sequence_id", "offset"] and out.count() == 2
    assert packing.pack(rows.where("false"), packing.Limits()).count() == 0
    assert packing.pack(packing.document_pieces(make(TEXTS).where("false"), WORDS), packing.Limits()).count() == 0
    assert pa.array([1]).to_pylist() == [1]


_long = st.lists(st.sampled_from(["a", "bc", "É", "漢字", "。", "，", ".", ",", "'s", "<|endoftext|>", " ", "\n", "\t", "\r\n", "1", "!", "🙂", "_", "Σ", "|", ">", "　"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(_long)
def test_long_pieces_are_cut_where_nothing_reaches_across(text):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(tokens, "LONG", 8)
        m.setattr(packing, "LONG", 8)
        one, many = tokens._tokenizer(BYTES), packing._ids(WORDS, packing.MEMORY)
        assert "".join(tokens.pieces(text)) == text
        assert sum(len(one.encode(p, add_special_tokens=False)) for p in tokens.pieces(text)) == len(one.encode(text, add_special_tokens=False))
        assert np.frombuffer(many.of([text])[0], dtype="<u4").tolist() == many.tokenizer.encode(text, add_special_tokens=False).ids
