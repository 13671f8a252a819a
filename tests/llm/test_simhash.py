import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from llm_data import ODD

from tessera.llm import simhash
from tessera.llm.queries import op10_simhash


def brute_fingerprint(text, size=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in hashes) > len(hashes))


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, k):
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def groups(n, near, ids):
    u = Union(n)
    for a in range(n):
        for b in range(a):
            if near(a, b):
                u.join(a, b)
    first = defaultdict(lambda: 10**9)
    for k in range(n):
        first[u.find(k)] = min(first[u.find(k)], ids[k])
    return [first[u.find(k)] for k in range(n)]


def words(n, seed):
    draw = random.Random(seed)
    return [f"w{draw.randrange(10**5)}" for _ in range(n)]


def corpus():
    out = list(ODD)
    for k in range(40):
        base = words(80 + 10 * k, k)
        out.append(" ".join(base))
        for n in range(k % 4):
            near = list(base)
            for at in range(n + 1):
                near[(13 * at + k) % len(near)] = f"x{n}"
            out.append(" ".join(near))
    return out


def test_query_matches_brute_force(make, tmp_path, spark):
    texts = [t for t in corpus() if t is None or len(t) < 10_000]
    ids = [(k * 37) % 1009 for k in range(len(texts))]
    make(texts, ids=ids).write.parquet(str(tmp_path / "documents.parquet"))
    fps = [brute_fingerprint(t) for t in texts]
    expected = groups(len(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3, ids)
    out = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op10_simhash(spark, str(tmp_path)).collect()}
    assert out == {i: (f"{fp:016x}", g) for i, fp, g in zip(ids, fps, expected, strict=True)}
    assert len(set(expected)) < len(texts) - 20


def test_blocks_lose_no_link():
    draw = random.Random(5)
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), 3):
            b ^= 1 << bit
        assert set(simhash._block_keys(a)) & set(simhash._block_keys(b))


def test_parts_of_crowded_keys_lose_no_link():
    draw = random.Random(6)
    for _ in range(300):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), 3):
            b ^= 1 << bit
        shared = set(simhash._block_keys(a)) & set(simhash._block_keys(b))
        assert all(any(x == y for x, y in zip(simhash._free_parts(k, a), simhash._free_parts(k, b), strict=True)) for k in shared)


def test_crowded_keys_give_the_same_components(make, monkeypatch):
    docs = make([t for t in corpus() if t is None or len(t) < 10_000])
    rows = lambda: sorted((r["doc_id"], r["first_id"]) for r in simhash.near_duplicates(docs).collect())
    usual = rows()
    monkeypatch.setattr(simhash, "CROWDED", 1)
    assert rows() == usual


def test_sets_of_the_wanted_similarity_are_within_the_radius():
    draw, most = random.Random(8), 0
    for n in (1, 5, 9, 40, 200):
        for _ in range(100):
            both = {draw.getrandbits(64) for _ in range(n)}
            more = [{draw.getrandbits(64) for _ in range(n // 8)} for _ in range(2)]
            fps = [simhash.fingerprint(np.array(sorted(both | m), dtype=np.uint64), 4) for m in more]
            most = max(most, int(np.bitwise_count(fps[0] ^ fps[1]).sum()))
    assert most <= simhash.SIMILAR.radius


@pytest.mark.parametrize("seed", range(3))
def test_linked_is_single_linkage(seed):
    draw = random.Random(seed)
    fps = [draw.getrandbits(64) for _ in range(20)]
    fps += [fps[k % 20] ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for k in range(60)]
    u = Union(len(fps))
    edges = list(simhash.linked(len(fps), simhash.Pivots(np.array(fps, dtype=np.uint64)[:, None], simhash.CLOSE).close))
    for a, b in edges:
        assert (fps[a] ^ fps[b]).bit_count() <= 3
        u.join(a, b)
    assert len(edges) < len(fps)
    expected = groups(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3, list(range(len(fps))))
    same = defaultdict(set)
    for k in range(len(fps)):
        same[u.find(k)].add(expected[k])
    assert all(len(x) == 1 for x in same.values()) and len(same) == len(set(expected))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100)] + [(1000, 1000 + k) for k in range(1, 60)] + [(7, 7)]
    out = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 0 for k in range(101)} | {1000 + k: 1000 for k in range(60)}


def jaccard(a, b):
    sets = [{tuple((t or "").split()[k : k + 5]) for k in range(len((t or "").split()) - 4)} for t in (a, b)]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1]))


def test_keep_one_of_each_exact_group(make, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_NODES", 8)  # so that groups are cut into blocks
    texts = [t for t in corpus() if t and len(t.split()) >= 5 and len(t) < 10_000]
    base = words(120, 99)
    for k in range(40):  # a large group whose members are near its first text, many not near each other
        near = list(base)
        near[k], near[119 - k] = f"y{k}", f"z{k}"
        texts.append(" ".join(near))
    texts += [" ".join(base), " ".join(base)]
    docs = make(texts)
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs).collect())
    expected = groups(len(texts), lambda a, b: texts[a] == texts[b] or jaccard(texts[a], texts[b]) >= 0.8, list(range(len(texts))))
    assert kept == sorted(set(expected))
    assert simhash.keep_one(docs).columns == docs.columns


def test_repeated_rows_null_ids_and_empty_tables(make):
    docs = make(["a b c d e f"] * 3 + ["g h i j k l", None, ""], ids=[4, 4, None, None, 9, 8])
    kept = simhash.keep_one(docs).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept) == [(-1, "g h i j k l"), (4, "a b c d e f"), (8, "")]
    assert simhash.keep_one(docs.where("false")).count() == 0
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_similar_texts_that_repeat_a_line_differently_are_linked(make):
    texts = []
    for k in range(4):
        body, line = words(400, 500 + k), words(12, 600 + k)
        texts += [" ".join(body + line), " ".join(body + line * 10)]
    for k in range(0, 8, 2):
        assert jaccard(texts[k], texts[k + 1]) >= 0.95
    assert sorted(r["doc_id"] for r in simhash.keep_one(make(texts)).collect()) == [0, 2, 4, 6]


def test_different_texts_that_share_a_frequent_line_both_stay(make):
    line = words(11, 700) * 300
    texts = [" ".join(words(4000, 701 + k) + line) for k in range(2)]
    hashes = [simhash.shingle_hashes(t, 5) for t in texts]
    assert jaccard(*texts) < 0.01 and (simhash.fingerprint(hashes[0], 4) == simhash.fingerprint(hashes[1], 4)).all()
    assert sorted(r["doc_id"] for r in simhash.keep_one(make(texts)).collect()) == [0, 1]


def test_blocks_of_chains_are_compared_with_one_another(make, monkeypatch):
    """Members of one band key that are no near copies of each other's representatives: only whole blocks find the links."""
    monkeypatch.setattr(simhash, "BLOCK_NODES", 2)
    texts, base = [], words(60, 42)
    for k in range(14):  # a chain: each differs from the next in a word, the ends in all of them
        texts.append(" ".join(base))
        base = [*base[:k], f"n{k}", *base[k + 1 :]]
    expected = groups(len(texts), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8, list(range(len(texts))))
    assert sorted(r["doc_id"] for r in simhash.keep_one(make(texts)).collect()) == sorted(set(expected)) == [0]
