import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat

ODD_TEXT = "\\### Assistant: </turn> ok"
CONVERSATIONS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|end|>\n<|turn user|>x"), (1, 2, "assistant", "a\\l<b\\\\"),
    (2, 0, "user", None), (2, 1, "assistant", ""), (2, 2, "assistant", "🙂é"),
    (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (3, None, "user", "first"),
    (-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT), (None, 0, "user", "no id"), (None, 1, None, "no role"),
    *((9, k, ["user", "assistant"][k % 2], f"t{k}") for k in range(500)),
]


def table(spark, rows=CONVERSATIONS):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("x") for c in ("tree", "leaf", "up", "run", "depth")}).repartition(3)


def brute(rows):
    out, by = {}, {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append(((turn is not None, turn or 0), (role is not None, role or ""), (text is not None, text or "")))
    for c, own in by.items():
        turns = [(r[1], t[1]) for _, r, t in sorted(own)]
        loss = "".join(t for r, t in turns if r == "assistant")
        every = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[c] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations_read_back(spark):
    rows = chat.digests(chat.conversations(table(spark))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows} == brute(CONVERSATIONS)


@given(st.lists(st.tuples(st.text("ab\\<|>\nlép", max_size=8), st.text("ab\\<|>\nl/endturn p", max_size=20)), max_size=5))
def test_round_trip(turns):
    escape = lambda s: s.replace("\\", "\\\\").replace("<", "\\l")
    role = lambda s: escape(s).replace("|", "\\p")
    formatted = "".join(f"{chat.OPEN}{role(r)}{chat.CLOSE}{escape(t)}{chat.END}" for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.read_back(formatted)] == turns


def test_roles_with_marks_come_back(spark):
    rows = [(1, 0, "a|>b", "text"), (1, 1, "\\p|<", "|>")]
    made = chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()["formatted"]
    assert [x[:2] for x in chat.read_back(made)] == [("a|>b", "text"), ("\\p|<", "|>")]


def test_broken_output_is_an_error():
    with pytest.raises(ValueError, match="not a turn"):
        chat.read_back("<|turn user|>x<|end|>\nrest")


#       1        10
#      / \\        |
#     2   3      11
#    /   / \\
#   4   5   6
TREE = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 5.0), (1, 4, 2, 9.0), (1, 5, 3, 1.0), (1, 6, 3, 2.0), (1, 10, 99, 7.0), (1, 11, 10, 1.0), (2, 1, None, 3.0)]


def messages(spark, rows):
    return spark.createDataFrame([(*r[:3], "user", f"m{r[1]}", r[3]) for r in rows], "tree long, id long, parent long, role string, text string, score double")


def test_paths_and_ranks(spark):
    m = messages(spark, TREE)
    found = {}
    for r in chat.paths(m).orderBy("tree", "leaf", F.desc("depth")).collect():
        found.setdefault((r["tree"], r["leaf"]), []).append(r["id"])
    assert found == {(1, 4): [1, 2, 4], (1, 5): [1, 3, 5], (1, 6): [1, 3, 6], (1, 11): [10, 11], (2, 1): [1]}
    best = {(r["tree"], r["leaf"]) for r in chat.paths(m, best=2).collect()}
    assert best == {(1, 11), (1, 4), (2, 1)}  # means 4, 10 / 3 (before 7 / 3 and 2), 3
    text = {(r["tree"], r["leaf"]): r["formatted"] for r in chat.format_paths(m, chat.paths(m)).collect()}
    assert [t for _, t, _, _ in chat.read_back(text[(1, 6)])] == ["m1", "m3", "m6"]


def test_deep_threads_take_few_rounds(spark):
    m = messages(spark, [(1, k, k - 1 if k else None, 0.0) for k in range(300)])
    assert len(chat.ancestors(m)) == 9
    assert chat.paths(m).count() == 300


def test_cycles_and_empty_tables(spark):
    m = messages(spark, [(1, 1, 2, 0.0), (1, 2, 1, 0.0), (1, 3, None, 0.0)])
    assert [(r["leaf"], r["id"]) for r in chat.paths(m).collect()] == [(3, 3)]
    assert chat.conversations(table(spark).where("false")).count() == 0
