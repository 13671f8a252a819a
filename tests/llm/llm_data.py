"""Texts that every operator has to stand, and tables of them."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # columns of names that the operators use themselves
    T.StructField("size", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("node", T.StringType()),
    T.StructField("block", T.StringType()),
    T.StructField("shard", T.StringType()),
    T.StructField("failures", T.StringType()),
])


def rows(texts, sources=None):
    return [
        (k, t, "en", (sources or ["a", "b", None])[k % len(sources or [0, 0, 0])], None if t is None else len(t), *["x"] * 6) for k, t in enumerate(texts)
    ]

#: Nulls, empty and blank texts, a single word, repeated rows, odd characters, a very long text.
ODD = [None, "", " \n\t ", "one", "a b", "same words here again and again", "same words here again and again", "é ü 漢字 🙂 x", "w " * 40_000, "a\x0bb\x0cc d"]
