"""A corpus pipeline of five stages; each works on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents; the last returns the packed pieces. Each stage is a thin call of its
operator, whose module states the results for nulls, empty texts, ties, repeated rows and empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, packing, pii, quality, simhash
from tessera.llm.common import mark, release, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the second policy rejects go."""
    return quality.keep(docs, quality.POLICIES["v2"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of least id stays."""
    return simhash.keep_one(docs, simhash.SIMILAR)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; terms that give an entity away are generalised or removed beside it."""
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.Mix(docs).apply(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and place in it."""
    return packing.pack(packing.document_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), memory=100_000), packing.Limits())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("remove_personal_data", remove_personal_data),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Fingerprints, sampling keys and vocabularies are beyond SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder before the next one reads it.

    Tables that a stage used are deleted as soon as its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = mark()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        release(start, -1)
    return STAGES[-1][1](spark, docs, sf_dir)
