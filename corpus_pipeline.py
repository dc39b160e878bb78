"""Corpus pipeline: five of the operators applied in turn to ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlake.llm import bpe, decontam, langid, quality, queries, simhash
from chatlake.llm.common import staged, table

#: Posterior that a text's language must reach.
LEAST_LANGUAGE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the top grade is high enough; the classifier is fitted to ``labels``."""
    return quality.keep_good(docs, queries.quality_model(spark, sf_dir, docs))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learned languages: one stands out, and its letters cost about what they cost in that language."""
    return langid.keep_known(docs, queries.language_model(docs, bounded=True), LEAST_LANGUAGE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints are linked: the one of the least id."""
    return simhash.keep_one(docs, words=4, bits=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``benchmark``."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text) of what is left; the text is decoded from the ids."""
    ids = bpe.encode_documents(docs, queries.word_vocabulary(), decoded=True)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: Neither a fitted classifier nor a fingerprint or tokenizer is in SQL.  Tests hold the last three stages against brute-force
#: versions; the first two against their operators, whose fits and code lengths have brute-force tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each on all that the one before kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage{k}")
    return docs
