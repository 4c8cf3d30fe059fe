"""The training-data pipeline: rules, language, near copies, mix, tokens.

Every stage takes what its predecessor kept, and returns it with the columns of ``documents``; the last
returns the encoded documents. Stages carry extra columns along, whatever their names.

Cases, the same in every stage: rows with a null text or a text without words do not pass the rules, and rows without an id, source or
language are documents like others. Repeated rows pass the rules and the language test each; of rows that agree in id and text one
stays after the near copies. Ties are broken by id and text. Very long texts are read whole. Empty tables give empty results; without
labels the rules judge by length and repetition alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import byte_bpe, language_id, mixing, ngram_join, quality_rules
from rankloom.llm.storage import stash


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the model learns from the documents that are here."""
    return language_id.keep_identified(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that links connect."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that bring each source to its target."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and digests of the ids and of the text they decode to."""
    encoded, (n_tokens, ids_sha256, decoded_sha256, ids) = byte_bpe.encode_column(docs, with_ids=True)
    return encoded.selectExpr("doc_id", "lang", "source", f"`{n_tokens}` AS n_tokens", f"`{ids}` AS ids", f"`{ids_sha256}` AS ids_sha256", f"`{decoded_sha256}` AS decoded_sha256")


STAGES = [
    ("quality_rules", keep_good),
    ("language_id", keep_identified),
    ("ngram_join", keep_one_of_each),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Hashed counts, expectation-maximisation and byte-pair merges have no SQL form; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
