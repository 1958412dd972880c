"""A corpus from raw documents to packed sequences, five stages one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and hands the files to the next one. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lunario.llm import exact_dedup, langid, mixing, packing, simhash
from lunario.llm.common import stored_order, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough certainty; letterless ones go."""
    return langid.accepted(docs, langid.train(docs))


def unique_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    return exact_dedup.drop_duplicates(docs)


def unlike_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints chain together (three-word shingles, two bits)."""
    return simhash.one_of_each(docs)


def to_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights, in training order; a document may be there twice."""
    return mixing.mixture(docs)


def to_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and the sequences they lie in, which the column ``place`` puts in the
    training order of the mix."""
    return packing.packed(stored_order(docs), place="_place")


STAGES = [
    ("language id", known_language),
    ("exact dedup", unique_texts),
    ("near dedup", unlike_texts),
    ("mixing", to_mixture),
    ("packing", to_sequences),
]

#: Language scores, fingerprints and packing have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
