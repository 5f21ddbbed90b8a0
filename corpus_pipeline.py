"""A training corpus from raw documents: classify, filter, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. Between stages the rows are written as Parquet and read again; a stage's
input and what it wrote for itself are removed once its output is there.

Stages handle rows as their operators do: a null text counts as an empty one, null ids stay, repeated
rows are judged alike, very long texts are used whole, other columns pass through whatever their names,
and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import mixing, packing, quality_classifier, quality_rules, simhash
from keyloom.llm.common import new_path, remove, removing, table
from keyloom.llm.token_counts import vocabulary_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels among them, accepts.

    Null and empty texts get the model's bias; without labels of both kinds all scores are the share of good ones.
    """
    model = quality_classifier.trained_model(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null, empty and other texts below 50 words go."""
    return quality_rules.keep_good(docs, quality_rules.references(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest id; of repeated ids one row by text and columns."""
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the production mixture of sources, languages and topics.

    Null sources and languages are categories of their own; texts without tokens go.
    """
    return mixing.sample_mix(docs, mixing.dimensions(), mixing.production_tokens()(F.col("text")), mixing.PRODUCTION)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; an empty text is its end id alone."""
    return packing.pack(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("simhash near-dedup", deduplicate),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]

#: Training, hashing and tokenising are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"stage{k}")
        with removing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    # the result reads the last tables when it is used
    return STAGES[-1][1](spark, docs, sf_dir)
