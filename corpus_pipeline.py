"""The training-data pipeline over ``documents``: rules, classifier, near-duplicates, repeated passages, packing.

Each stage takes the documents that its predecessor kept and, but for the last, returns the columns of ``documents``.
Null, empty or very long texts, repeated rows, missing labels and empty tables are handled as the operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm import importance, packing, quality, simhash, suffix_dedup
from tablewarden.llm.common import read, stored


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near a language reference."""
    return _columns(quality.judge(docs).where("kept"), docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects."""
    return _columns(importance.resample(docs, read(spark, sf_dir, "labels")).where("selected"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of texts whose five-word runs have a Jaccard similarity of 0.8 or more."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of 51 words and the 400-byte strings that occur more than once. A character that a cut leaves in part becomes
    U+FFFD; ``n_chars`` is that of the new text. Null texts stay null, and a text that loses everything is empty."""
    out = suffix_dedup.remove_repeats(docs, words=51)
    text = F.when(F.col("text").isNotNull(), F.make_valid_utf8(F.col("kept_bytes").cast("string")))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return _columns(out, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", pack),
]

#: The classifier, fingerprints and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
