"""The corpus pipeline: documents through five of the training-data operators, one stage after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateview.llm import langid, mixing, near, pii, sentencepieces
from lateview.sources.shared import discard, write_shared


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without any letter, null and empty texts go.

    A null lang becomes the prediction. Null ids, repeated rows and further columns stay; very long texts are parsed whole; without
    labelled documents all texts with a letter stay; an empty table gives no rows.
    """
    parser = langid.train(docs.where(~langid.held_out()).select("doc_id", "text", "lang"))
    return langid.keep_identified(docs, parser)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal, or share 80 % of their five-word shingles: that of the smallest id.

    Null texts are equal to each other, as are empty ones; null ids count as larger than any; of repeated rows one stays; further columns,
    whatever their names, pass through; an empty table gives no rows.
    """
    return near.drop_near_duplicates(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars, where there is one, follows.

    No document goes. Null and empty texts, null ids, repeated rows and further columns stay as they are; an empty table gives no rows.
    """
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, under weights 3, 1, 2 for 150 % of all words.

    Null is a source of its own; null texts and texts without words have size 0; rows with equal or null ids stand or fall together; further
    columns pass through; an empty table gives no rows.
    """
    return mixing.take(docs, [3, 1, 2], 1.5)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and whether they decode to its text.

    Null texts have null ids, empty texts none; null document ids and repeated rows stay; further columns are not read; an empty table
    gives no rows.
    """
    return sentencepieces.encode(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL cannot express the language, near-duplicate and piece stages; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder for the next, and goes when that is written."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        written = write_shared(stage(spark, docs, sf_dir))
        if read is not None:
            discard(read)
        docs = read = written
    return STAGES[-1][1](spark, docs, sf_dir)
