"""Corpus pipeline: from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; its rows are written as Parquet and read again for the next one.  All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import exact_dedup, lang_id, mixing, near_dedup, packing
from spanloom.llm.shared import written


#: Most bits a byte in the best language's code for a text to be in that language.  Clean text takes 2 to 4, noise 8; a text of fewer than LEAST_BYTES tells too little.
MOST_BITS, LEAST_BYTES = 6.7, 16


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found: those without text or a letter go, and those that no language's model predicts."""
    model = lang_id.fit(docs.select("doc_id", "text", "lang"))
    size = F.octet_length("text")
    foreign = (size >= LEAST_BYTES) & (F.col("bits") > MOST_BITS * size)
    labelled = lang_id.label(docs, model).where("lang_pred <> 'und'").where(~F.coalesce(foreign, F.lit(False)))
    return labelled.select(*[F.col(f"`{c}`") for c in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more."""
    return near_dedup.drop_near_copies(docs, width=5, percent=80)


def weighted_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of 2048 ids."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", identified),
    ("exact dedup", without_copies),
    ("MinHash near-dedup", without_near_copies),
    ("mixing sources to target weights", weighted_sources),
    ("packing", packed),
]

#: No SQL engine has the language model's, MinHash's or the tokenizer's rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
