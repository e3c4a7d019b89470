"""The corpus pipeline: documents in, packed token sequences out.

Every stage works on all that its predecessor kept, which is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemesh.llm import crf, divergence, mixing, neardup, packing
from tidemesh.llm.common import delete, place, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the line CRF scores 0.5 or more; it learns from the labels that the classifier query learns from."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1)
    chain = crf.fit(docs, labels)
    return crf.score_documents(docs, chain, *COLUMNS[1:]).where("score >= 0.5").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the base rules and the divergence rules keep."""
    return divergence.judge(docs, *COLUMNS[1:]).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, that with the least doc_id."""
    return neardup.one_of_each(docs).select(*COLUMNS)


def curriculum_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops whole documents so that sources come to their targets, in training order."""
    return mixing.mix_documents(docs.select(*COLUMNS))


def bin_slack_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that the mix holds; a document that the mix repeats has its pieces as often."""
    parts = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(parts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("curriculum_mix", curriculum_mix),
    ("bin_slack_packing", bin_slack_packing),
]

#: Trained, hashed and tokenized stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other. A stage's inner tables are deleted once its output is written, and so is its input;
    what stays until the folder is cleared is the last stage's input and its tables, which the returned rows are read from.
    """
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    read = None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            out, path = stage(spark, docs, sf_dir), place(spark, name, keep=True)
            out.write.parquet(path)
        if read:
            delete(spark, read)
        docs, read = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
