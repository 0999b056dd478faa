"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, PII, packing; each stage reads what the one before it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm.common import removed, shared_dir, table
from graphloom.llm.decontaminate import decontaminated
from graphloom.llm.pack import pack_documents
from graphloom.llm.pii import masked
from graphloom.llm.quality import quality_filter
from graphloom.llm.simhash import keep_one_per_class


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of any benchmark item: one leaked passage is enough here."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; n_chars follows."""
    return masked(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of training tokens: a row per piece with its ids, the sequence it lies in and its place there."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("personal data", personal_data),
    ("best-fit packing", packing),
]

#: Trained estimates, near-duplicate classes and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet to the shared folder and read again. A stage's input is deleted once its output is written; the last output stays."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            removed(spark, f"{base}/{k - 1}")
    return docs
