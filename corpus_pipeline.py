"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixture, token files; each stage reads what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import crf_quality, decontaminate, mixing, near_copies, token_files
from strandline.llm._common import scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return crf_quality.keep_good(docs, crf_quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are near copies at a five-word Jaccard similarity of 0.8; the one with the smallest id of each group stays."""
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document that was nothing else goes."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources have their shares, and shuffled."""
    return mixing.replicated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, and what is read back from them."""
    return token_files.token_table(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", tokens),
]

#: The classifier, the FM-index and the tokenizer are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each one returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        out, kept = scratch(spark, "stage"), stage(spark, docs, sf_dir)
        kept.write.parquet(out)
        docs = spark.read.schema(kept.schema).parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
