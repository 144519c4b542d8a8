"""Corpus pipeline: quality filter, near-duplicate removal, benchmark decontamination,
mixing to target weights and token files. Every stage calls one operator of
``demandflow.llm`` on all rows its predecessor kept; its result is written as Parquet
and read again as the next one's input.

Defined cases for every stage: null texts count as empty, null ids are kept as they are,
repeated rows are each handled (near-duplicate removal keeps one), further columns are
passed through up to the last stage, an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from demandflow.llm import decontaminate, mixing, simhash
from demandflow.llm.common import free_name, read_table, stored
from demandflow.llm.queries import quality, token_output


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents scored below 0.5 go."""
    out = free_name(docs, "_score")
    scored = quality(docs, read_table(spark, sf_dir, "labels"), out)
    return scored.where(F.col(out) >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group the document with the smallest id stays."""
    return simhash.one_per_group(docs, shingle=3, max_bits=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a passage of the benchmark go."""
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document as often as the mix takes it."""
    return mixing.copies(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID / binary output of every document of the mix."""
    return token_output(spark, docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID / binary output", token_ids),
]

#: Learned scores have no SQL form; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "".join(c if c.isalnum() else "-" for c in name))
    return docs
