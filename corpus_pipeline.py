"""Training corpus pipeline: documents in, packed sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kbspark.llm import line_templates, packing, quality_rules, simhash
from kbspark.llm.common import materialise, table
from kbspark.llm.queries import learned_rules, wanted_documents
from kbspark.session import prepare


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return wanted_documents(prepare(spark), docs, sf_dir).where("kept").select(*docs.columns)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base tests and the learned rules."""
    rules = learned_rules(prepare(spark), docs, sf_dir)
    return quality_rules.passing(docs, "text", rules)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of recurring templates."""
    prepare(spark)
    return line_templates.dedup_lines(docs).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepare(spark)
    return simhash.keep_one(docs, "doc_id", "text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the sequences."""
    prepare(spark)
    return packing.pack_documents(docs, "doc_id", "text").drop("text_hash")


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("packing", packing_stage),
]

# SQL can express neither the learned stages nor the packing; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
