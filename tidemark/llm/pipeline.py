"""A corpus pipeline over ``documents``: quality rules, quality classifier, line dedup, near-dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again before the next stage, so no stage is ever computed twice and lineage stays short. All but
the last return the columns of ``documents``.

Null texts count as empty ones; an empty table passes every stage as an empty table. Repeated rows are
judged alike by the first two stages, count as one document in line dedup, and of them near-dedup
keeps one. Texts of any length are judged whole. Columns are passed on whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import compression_classifier, line_dedup, near_dedup, packing, quality_rules, wordpiece
from tidemark.llm.common import materialize, spare, table


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject, those without text (null or empty) among them."""
    (into,) = spare(docs, "_rules")
    judged = quality_rules.quality_rules(docs, table(spark, sf_dir, "labels"), into=into)
    return judged.where(F.col(into)["kept"]).select(*docs.columns)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose quality score is below one half; the model learns from the whole table."""
    whole = table(spark, sf_dir, "documents")
    (into,) = spare(docs, "_score")
    scored = compression_classifier.quality_classifier(docs, table(spark, sf_dir, "labels"), whole, into)
    return scored.where(F.col(into) >= 0.5).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines; n_chars follows the text."""
    return line_dedup.line_dedup(docs).select(
        *[F.char_length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns]
    )


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates, that of the smallest doc_id."""
    return near_dedup.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes in training sequences."""
    return packing.pack(docs, tokens=wordpiece.count_column(spark))


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("best_fit_packing", packing_stage),
]

#: No SQL has hashed n-gram ratios, zstandard or best-fit packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
