"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import pipeline
from tidemark.llm.compression_classifier import op4_quality_classifier
from tidemark.llm.fingerprints import op3_paragraph_fingerprints
from tidemark.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from tidemark.llm.html_extraction import op9_html_extraction
from tidemark.llm.line_dedup import OP8_SQL, op8_line_dedup
from tidemark.llm.mixing import OP12_SQL, op12_source_mixing
from tidemark.llm.near_dedup import op7_minhash_near_dedup
from tidemark.llm.packing import op5_best_fit_packing
from tidemark.llm.periodic_runs import op13_periodic_runs
from tidemark.llm.quality_rules import op1_quality_rules
from tidemark.llm.sentence_pieces import op6_sentencepiece_encoding
from tidemark.llm.sharding import op10_balanced_sharding
from tidemark.llm.wordpiece import op2_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_paragraph_fingerprints": op3_paragraph_fingerprints,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_sentencepiece_encoding": op6_sentencepiece_encoding,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_balanced_sharding": op10_balanced_sharding,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_source_mixing": op12_source_mixing,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline.run,
}

ORACLES: dict[str, str] = {"op8_line_dedup": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_source_mixing": OP12_SQL}
if pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = pipeline.ORACLE_SQL
