"""The corpus pipeline: quality rules, quality classifier, line dedup, near-dedup, packing. See ``tidemark.llm.pipeline``."""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
