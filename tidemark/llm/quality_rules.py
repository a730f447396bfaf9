"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word n-grams are counted: the raw one over every document, the
target one over trusted documents (all those labelled good). A
document's score is the sum of ``log p_target - log p_raw`` over its n-grams, divided by their
number; it is kept if the score reaches a fixed threshold. The two count vectors have
``N_BUCKETS`` entries whatever the input, so that they may pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Remembered, materialize, table

N_BUCKETS = 1 << 14
#: Mean log-likelihood ratio per n-gram that a document must reach to stay.
MIN_RATIO = -0.06
#: Added to every bucket's count in both multinomials.
SMOOTHING = 1.0
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, dtype=np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

RULES_SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, llr double, kept boolean"
)


def _word_hashes(words: list[bytes], known: Remembered) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def ngram_buckets(hashes: np.ndarray, n_buckets: int = N_BUCKETS) -> np.ndarray:
    """Buckets of a document's words and pairs of neighbouring words."""
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes[1:] >> np.uint64(1))
    both = np.concatenate([hashes, pairs])
    both = (both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (both >> np.uint64(40)).astype(np.int64) % n_buckets


def repeated_words(hashes: np.ndarray) -> int:
    """Words within 3-word windows that are found twice or more, the first find included."""
    n = len(hashes) - 2
    if n < 2:
        return 0
    _, ids = np.unique(hashes, return_inverse=True)
    size = int(ids.max()) + 1
    _, pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
    _, windows, counts = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    at = counts[windows] > 1
    covered = np.zeros(n + 2, dtype=bool)
    for k in range(3):
        covered[k : k + n] |= at
    return int(covered.sum())


def _rules(text: str | None, weights: np.ndarray | None, min_ratio: float, known: Remembered) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    data = np.frombuffer(raw, dtype=np.uint8)
    n = len(words)
    n_spaces = int(_IS_SPACE[data].sum())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()] if b"\n" in raw else []
    hashes = _word_hashes(words, known)
    n_repeat = repeated_words(hashes)
    failed = n < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n
    llr = float(weights[ngram_buckets(hashes, len(weights))].sum()) / (2 * n - 1) if n and weights is not None else 0.0
    return (
        n, len(text or "") - n_spaces, int(_IS_SYMBOL[data].sum()), len(lines) - len(set(lines)), n_repeat,
        failed, llr, bool(not failed and llr >= min_ratio),
    )


def count_ngrams(docs: DataFrame, trusted: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``bucket, raw, target``: n-gram counts over all documents and over those whose id is in ``trusted`` (doc_id, distinct)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(n_buckets, dtype=np.int64), np.zeros(n_buckets, dtype=np.int64)
        known = Remembered(xxhash.xxh64_intdigest)
        for batch in batches:
            for text, good in zip(batch["text"], batch["good"].notna(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                if words:
                    found = np.bincount(ngram_buckets(_word_hashes(words, known), n_buckets), minlength=n_buckets)
                    raw += found
                    if good:
                        target += found
        some = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": some, "raw": raw[some], "target": target[some]})

    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        # Texts are the streamed side and are not sorted.
        .join(trusted.withColumn("good", F.lit(True)).hint("shuffle_hash"), "doc_id", "left")
        .select("text", "good")
        .mapInPandas(count, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )


def fit_log_ratios(docs: DataFrame, labels: DataFrame, n_buckets: int = N_BUCKETS) -> np.ndarray | None:
    """``log p_target - log p_raw`` by bucket; None if there is no trusted document."""
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    good = materialize(good, "good")  # as a table, so that the join can split a hot id, or all rows without one
    if good.isEmpty():
        return None
    counts = count_ngrams(docs, good, n_buckets).collect()  # n_buckets rows at most
    raw, target = np.zeros(n_buckets), np.zeros(n_buckets)
    for row in counts:
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.sum():
        return None
    share = [(c + SMOOTHING) / (c.sum() + SMOOTHING * n_buckets) for c in (target, raw)]
    return np.log(share[0]) - np.log(share[1])


def rules_column(weights: np.ndarray | None, min_ratio: float = MIN_RATIO) -> Callable[[str], Column]:
    """A column function from a text column to a struct of RULES_SCHEMA."""
    known = None

    @F.pandas_udf(RULES_SCHEMA)
    def rules(texts: pd.Series) -> pd.DataFrame:
        nonlocal known
        known = Remembered(xxhash.xxh64_intdigest) if known is None else known
        names = [x.split()[0] for x in RULES_SCHEMA.split(", ")]
        return pd.DataFrame([_rules(t, weights, min_ratio, known) for t in texts], columns=names)

    return rules


def quality_rules(docs: DataFrame, labels: DataFrame, min_ratio: float = MIN_RATIO, into: str = "_rules") -> DataFrame:
    """``docs`` with a struct ``into`` of RULES_SCHEMA.

    * Null or empty text: no word, so the base rules fail it; ``llr`` is 0.
    * Without a trusted document (or over empty tables) every ratio is 0 and the base rules decide.
    * A ratio equal to the threshold is kept. Repeated rows each count in the raw multinomial.
    * A text of any length is judged as a whole, in time in proportion to it (n log n for repeated windows).
    * Only doc_id and text are read; other columns are passed on, but for one named ``into``, which is replaced.
    """
    weights = fit_log_ratios(docs, labels)
    return docs.withColumn(into, rules_column(weights, min_ratio)(F.col("text").cast("string")))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, table(spark, sf_dir, "labels")).select("doc_id", "_rules.*")
