"""Quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled texts. A text is cut into
pieces of PIECE bytes and every piece is compressed under both. The difference of the two sums for
each byte of text is above 0 for what resembles the good texts; a logistic curve fitted on further
labelled texts, at the share of good texts among all labels, makes it a probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_ids, materialize, table

#: Bound on the sample that is fitted on: labelled texts per class, each of them whole.
MAX_PER_CLASS = 1_500
#: A text trains a dictionary in blocks of so many bytes.
BLOCK = 2048
#: A dictionary has an eighth of the bytes that it is trained on, and this many at most.
DICTIONARY_BYTES = 256 * 1024
#: Texts are compressed in pieces, so that what a text repeats of itself does not hide the dictionaries.
PIECE = 512
LEVEL = 3


@dataclass(frozen=True)
class CompressionModel:
    """good, bad: dictionaries. curve: weight of the difference, and the intercept."""

    good: bytes
    bad: bytes
    curve: tuple[float, float]


def _dictionary(blocks: list[bytes]) -> bytes | None:
    """A dictionary trained on blocks; None if there are too few to train one."""
    size = max(256, min(DICTIONARY_BYTES, sum(map(len, blocks)) // 8))
    try:
        return zstandard.train_dictionary(size, blocks, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return None


def _compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    made = []
    for data in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(data)
        dictionary.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=False, write_content_size=False, write_dict_id=False))
    return made


def size_difference(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """Bytes that the good dictionary saves against the bad one, for each byte of the whole text; 0 without text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    saved = 0
    for i in range(0, len(raw), PIECE):
        piece = raw[i : i + PIECE]
        saved += len(bad.compress(piece)) - len(good.compress(piece))
    return saved / max(1, len(raw))


def difference_column(good: bytes, bad: bytes) -> Callable[[Column], Column]:
    """A column function from a text column to its ``size_difference``."""
    pair = None

    @F.pandas_udf("double")
    def difference(texts: pd.Series) -> pd.Series:
        nonlocal pair
        pair = pair or _compressors(good, bad)
        return pd.Series([size_difference(t, *pair) for t in texts], dtype="float64")

    return difference


def _logistic(x: np.ndarray, good: np.ndarray, weight: np.ndarray, ridge: float = 1e-6) -> tuple[float, float]:
    """Weight of the difference and the intercept, by Newton's method.

    Targets are (n + 1) / (n + 2) and 1 / (n + 2) for n texts of a class, so that classes that do not
    overlap give no infinite weight.
    """
    y = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    spread = float(x.std()) or 1.0
    design = np.column_stack([x / spread, np.ones(len(x))])
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2.0, 2.0)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]) / spread, float(beta[1])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def _blocks(training: DataFrame) -> dict[int, list[bytes]]:
    """All blocks of the whole texts that build dictionaries, by class; ordered by a hash, so not by partitions."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, quality, text in zip(batch["doc_id"], batch["quality"], batch["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(quality, xxhash.xxh64_intdigest(f"{doc_id} {i}") >> 1, raw[i : i + BLOCK]) for i in range(0, len(raw), BLOCK)]
            yield pd.DataFrame(rows, columns=["quality", "h", "block"])

    found = training.where("build").select("doc_id", "quality", "text").mapInPandas(cut, "quality int, h long, block binary").collect()
    found.sort(key=lambda r: (r["h"], bytes(r["block"])))
    return {q: [bytes(r["block"]) for r in found if r["quality"] == q] for q in (1, 0)}


def fit_compression_model(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> CompressionModel | None:
    """Fit on a bounded sample of the labelled rows that are not held out, of which whole texts count.

    The bound is on rows alone: at most ``max_per_class`` of a class. Two thirds of the sample build the
    dictionaries, the rest sets the logistic curve. None where either class has too few texts for that.
    """
    usable = labels.where(~held_out(F.col("doc_id")))
    ids = {q: bounded_ids(usable.where(F.col("quality") == q), "doc_id", max_per_class) for q in (1, 0)}
    if not ids[1] or not ids[0]:
        return None
    marked = [(i, q, k % 3 > 0) for q in ids for k, i in enumerate(ids[q])]
    wanted = docs.sparkSession.createDataFrame(marked, "doc_id long, quality int, build boolean")
    training = materialize(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .where(F.length("text") > 0)
        .join(F.broadcast(wanted), "doc_id")  # 2 * max_per_class rows at most
        .groupBy("doc_id", "quality", "build").agg(F.min("text").alias("text")),
        "training",
    )
    blocks = _blocks(training)
    good, bad = _dictionary(blocks[1]), _dictionary(blocks[0])
    if good is None or bad is None:
        return None
    figures = training.where("not build").select("quality", difference_column(good, bad)(F.col("text")).alias("x")).collect()
    figures.sort(key=lambda r: (r["quality"], r["x"]))
    x, y = np.array([r["x"] for r in figures]), np.array([r["quality"] == 1 for r in figures], dtype=bool)
    if not y.any() or y.all():
        return None
    shares = {r["quality"]: r["count"] for r in usable.where("quality in (0, 1)").groupBy("quality").count().collect()}
    each = {q: shares[q] / sum(shares.values()) / (y == q).sum() for q in (1, 0)}
    return CompressionModel(good, bad, _logistic(x, y, np.where(y, each[1], each[0])))


def score_column(model: CompressionModel | None) -> Callable[[Column], Column]:
    """A column function from a text column to its score, from 0 to 1; without a model 0.5."""
    if model is None:
        return lambda text: F.lit(0.5)
    slope, intercept = model.curve
    difference = difference_column(model.good, model.bad)
    return lambda text: 1 / (1 + F.exp(-(difference(text) * slope + intercept)))


def quality_classifier(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, into: str = "_score") -> DataFrame:
    """``docs`` with ``into``, the score (0 to 1, higher: better) of every whole text.

    The model is fitted on the labelled rows of ``training``, which is ``docs`` unless given. Where
    ``docs`` is what an earlier filter left, it has few bad texts to learn from: give the whole table.

    * Null or empty text: nothing to compress, so the curve's value at a difference of 0.
    * Too few labelled texts of a class to train a dictionary and set the curve: every score is 0.5.
    * Equal texts have equal scores; a score of 0.5 counts as good. Of several training texts of one
      doc_id the smallest counts. A text of any length is compressed whole, piece by piece.
    * Labels, ids, languages and sources never enter a score. Empty tables give an empty result.
    * Only doc_id and text are read; other columns are passed on, but for one named ``into``, which is replaced.
    """
    model = fit_compression_model(docs if training is None else training, labels)
    return docs.withColumn(into, score_column(model)(F.col("text").cast("string")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_classifier(docs, table(spark, sf_dir, "labels")).select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
