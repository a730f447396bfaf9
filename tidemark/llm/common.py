"""What the operators of this subpackage share: tables, shared storage, word rules."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.staging import materialize, shared_dir  # noqa: F401

#: The ASCII white space that separates words, U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Texts that a worker takes up at once: so many, and so many code points unless a single one is longer.
SLICE_ROWS, SLICE_CHARS = 256, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: Sequence[str | None]) -> Iterator[slice]:
    """Neighbouring texts to be worked on together. Spark bounds a batch's bytes, but what is made of them may be larger."""
    start = chars = 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > start and (k - start >= SLICE_ROWS or chars + n > SLICE_CHARS):
            yield slice(start, k)
            start, chars = k, 0
        chars += n
    if start < len(texts):
        yield slice(start, len(texts))


class Remembered(dict):
    """Values of a function of strings. Past ``bound`` bytes of keys (their overhead included) all are forgotten."""

    def __init__(self, compute: Callable, bound: int = 40_000_000) -> None:
        super().__init__()
        self.compute, self.bound, self.held = compute, bound, 0

    def __missing__(self, key: Hashable):
        value = self.compute(key)
        size = len(key) + 64
        if self.held + size > self.bound:
            self.clear()
            self.held = 0
        if size <= self.bound:
            self[key] = value
            self.held += size
        return value


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bounded_ids(ids: DataFrame, column: str, bound: int) -> list[int]:
    """At most ``bound`` distinct ids, chosen by their hash, so the same whatever the partitioning.

    A filter on the hash brings the expected number down to nine tenths of the bound before
    anything is sorted, so no task and not the driver ever holds more than about ``bound`` ids.
    """
    ids = ids.select(F.col(column).cast("long").alias("id")).where("id is not null").distinct()
    n = ids.count()
    rank = F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 30))
    if n > bound:
        ids = ids.where(rank < int((1 << 30) * 0.9 * bound / n))
    rows = ids.select("id", rank.alias("r")).orderBy("r", "id").limit(bound).collect()
    return sorted(row["id"] for row in rows)
