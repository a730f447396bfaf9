"""Variable-capacity best-fit packing of documents into training sequences.

Documents are dealt into shards of bounded size by a hash; each shard is packed on its own, so
the work is one grouped map over lengths (texts stay where they are). Pieces of the largest length
fill a bin each. Of a shard's other pieces, each goes in decreasing length to the open bin that it leaves least room in.
If none has room, the permitted length with the least cost per token is opened, given what remains to be packed.
At the end every bin shrinks to the smallest permitted length that holds its contents.

Which lengths are best to open depends on all pieces together: two of 600 fit 2,048 better than one each 1,024. So a
shard is packed once for each set of lengths that might be opened, and the cheapest packing is kept.

A sequence costs something of its own, its length, and a part that grows with the length's square
(attention). So neither the longest nor the shortest length is always best: long ones waste less
on pieces that hardly fit and are needed by long documents, short ones are cheaper to attend over.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, materialize, table
from tidemark.llm.wordpiece import count_column

#: Permitted sequence lengths; what a sequence costs beside its length, and the length at which attention costs as much as the rest.
LENGTHS = (512, 1024, 2048, 4096)
SEQUENCE_OVERHEAD, EVEN_LENGTH = 48, 16_384
#: Pieces that a shard holds on average.
SHARD_PIECES = 2_000

PACKED_SCHEMA = (
    "doc_id long, piece int, start long, n_tokens int, shard long, bin int, bin_start int, bin_tokens int, capacity int"
)


def default_cost(capacity: int) -> float:
    return SEQUENCE_OVERHEAD + capacity + capacity * capacity / EVEN_LENGTH


def best_fit(
    sizes: list[int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = default_cost
) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin and place in it of every size (in decreasing order); tokens and final capacity of every bin."""
    lengths = tuple(sorted(lengths))
    free: list[tuple[int, int]] = []  # (room left, bin), ordered
    bins, starts, used, room = [], [], [], []
    left = sum(sizes)
    for size in sizes:
        at = bisect_left(free, (size, -1))
        if at < len(free):
            space, b = free.pop(at)
        else:
            fits = [c for c in lengths if c >= size]
            space = min(fits, key=lambda c: (cost(c) / min(c, left), c))
            b = len(used)
            used.append(0)
            room.append(space)
        bins.append(b)
        starts.append(used[b])
        used[b] += size
        if space > size:
            insort(free, (space - size, b))
        left -= size
    return bins, starts, used, [next(c for c in lengths if c >= n) for n in used]


def jointly(
    sizes: list[int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = default_cost
) -> tuple[list[int], list[int], list[int], list[int]]:
    """The cheapest ``best_fit`` of sizes (in decreasing order) over all sets of lengths that hold the largest; bins shrink to any length.

    So it is never dearer than opening any one length, or any set of them. Ties: fewer lengths, then shorter ones.
    """
    lengths = tuple(sorted(lengths))
    best = None
    for k in range(1, len(lengths) + 1):
        for opened in combinations(lengths, k):
            if sizes and opened[-1] < sizes[0]:
                continue
            bins, starts, used, _ = best_fit(sizes, opened, cost)
            final = [lengths[bisect_left(lengths, n)] for n in used]
            price = sum(map(cost, final))
            if best is None or price < best[0]:
                best = (price, (bins, starts, used, final))
    return best[1] if best else ([], [], [], [])


def pack(
    docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, shard_pieces: int = SHARD_PIECES,
    cost: Callable[[int], float] = default_cost, tokens: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """PACKED_SCHEMA: one row per piece of a document, none dropped or cut short.

    * A document has as many tokens as ``tokens`` makes of its text (words unless given) and one
      that ends it, so a null or empty text has one.
    * A document longer than the largest length is cut into pieces of that length and a rest.
    * A sequence is (shard, bin); pieces lie in it from bin_start on without gaps or overlap.
    * Ties in length go by doc_id, then piece; rows that share a doc_id are packed one by one. A
      null doc_id is packed and stays null. An empty table gives an empty result.
    * A text of any length is counted as a whole.
    * Pieces, not documents, are dealt over shards, so one very long text is in many; of more rows of one doc_id and text
      than a shard should hold, each piece is dealt on its own.
    * Only doc_id and text are read.
    """
    largest = max(lengths)
    text = F.col("text").cast("string")
    words = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD))
    measured = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), ((tokens or words)(text) + 1).alias("n"), F.xxhash64("doc_id", "text").alias("h"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "measured",
    )
    n_pieces = F.floor((F.col("n") - 1) / largest) + 1
    n_shards = max(1, -(-(measured.agg(F.sum(n_pieces)).first()[0] or 0) // shard_pieces))
    many = measured.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > shard_pieces).select("h", F.lit(True).alias("many"))
    measured = measured.join(materialize(many, "many"), "h", "left").withColumn("h", F.when(F.col("many"), F.xxhash64("h", "row")).otherwise(F.col("h")))
    pieces = measured.select("doc_id", "h", "n", F.explode(F.sequence(F.lit(0), (n_pieces - 1).cast("int"))).alias("piece")).select(
        "doc_id", "piece", (F.col("piece").cast("long") * largest).alias("start"),
        F.least(F.lit(largest), F.col("n") - F.col("piece") * largest).cast("int").alias("n_tokens"),
        F.pmod(F.xxhash64("h", "piece"), F.lit(n_shards)).alias("shard"),
    )

    def pack_shard(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        whole = int((shard["n_tokens"] == largest).sum())
        bins, starts, used, capacity = jointly(shard["n_tokens"].tolist()[whole:], lengths, cost)
        return shard.assign(
            bin=[*range(whole), *(b + whole for b in bins)], bin_start=[0] * whole + starts,
            bin_tokens=[largest] * whole + [used[b] for b in bins], capacity=[largest] * whole + [capacity[b] for b in bins],
        )

    return pieces.groupBy("shard").applyInPandas(pack_shard, PACKED_SCHEMA)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokens=count_column(spark))
