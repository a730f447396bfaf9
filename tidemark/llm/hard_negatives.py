"""Hard negatives by exact scores: Strassen products of integer tiles, then mergeable heaps.

Vectors become whole numbers. Candidates are packed into blocks as they are read; anchors, a hundredth of all rows,
are dealt into blocks by hash. Every pair of an anchor block and a candidate block is a tile, whose scores are
one product of two matrices. A tile's work grows with the product of its sides and what it is sent with their
sum, so scores are never shipped: each task keeps, for every anchor of its block, the best few candidates so far
(a heap of fixed size that merges with any other) and hands on only those.

Two rounds of tiles: the first finds each anchor's positives, the second, knowing their scores, the best of the rows in
each positive's window. Whole numbers make sums exact in any order, so results do not depend on how rows lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is between these shares of the positive's, in hundredths.
LOW, HIGH = 30, 90
#: Rows and components of a block at most, but for a single vector; candidate blocks that one task goes through for an anchor block.
BLOCK_ROWS, BLOCK_CELLS, BLOCKS_A_TASK = 2048, 1 << 18, 8
#: Sides from which on products are split.
LEAF = 32
#: Scores up to this bound leave room for a hundredfold and for places within a block; beyond it, Python's numbers are used.
SAFE = (1 << 62) // BLOCK_ROWS // 100
_NONE = np.iinfo(np.int64).min
_NO_ID = np.iinfo(np.int64).max

PACKED = "part long, nth long, n long, dim long, ids binary, labels binary, vectors binary"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two integer matrices by seven products of halves; odd sides get a row or column of zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b, leaf)[:m, :n]
    i, j, l = m // 2, k // 2, n // 2  # noqa: E741
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), dtype=a.dtype)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of a and b (whole doubles). Shorter vectors count as followed by zeros.

    64-bit numbers where no product can pass SAFE (sums within Strassen's steps may wrap around and come back), else exact ones of any size.
    """
    dim = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (a, b))
    most = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * max(dim, 1) <= SAFE:
        return strassen(a.astype(np.int64), b.astype(np.int64).T)
    as_int = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return as_int(a) @ as_int(b).T


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores the k highest allowed ones and their ids (ascending by column), in order; _NONE fills up."""
    m, n = scores.shape
    if scores.dtype == object:
        out_s, out_i = np.full((m, k), _NONE, dtype=object), np.full((m, k), _NO_ID, dtype=np.int64)
        for r in range(m):
            top = sorted(np.flatnonzero(allowed[r]), key=lambda c: (-scores[r, c], c))[:k]
            out_s[r, : len(top)], out_i[r, : len(top)] = scores[r, top], ids[top]
        return out_s, out_i
    place = np.arange(n - 1, -1, -1, dtype=np.int64)
    keyed = np.where(allowed, scores * n + place, _NONE)
    if n > k:
        keyed = np.partition(keyed, n - k, axis=1)[:, n - k :]
    keyed = -np.sort(-keyed, axis=1) if keyed.size else keyed
    there = keyed != _NONE
    out_s, out_i = np.full((m, k), _NONE, dtype=np.int64), np.full((m, k), _NO_ID, dtype=np.int64)
    out_s[:, : keyed.shape[1]] = np.where(there, keyed // max(n, 1), _NONE)
    out_i[:, : keyed.shape[1]] = np.where(there, ids[n - 1 - keyed % max(n, 1)] if n else _NO_ID, _NO_ID)
    return out_s, out_i


def merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The best of two heaps of equal shape: by score, then id."""
    k = one[0].shape[-1]
    s, i = (np.concatenate([x, y], axis=-1) for x, y in zip(one, two, strict=True))
    if s.dtype == object:
        flat_s, flat_i = s.reshape(-1, 2 * k), i.reshape(-1, 2 * k)
        order = np.array([sorted(range(2 * k), key=lambda c: (-a[c], b[c])) for a, b in zip(flat_s, flat_i, strict=True)], dtype=np.int64).reshape(s.shape)[..., :k]
    else:
        order = np.lexsort((i, -np.maximum(s, _NONE + 1)), axis=-1)[..., :k]
    return np.take_along_axis(s, order, axis=-1), np.take_along_axis(i, order, axis=-1)


def _floor(x: Column) -> Column:
    """As a double; those past 2^52 are whole."""
    return F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x)


def prepared(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vector``: rows that take part, labels as the query moves them, components as whole doubles."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    label, vec_id = F.col("label").cast("long"), F.col("vec_id").cast("long")
    moved = F.when(vec_id % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)
    kept = rows.where(label.isNotNull() & x.isNotNull() & finite)
    return kept.select(vec_id.alias("vec_id"), moved.alias("label"), F.transform(x, lambda v: _floor(256 * v)).alias("vector"))


def _block(ids: list, labels: list, vectors: list, part: int, nth: int) -> tuple:
    """A packed block of rows in the order of their ids."""
    ids = np.array([_NO_ID if pd.isna(i) else int(i) for i in ids], dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    dim = max((len(v) for v in vectors), default=0)
    made = np.zeros((len(ids), dim))
    for at, k in enumerate(order):
        made[at, : len(vectors[k])] = vectors[k]
    return part, nth, len(ids), dim, ids[order].tobytes(), np.array(labels, dtype=np.int64)[order].tobytes(), made.tobytes()


def _packed(rows: DataFrame) -> DataFrame:
    """PACKED: candidate blocks in the order in which rows are read."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, nth, held, cells = TaskContext.get().partitionId(), 0, ([], [], []), 0
        names = [c.split()[0] for c in PACKED.split(", ")]
        for batch in batches:
            for i, label, vector in zip(batch["vec_id"], batch["label"], batch["vector"], strict=True):
                if held[0] and (len(held[0]) >= BLOCK_ROWS or cells + len(vector) > BLOCK_CELLS):
                    yield pd.DataFrame([_block(*held, part, nth)], columns=names)
                    nth, held, cells = nth + 1, ([], [], []), 0
                for to, x in zip(held, (i, label, vector), strict=True):
                    to.append(x)
                cells += len(vector)
        if held[0]:
            yield pd.DataFrame([_block(*held, part, nth)], columns=names)

    # Strings keep large ids exact where some are null.
    return rows.select(F.col("vec_id").cast("string").alias("vec_id"), "label", "vector").mapInPandas(pack, PACKED)


def _anchor_blocks(anchors: DataFrame) -> DataFrame:
    """``a`` and the columns of PACKED: anchors by hash, equal ones once."""
    distinct = materialize(anchors.distinct(), "anchors")
    row = distinct.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    rows_a_block = max(1, min(BLOCK_ROWS // 2, BLOCK_CELLS // 2 // max(row["dim"] or 1, 1)))
    blocks = max(1, -(-row["n"] // rows_a_block))
    dealt = distinct.withColumn("a", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks)))

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        made = _block(group["vec_id"].tolist(), group["label"].tolist(), group["vector"].tolist(), 0, 0)
        return pd.DataFrame([(key[0], *made)], columns=["a", *[c.split()[0] for c in PACKED.split(", ")]])

    return materialize(dealt.groupBy("a").applyInPandas(pack, f"a long, {PACKED}"), "anchor_blocks")


def _opened(row, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[f"{prefix}_{c}"], dtype=np.int64) for c in ("ids", "labels"))
    return ids, labels, np.frombuffer(row[f"{prefix}_vectors"], dtype=np.float64).reshape(len(ids), int(row[f"{prefix}_dim"]))


def _tiles(anchors: DataFrame, candidates: DataFrame, score, schema: str) -> DataFrame:
    """What ``score`` makes of every anchor block and its candidate blocks.

    Every pair of blocks meets once, under a key of its own: the anchor block and a number that a few
    candidate blocks share. ``score(row)`` gives an anchor block's state, which takes one tile at a time and
    says at the end what is handed on.
    """
    n_groups = max(1, candidates.count() // BLOCKS_A_TASK)
    n_anchors = [r["a"] for r in anchors.select("a").collect()]  # numbers of blocks, of a thousand anchors each
    group = F.pmod(F.xxhash64("part", "nth"), F.lit(n_groups))
    named = lambda df, p: [F.col(c).alias(f"{p}_{c}") for c in df.columns if c in ("dim", "ids", "labels", "vectors", "scores")]
    left = anchors.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))).alias("g"), *named(anchors, "a"))
    right = candidates.select(F.explode(F.array(*[F.lit(a).cast("long") for a in n_anchors])).alias("a") if n_anchors else F.lit(0).cast("long").alias("a"), group.alias("g"), *named(candidates, "c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            for _, row in batch.iterrows():
                if state is None or row["a"] != at:
                    yield from state.done() if state is not None else ()
                    at, state = row["a"], score(row)
                state.take(*_opened(row, "c"))
        yield from state.done() if state is not None else ()

    joined = left.hint("merge").join(right, ["a", "g"])
    return joined.mapInPandas(run, schema)


class _Positives:
    """The best rows of each anchor's own label."""

    def __init__(self, row) -> None:
        self.a = row["a"]
        self.ids, self.labels, self.vectors = _opened(row, "a")
        self.heap = (np.full((len(self.ids), POSITIVES), _NONE, dtype=np.int64), np.full((len(self.ids), POSITIVES), _NO_ID, dtype=np.int64))

    def take(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        allowed = (self.labels[:, None] == labels) & (self.ids[:, None] != ids)
        self.heap = merged(self.heap, _best(products(self.vectors, vectors), ids, allowed, POSITIVES))

    def done(self) -> Iterator[pd.DataFrame]:
        r, c = np.nonzero(self.heap[0] != _NONE)
        if len(r):
            yield pd.DataFrame({"a": self.a, "nth": r, "anchor_id": self.ids[r], "score": [str(s) for s in self.heap[0][r, c]], "id": self.heap[1][r, c]})


class _Windows:
    """The best rows of other labels in the window of each anchor's each positive."""

    def __init__(self, row) -> None:
        self.a = row["a"]
        self.ids, self.labels, self.vectors = _opened(row, "a")
        self.places = [(int(r), int(p), int(s)) for r, p, s in (x.split(",") for x in row["a_scores"])]
        self.anchor = np.array([r for r, _, _ in self.places], dtype=np.int64)
        bounds = [(-(-LOW * s // 100), HIGH * s // 100) for _, _, s in self.places]
        clip = lambda x: max(_NONE + 1, min(_NO_ID, x))
        self.low, self.high = (np.array([clip(b[k]) for b in bounds], dtype=np.int64) for k in (0, 1))
        self.heap = (np.full((len(self.places), NEGATIVES), _NONE, dtype=np.int64), np.full((len(self.places), NEGATIVES), _NO_ID, dtype=np.int64))

    def take(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        scores, other = products(self.vectors, vectors), self.labels[:, None] != labels
        for start in range(0, len(self.places), BLOCK_ROWS // 2):  # as many windows at once as a block has anchors
            s = slice(start, start + BLOCK_ROWS // 2)
            mine = scores[self.anchor[s]]
            allowed = other[self.anchor[s]] & (mine >= self.low[s, None]) & (mine <= self.high[s, None])
            best = merged(tuple(x[s] for x in self.heap), _best(mine, ids, allowed.astype(bool), NEGATIVES))
            if best[0].dtype != self.heap[0].dtype:
                self.heap = (self.heap[0].astype(object), self.heap[1])
            self.heap[0][s], self.heap[1][s] = best

    def done(self) -> Iterator[pd.DataFrame]:
        w, c = np.nonzero(self.heap[0] != _NONE)
        if len(w):
            yield pd.DataFrame({"a": self.a, "window": [f"{self.places[k][0]},{self.places[k][1]}" for k in w], "score": [str(s) for s in self.heap[0][w, c]], "id": self.heap[1][w, c]})


def _top(found: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("score", F.col("score").cast("decimal(38,0)")).withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank``.

    Both tables are ``vec_id, label, vector`` (vectors of whole doubles); anchors are rows of the first as well.

    * An anchor's positives are the POSITIVES rows of its label with the highest scores, its own id left out;
      its negatives, for each positive, the NEGATIVES rows of other labels with the highest scores in the window.
      Ties go by the smaller id; a null id comes last and is returned as null. Fewer rows: all of them.
    * Repeated rows are candidates each; anchors equal in id, label and vector count once. Anchors that share an id
      but differ have results each, under the same id.
    * A vector shorter than another counts as followed by zeros, an empty one as zeros. Scores past 64 bits are compared
      exactly and returned as the nearest long.
    * A positive without a row in its window has no row in the result. An empty table, or one without anchors, gives none.
    """
    candidates = materialize(_packed(rows), "blocks")
    blocks = _anchor_blocks(anchors)
    found = _tiles(blocks, candidates, _Positives, "a long, nth long, anchor_id long, score string, id long")
    positives = materialize(_top(found, ["a", "nth"], POSITIVES, "positive_rank"), "positives")
    windows = positives.groupBy("a").agg(F.collect_list(F.concat_ws(",", "nth", "positive_rank", F.col("score").cast("string"))).alias("scores"))
    known = materialize(blocks.join(windows, "a"), "windows")
    found = _tiles(known, candidates, _Windows, "a long, window string, score string, id long")
    negatives = materialize(_top(found, ["a", "window"], NEGATIVES, "rank"), "negatives")

    named = positives.select(
        "a", F.concat_ws(",", "nth", "positive_rank").alias("window"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "positive_rank"
    )
    whole = lambda c: F.when(F.col(c) != int(_NO_ID), F.col(c)).alias(c)
    near = lambda c: F.least(F.greatest(F.col(c), F.lit(-(1 << 63))), F.lit((1 << 63) - 1)).cast("long").alias(c)
    out = negatives.select("a", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["a", "window"])
    return out.select("anchor_id", whole("positive_id"), "rank", whole("negative_id"), near("positive_score"), near("negative_score"), "positive_rank")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(table(spark, sf_dir, "embeddings"))
    return hard_negatives(rows, rows.where(F.col("vec_id") % 100 == 0))


OP11_SQL = """
WITH ok AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
sc AS (
  SELECT a.id AS anchor_id, r.id AS id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS s
  FROM ok a JOIN ok r ON a.id <> r.id WHERE a.id % 100 = 0),
pos AS (
  SELECT anchor_id, id AS positive_id, s AS ps, row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) AS positive_rank
  FROM sc WHERE same QUALIFY positive_rank <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, n.id AS negative_id, ps AS positive_score, n.s AS negative_score, CAST(positive_rank AS INT) AS positive_rank
FROM pos JOIN sc n USING (anchor_id) WHERE NOT n.same AND 30 * ps <= 100 * n.s AND 100 * n.s <= 90 * ps
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.s DESC, n.id) QUALIFY row_number() OVER w <= 10
"""
