"""Near-duplicate classes: BagMinHash signatures, banding, exact verification of multiset overlap.

A document is the multiset of its 5-word shingles. Two documents are linked if the weighted
Jaccard similarity of their multisets is at least THRESHOLD; classes are the connected
components of the links. Equal multisets are one node from the start, so copies never meet each
other. In every bucket of nodes that share a band, nodes are compared with one centre (a pair per
node, not per pair of nodes), in ROUNDS rounds with other centres. Among nodes that then share a
bucket with other classes, an exact prefix and position filter finds every pair that may still be
similar, so no link within a bucket is lost and yet no group is ever paired in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Remembered, materialize, slices, spare, table
from tidemark.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
#: At a similarity of 0.8, 0.9999 of all pairs share a band; at 0.9, all but one in 10^9.
N_BANDS, BAND_ROWS = 24, 5
ROUNDS = 2
#: Elements before an element of a bag's prefix that tell whether a pair has met already.
PAST = 32
_NO_ID = -(1 << 63)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_bag(text: str | None, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts. Fewer words than a shingle: one shingle of them all."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=n)
    k = min(SHINGLE, n)
    rolled = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        rolled = mix(rolled * _M3 + h[i : n - k + 1 + i])
    return np.unique(rolled, return_counts=True)


def bag_elements(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The multiset as a set: the c-th find of a shingle is an element of its own."""
    if len(keys) == 0 or counts.max() == 1:
        return keys
    which = np.repeat(np.arange(len(keys)), counts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.where(nth == 0, keys[which], mix(keys[which] + nth.astype(np.uint64) * _M3))


def bag_minhash(docs: np.ndarray, keys: np.ndarray, counts: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """BagMinHash signatures of ``n_docs`` bags, given flat as (document, key, count).

    The weight axis is cut into [0,1), [1,2), [2,4), [4,8) and so on. Each (key, interval) has a
    Poisson process of its own whose rate is the interval's length: points come in ascending
    time, each with a component and a place in the interval. The place is a number whose bits
    are the choices of halves on the way down; a point counts if it lies below the key's weight.
    A component keeps the identity of its earliest point. A process stops once its time is past
    the latest of its document's components, so about m log m points are drawn per document,
    however large it is.
    """
    levels = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1
    which = np.repeat(np.arange(len(keys)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    doc, weight = docs[which], counts[which]
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    length = np.where(level == 0, 1, low)
    seed = mix(keys[which] + level.astype(np.uint64) * _M2)
    time = np.zeros(len(which))
    first = np.full(n_docs * m, np.inf)
    identity = np.zeros(n_docs * m, dtype=np.uint64)
    step = 0
    while len(doc):
        step += 1
        a = mix(seed + np.array([step], dtype=np.uint64) * _M3)
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / length
        go = time <= first.reshape(n_docs, m).max(axis=1)[doc]
        doc, weight, low, length, seed, time, a = (x[go] for x in (doc, weight, low, length, seed, time, a))
        b = mix(a ^ _M2)
        place = low + ((b >> np.uint64(32)).astype(np.int64) & (length - 1))
        hit = place < weight
        slot = doc[hit] * m + (b[hit] & np.uint64(0xFFFFFFFF)).astype(np.int64) % m
        np.minimum.at(first, slot, time[hit])
        won = first[slot] == time[hit]
        identity[slot[won]] = b[hit][won]
    return identity.reshape(n_docs, m)


def _bands(signature: np.ndarray) -> np.ndarray:
    n = len(signature)
    out = np.broadcast_to(np.arange(1, N_BANDS + 1, dtype=np.uint64) * _M1, (n, N_BANDS)).copy()
    rows = signature.reshape(n, N_BANDS, BAND_ROWS)
    for r in range(BAND_ROWS):
        out = mix(out * _M3 + rows[:, :, r])
    return out.astype(np.int64)


def _node(elements: np.ndarray) -> bytes:
    """128 bits that name a multiset."""
    with np.errstate(over="ignore"):
        halves = [mix(elements ^ c).sum(dtype=np.uint64) for c in (_M1, _M2)]
    return b"".join(int(mix(np.array([h + np.uint64(len(elements))]))[0]).to_bytes(8, "big") for h in halves)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, h, node, n, bands``: a hash of a document's text, the name of its multiset, its size, and its band hashes."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Remembered(xxhash.xxh64_intdigest)
        for batch in (whole.iloc[s] for whole in batches for s in slices(whole["text"])):
            bags = [shingle_bag(t, known) for t in batch["text"]]
            sizes = [len(k) for k, _ in bags]
            made = bag_minhash(
                np.repeat(np.arange(len(bags)), sizes), np.concatenate([k for k, _ in bags] or [np.zeros(0, np.uint64)]),
                np.concatenate([c for _, c in bags] or [np.zeros(0, np.int64)]), len(bags), N_BANDS * BAND_ROWS,
            )
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].to_numpy(), "h": batch["h"].to_numpy(), "node": [_node(bag_elements(*bag)) for bag in bags],
                "n": [int(c.sum()) for _, c in bags], "bands": list(_bands(made)),
            })

    return _plain(docs).mapInPandas(sign, "doc_id long, h long, node binary, n long, bands array<long>")


def bags_of(docs: DataFrame) -> DataFrame:
    """``node, bag`` of the rows whose ``want`` is the name of their text's multiset."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Remembered(xxhash.xxh64_intdigest)
        for batch in (whole.iloc[s] for whole in batches for s in slices(whole["text"])):
            elements = [bag_elements(*shingle_bag(t, known)) for t in batch["text"]]
            keep = [k for k, e in enumerate(elements) if _node(e) == bytes(batch["want"].iloc[k])]
            if keep:
                yield pd.DataFrame({"node": [batch["want"].iloc[k] for k in keep], "bag": [elements[k].astype(np.int64) for k in keep]})

    return docs.mapInPandas(gather, "node binary, bag array<long>")


def _keys(doc_id: str = "doc_id", h: str = "h") -> list[Column]:
    """What tells rows of different texts apart, whether or not they have ids of their own."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias(doc_id), F.xxhash64(F.col("text").cast("string")).alias(h)]


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*_keys(), F.col("text").cast("string").alias("text"))


def overlap(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two bags."""
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    return (
        pairs.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
        .join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
        .select("a", "b", overlap(F.col("bag_a"), F.col("bag_b")).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )


def _can_reach(n: Column, m: Column, threshold: float) -> Column:
    """Bags of these sizes may have that similarity; beyond it no overlap would be enough."""
    return F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9


def _classed(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows' signatures; of every node ``label`` (its class), ``rep`` (its smallest doc_id, and hash), ``copies``; the links found."""
    signed = materialize(signatures(docs), "signed")
    nodes = signed.groupBy("node").agg(
        F.min(F.struct("doc_id", "h")).alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("bands").alias("bands")
    )
    in_band = nodes.where("n > 0").select("node", "n", "rep", F.explode("bands").alias("band"))
    crowded = in_band.groupBy("band").agg(F.count("*").alias("k")).where("k > 1").select("band")
    buckets = materialize(in_band.select("node", "n", "rep", F.col("band").alias("h")).join(crowded.withColumnRenamed("band", "h"), "h"), "buckets")
    # One text for each node, told by id and hash: a row meets the node of its own text alone. Both sides are tables,
    # so that very many equal rows are split between tasks.
    wanted = materialize(buckets.groupBy("node").agg(F.min("rep").alias("rep")).select("rep.doc_id", "rep.h", F.col("node").alias("want")), "wanted")
    bags = materialize(
        bags_of(_plain(docs).join(wanted.hint("shuffle_hash"), ["doc_id", "h"]).select("want", "text")).dropDuplicates(["node"]),
        "bags",
    )
    labels, links = _linked(buckets, bags, threshold)
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return signed, named, links


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, class_size, partner_id, similarity``.

    class_id is the smallest doc_id of the class, class_size its rows. partner_id is the smallest doc_id of the
    most similar text that was compared and is a near duplicate, and their similarity; where none but
    copies of the same words in the same order are there, their smallest doc_id, and 1; null where a row is alone.

    * Texts without a word (null, empty, white space alone) have equal, empty bags: one class.
    * Texts of fewer than five words are one shingle, so linked only to texts of the same words.
    * Rows that share a doc_id are classed by their own texts. A null doc_id counts as the
      smallest id and is returned as null. Similarity equal to the threshold is a link.
    * A text of any length is one bag, signed and compared as a whole.
    * Only doc_id and text are read; an empty table gives an empty result.
    """
    signed, named, links = _classed(docs, threshold)
    classes = named.groupBy("label").agg(F.min("rep.doc_id").alias("class_id"), F.sum("copies").alias("class_size"))
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other"), "similarity")
    ends = ends.union(links.select(F.col("b").alias("node"), F.col("a").alias("other"), "similarity"))
    best = ends.groupBy("node").agg(F.max(F.struct("similarity", "other")).alias("p")).select("node", "p.similarity", "p.other")
    best = best.join(named.select(F.col("node").alias("other"), F.col("rep.doc_id").alias("partner_id")), "other").drop("other")
    copies = F.col("copies") > 1
    by_node = named.join(classes, "label").join(best, "node", "left").select(
        "node", "class_id", "class_size",
        F.when(F.col("similarity").isNotNull(), F.col("partner_id")).when(copies, F.col("rep.doc_id")).alias("partner_id"),
        F.coalesce("similarity", F.when(copies, 1.0)).alias("similarity"),
    )
    whole = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return signed.select("doc_id", "node").join(materialize(by_node, "classes"), "node").select(
        whole("doc_id"), whole("class_id"), "class_size", whole("partner_id"), "similarity"
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: one of the smallest doc_id, of such rows one of the smallest hash of its text.

    A class is told by its row's doc_id and text, so rows that share a doc_id, or have none, stay or go by
    their own texts. Of rows equal in both, which differ in other columns at most, any one stays.
    All columns are returned as they are, whatever their names; an empty table gives an empty result.
    """
    signed, named, _ = _classed(docs, threshold)
    at, h = spare(docs, "_id", "_hash")
    first = materialize(named.groupBy("label").agg(F.min("rep").alias("k")).select(F.col("k.doc_id").alias(at), F.col("k.h").alias(h)), "first")
    rows = signed.groupBy(F.col("doc_id").alias(at), F.col("h").alias(h)).agg(F.count("*").alias("k"))
    kept = materialize(first.join(rows, [at, h]), "kept")
    keyed = docs.select("*", *_keys(at, h))
    alone = keyed.join(kept.where("k = 1").drop("k"), [at, h], "left_semi")
    several = kept.where("k > 1").drop("k")
    if several.isEmpty():
        return alone.select(*docs.columns)
    return alone.union(keyed.join(several, [at, h], "left_semi").dropDuplicates([at, h])).select(*docs.columns)


def _linked(buckets: DataFrame, bags: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """``node, label`` of every node that has a link, and the links ``a, b, similarity`` that show it."""
    links = tested = None
    mixed = buckets
    for turn in range(ROUNDS):
        rank = F.struct(F.xxhash64(F.lit(turn), "node").alias("r"), F.col("node").alias("node"), F.col("n").alias("n"))
        centre = materialize(mixed.groupBy("h").agg(F.min(rank).alias("c")), f"centre{turn}")
        pairs = (
            mixed.join(centre, "h")
            .where((F.col("node") != F.col("c.node")) & _can_reach(F.col("n"), F.col("c.n"), threshold))
            .select(F.col("c.node").alias("a"), F.col("node").alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, f"pairs{turn}")
        tested = pairs if tested is None else tested.union(pairs)
        found = _verified(pairs, bags, threshold)
        links = materialize(found if links is None else links.union(found), f"links{turn}")
        labels = connected_components(links)
        mixed = materialize(_still_mixed(buckets, labels), f"mixed{turn}")
        if mixed.isEmpty():
            return labels, links
    pairs = materialize(_missed(mixed, bags, threshold), "rest")
    # One partner for each node first: what that joins need not be compared any more.
    for end, other in (("a", "b"), ("b", "a")):
        one = pairs.groupBy(end).agg(F.min(F.struct(F.xxhash64("a", "b").alias("r"), F.col(other).alias(other))).alias("p"))
        found = _verified(one.select(end, F.col(f"p.{other}").alias(other)), bags, threshold)
        links = links.union(materialize(found, "links"))
    labels = connected_components(links)
    more = materialize(_verified(materialize(_apart(pairs, labels), "rest"), bags, threshold), "links")
    return (labels, links) if more.isEmpty() else (connected_components(links.union(more)), links.union(more))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different classes."""
    for end in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
    return pairs.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def _missed(mixed: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) of different classes among ``mixed`` that may still be similar, by prefixes and positions.

    Elements are ordered by how many of these bags hold them, rare ones first. If two bags of n and m
    elements are similar, their overlap is t / (1 + t) * (n + m) at least, so the first element
    that they share has that many elements from it on in either bag. A bag far from all others
    has so many elements of its own at the front that it meets nobody, however many bags there are.
    """
    nodes = mixed.select("node", "n", "label").distinct()
    elements = nodes.join(bags, "node").select("node", "n", "label", F.explode("bag").alias("e"))
    held = materialize(elements.groupBy("e").agg(F.count("*").alias("k")).where("k > 1"), "held")
    elements = elements.join(held, "e", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    rare_first = Window.partitionBy("node").orderBy("k", "e")
    prefix = materialize(
        elements.withColumn("i", F.row_number().over(rare_first) - 1)
        .where((F.col("k") > 1) & (F.col("n") - F.col("i") >= threshold * F.col("n") - 1e-9))
        .withColumn("past", F.collect_list("e").over(rare_first.rowsBetween(-PAST, -1)))
        .select("e", "node", "n", "label", "i", "past"),
        "prefix",
    )
    largest = nodes.groupBy("label").count().orderBy(F.desc("count"), "label").first()
    left, right = (prefix.select("e", *[F.col(c).alias(c + s) for c in ("node", "n", "label", "i", "past")]) for s in ("_a", "_b"))
    if largest is not None:  # two classes are never both the largest one
        left = left.where(F.col("label_a") != F.lit(bytes(largest["label"])))
    enough = threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-9
    return (
        left.join(right, "e")
        .where(
            (F.col("label_a") != F.col("label_b"))
            & _can_reach(F.col("n_a"), F.col("n_b"), threshold)
            & (F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) >= enough)
            # A pair that shares an earlier element has met there.
            & ~F.arrays_overlap("past_a", "past_b")
        )
        .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        .distinct()
    )


def _still_mixed(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    labelled = (
        buckets.select("h", "node", "n", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    )
    several = labelled.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("h")
    return labelled.join(several, "h")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
