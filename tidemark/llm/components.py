"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize


def _directed(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end ``u`` to its smaller end ``v``."""
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, label``: each end of ``links`` (columns a, b) with the smallest node of its component.

    Each step is joins and minima over the edges; minima are taken map-side first, so a node with
    very many links costs no single task more than its share. Rounds go on until the edges stay as
    they are (their number, and the sum and the exclusive or of their 64-bit hashes), about the logarithm of the
    longest chain. No edges: an empty result.
    """
    edges = materialize(_directed(links), "edges")
    before, hashed = None, F.xxhash64("u", "v")
    while True:
        after = edges.agg(F.count("*").alias("n"), F.sum(hashed.cast("decimal(20)")).alias("s"), F.bit_xor(hashed).alias("x")).first()
        if after == before or not after["n"]:
            break
        before = after
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
