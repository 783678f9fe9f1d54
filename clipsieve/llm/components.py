"""Connected components of a distributed edge list: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clipsieve.llm.common import written


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """One star step.  Every node's neighbours above it (large) or not above it (small) move to its smallest neighbour."""
    both = edges if not large else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.join(least, "a").select(F.col("b").alias("u"), "m", "a")
    if large:
        out = moved.where("u > a").select(F.col("u").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("u").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` pairs in; ``node, component`` out for every node with an edge, the component being its smallest node.

    Each round is written to shared storage; the driver sees a count and a checksum of a round only.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = None
    while True:
        pairs = written(_starred(_starred(pairs, True), False), "stars")
        now = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            break
        state = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
