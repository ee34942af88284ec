"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage


def _smallest(pairs: DataFrame) -> DataFrame:
    """For each node u of ``pairs`` (u, v): the smallest of u and its v. Aggregated before the shuffle, so a hub is one row a task here."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: bigint) -> (node, component) with the smallest node of each component; isolated nodes don't appear.

    A round maps each node's larger neighbours, then its smaller ones, to the smallest; a component becomes a star in
    O(log n) rounds. Every round is written to the shared folder. Edges, labels and counts stay distributed; only one (count, checksum) row
    a round reaches the driver. In the joins by node a hub's neighbours are one key: adaptive execution splits such a partition, since the other
    side has one row a node. Self loops, repeated edges and either direction are accepted; null ends are ignored.
    """
    edges = stage(
        edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        least = _smallest(large)
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.where("u != m").select("u", F.col("m").alias("v"))).distinct()
        grown = stage(small, "small-star")
        discard(edges, large)
        edges = grown
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
