"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobbylens.llm.common import stash

#: Parts that the links of one node are dealt to.
PARTS = 32


def _spread(links: DataFrame, lows: DataFrame) -> DataFrame:
    """Links (u, v) with the value m of u. A hub's links lie on several tasks, each with a copy of its value."""
    dealt = links.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(PARTS)))
    copies = dealt.select("u", "part").distinct().join(lows, "u")
    return dealt.join(copies, ["u", "part"]).drop("part")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node with a link; comp is the smallest node it can reach.

    links: two long columns u, v. Each round hangs neighbours onto the smallest node in
    sight, first those above a node, then those below, until nothing moves; the number of
    rounds grows with the logarithm of the longest path. Smallest neighbours are aggregated
    before they move, and a hub's links are dealt to several tasks for the joins back.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stash(edges, "links")
    mark = None
    while True:
        # Large star: everything above a node moves to the smallest node next to it.
        both = edges.union(edges.select("v", "u"))
        lows = stash(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
        moved = _spread(both.where("v > u"), lows).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        moved = stash(moved, "large-links")
        # Small star: a node and its smaller neighbours move to the smallest of them.
        lows = stash(moved.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        near = _spread(moved, lows)
        edges = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lows.select("u", "m"))
        edges = stash(edges.where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
