"""Connected components of a distributed list of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhome.session import written


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; the root is the smallest node of its component, itself included.

    ``links`` has the columns ``a`` and ``b``. Each round hangs every larger neighbour of a node, then every smaller one,
    on the smallest neighbour; a round is written to the shared folder and read back. The rounds end when nothing
    changes, after about log n of them. Minima are aggregated before the shuffle, and the joins are plain equi-joins, so a
    node with very many links is split by AQE.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = written(edges, "stars"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        edges = _small_star(written(_large_star(edges), "large-star"))
        edges = written(edges, "stars")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(written(lowest, "lowest"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = written(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")
    moved = edges.join(lowest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
