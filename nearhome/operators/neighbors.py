"""Similar listings inside a cluster, ranked by price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhome.operators.ranking import top_per_key
from nearhome.schemas import NEIGHBOURS
from nearhome.session import written


def cluster_heads(listings: DataFrame, cluster: str, k: int = NEIGHBOURS) -> DataFrame:
    """(cluster, head): the k + 1 cheapest listing ids of every cluster, cheapest first, ties by id.

    The price order does not depend on the listing asked about, so one more id than needed covers the case
    that the listing is itself among the cheapest.
    """
    members = listings.select(F.col(cluster).alias("cluster"), "id", "prix").dropna()
    cheapest = top_per_key(members, ["cluster"], [F.col("prix"), F.col("id")], k + 1)
    in_order = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return cheapest.groupBy("cluster").agg(in_order["id"].alias("head"))


def others_of(asked: DataFrame, heads: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(id, cluster, similar_ids) of (id, cluster): the head of the cluster without the listing itself."""
    others = F.filter("head", lambda x: x != F.col("id"))
    return asked.join(heads, "cluster").select("id", "cluster", F.slice(others, 1, k).alias("similar_ids"))


def price_neighbors(listings: DataFrame, cluster: str, k: int = NEIGHBOURS, queries: DataFrame | None = None) -> DataFrame:
    """(id, cluster, similar_ids): up to ``k`` other listings of the same cluster, cheapest first.

    ``queries`` are the listings asked about; by default all of them. A listing alone in its cluster gets
    an empty array. The heads table is tiny next to the listings and is written first, so Catalyst decides
    on a broadcast from its true size.
    """
    heads = written(cluster_heads(listings, cluster, k), "cluster-heads")
    asked = (listings if queries is None else queries).select("id", F.col(cluster).alias("cluster"))
    return others_of(asked, heads, k)


def neighbor_pairs(neighbors: DataFrame) -> DataFrame:
    """(id, rank, similar_id): one row per neighbour, rank from 1."""
    return (
        neighbors
        .select("id", F.posexplode("similar_ids").alias("pos", "similar_id"))
        .select("id", (F.col("pos") + 1).alias("rank"), "similar_id")
    )
