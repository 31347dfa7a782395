"""The cheapest listings of every cluster, kept up to date without reading the catalogue.

A cluster's state is a bounded list of its cheapest listings, some more than are answered, and the limit up to which that list is known
to be complete. New and changed listings at or below the limit enter, those that leave go out, and the list is cut again. Only when
more have left than the reserve holds is a cluster read from the catalogue once more. States of two parts of a catalogue can be merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearhome.operators.ranking import top_per_key
from nearhome.schemas import NEIGHBOURS
from nearhome.session import written

RESERVE = 4  # times as many listings as are answered


def size_for(k: int) -> int:
    return RESERVE * (k + 1)


def head_state(listings: DataFrame, cluster: str, k: int = NEIGHBOURS) -> DataFrame:
    """(cluster, best, limit): the cheapest of every cluster of (id, prix and the cluster), as (prix, id) in order.

    ``limit`` is the last of them where others are left out, null where the list is the whole cluster.
    """
    return _cut(listings.select(F.col(cluster).alias("cluster"), "prix", "id").dropna(), None, k)


def _cut(rows: DataFrame, limits: DataFrame | None, k: int) -> DataFrame:
    """The first rows of every cluster; one row more shows whether any is left out. ``limits`` (cluster, limit) hold already."""
    size = size_for(k)
    first = top_per_key(rows, ["cluster"], [F.col("prix"), F.col("id")], size + 1)
    lists = first.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("prix", "id"))).alias("best"))
    cut = F.slice("best", 1, size)
    own = F.when(F.size("best") > size, F.element_at(cut, -1))
    if limits is None:
        return lists.select("cluster", cut.alias("best"), own.alias("limit"))
    joined = limits.join(lists, "cluster", "full")
    best = F.coalesce(cut, F.array().cast("array<struct<prix:double,id:bigint>>"))
    return joined.select("cluster", best.alias("best"), F.coalesce(own, F.col("limit")).alias("limit"))


def _entries(state: DataFrame) -> DataFrame:
    return state.select("cluster", F.inline("best")).select("cluster", "prix", "id")


def _within(limit: Column) -> Column:
    """Whether a listing may enter: beyond the limit others may be cheaper that the list does not hold."""
    return limit.isNull() | (F.struct("prix", "id") <= limit)


def updated(state: DataFrame, changes: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``state`` after ``changes`` (id, cluster, prix): a listing's new cluster and price, or nulls where it has left.

    A listing occurs once in ``changes``; what the state holds of it is replaced. Only changes of known or new clusters are touched.
    """
    changes = written(changes.select("id", "cluster", F.col("prix").cast("double").alias("prix")), "head-changes")
    old = _entries(state).join(changes.select("id"), "id", "left_anti").select("cluster", "prix", "id")
    limits = state.select("cluster", "limit")
    new = changes.dropna().join(limits, "cluster", "left").filter(_within(F.col("limit"))).select("cluster", "prix", "id")
    return _cut(old.unionByName(new), limits, k)


def merged(one: DataFrame, other: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The state of two parts of a catalogue that share no listing: complete up to the lower of two limits."""
    both = one.unionByName(other)
    limits = both.groupBy("cluster").agg(F.min("limit").alias("limit"))  # a list without a limit is complete
    rows = _entries(both).join(limits, "cluster").filter(_within(F.col("limit"))).select("cluster", "prix", "id")
    return _cut(rows, limits, k)


def exhausted(state: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(cluster): those whose list has become too short to answer, though the cluster may hold more."""
    return state.filter(F.col("limit").isNotNull() & (F.size("best") < k + 1)).select("cluster")


def refilled(state: DataFrame, listings: DataFrame, cluster: str, k: int = NEIGHBOURS) -> DataFrame:
    """``state`` with the exhausted clusters read from the catalogue again; no other cluster is."""
    short = written(exhausted(state, k), "head-exhausted")
    again = head_state(listings.join(short.withColumnRenamed("cluster", cluster), cluster, "left_semi"), cluster, k)
    return state.join(short, "cluster", "left_anti").unionByName(again)


def heads(state: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(cluster, head): as ``neighbors.cluster_heads`` gives them; exhausted clusters must have been refilled."""
    return state.filter(F.size("best") > 0).select("cluster", F.slice(F.col("best")["id"], 1, k + 1).alias("head"))
