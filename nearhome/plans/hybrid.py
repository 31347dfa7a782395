"""The hybrid flow: a new listing, its neighbours, the users to notify."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhome.operators.neighbors import price_neighbors
from nearhome.operators.prepare import complete_listings
from nearhome.operators.recommend import Recommender
from nearhome.operators.targeting import (
    distinct_lists, listed_items, not_yet_sent, notifications, observed_scores, predicted_scores, target_users,
)
from nearhome.schemas import NEIGHBOURS, USERS_PER_LISTING


def similar_lists(listings: DataFrame, cluster: str, k: int = NEIGHBOURS) -> DataFrame:
    """(announce_id, similar_ids) by price inside the given cluster column."""
    return price_neighbors(listings, cluster, k).select(F.col("id").alias("announce_id"), "similar_ids")


def targets_by_observed(similar: DataFrame, interactions: DataFrame, users: DataFrame, n: int = USERS_PER_LISTING) -> DataFrame:
    """(announce_id, user_id, score, rank) with the users' own mean scores of the similar listings."""
    lists = distinct_lists(similar)
    return target_users(similar, lists, observed_scores(interactions, users, listed_items(lists), n), n)


def targets_by_model(similar: DataFrame, model: Recommender, n: int = USERS_PER_LISTING) -> DataFrame:
    """(announce_id, user_id, score, rank) with the scores that ALS predicts for the similar listings."""
    lists = distinct_lists(similar)
    return target_users(similar, lists, predicted_scores(model, listed_items(lists), n), n)


def hybrid_notify(
    listings: DataFrame,
    interactions: DataFrame,
    users: DataFrame,
    cluster: str,
    k: int = NEIGHBOURS,
    n: int = USERS_PER_LISTING,
    exclude_seen: bool = False,
) -> DataFrame:
    """(announce_id, user_id) to notify; with ``exclude_seen`` without users who already know the listing."""
    similar = similar_lists(complete_listings(listings), cluster, k)
    found = notifications(targets_by_observed(similar, interactions, users, n))
    if not exclude_seen:
        return found
    return not_yet_sent(found, interactions.select(F.col("annonce_id").alias("announce_id"), "user_id"))
