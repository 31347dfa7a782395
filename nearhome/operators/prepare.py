"""Listing preparation and the rating matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhome.functions.exact import limb_names, limb_sums, total
from nearhome.functions.scores import interaction_weight
from nearhome.schemas import FEATURE_COLUMNS


def complete_listings(listings: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Listings without a null or NaN in the feature columns."""
    return listings.dropna(subset=list(columns))


def category_cardinality(listings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, n_values, in_model) in one pass; only a column with two or more values enters the model."""
    counts = listings.agg(*[F.count_distinct(c).alias(c) for c in columns])
    named = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_values")) for c in columns])
    return counts.select(F.inline(named)).withColumn("in_model", F.col("n_values") >= 2)


def rating_state(interactions: DataFrame) -> DataFrame:
    """(user_id, annonce_id, n, odd, limbs of the sum): what the means of a batch are made of; states of batches add up.

    ``n`` counts the scores, ``odd`` those that are NaN or infinite. Scores are single-precision.
    """
    score = F.col("score")
    finite = F.abs(score) < float("inf")  # NaN sorts above infinity
    return (
        interactions
        .select(
            F.col("user_id").cast("long").alias("user_id"),
            F.col("annonce_id").cast("long").alias("annonce_id"),
            F.col("interaction_score").cast("float").alias("score"),
        )
        .groupBy("user_id", "annonce_id")
        .agg(F.count("score").alias("n"), F.count_if(score.isNotNull() & ~finite).alias("odd"), *limb_sums(F.when(finite, score), "sum"))
    )


def merged_states(states: DataFrame) -> DataFrame:
    """One row per (user, listing) of the rows of several states."""
    return states.groupBy("user_id", "annonce_id").agg(*[F.sum(c).alias(c) for c in ("n", "odd", *limb_names("sum"))])


def ratings_of(state: DataFrame) -> DataFrame:
    """(user_id, annonce_id, interaction_score): the mean score; NaN where a score is NaN or infinite, null without any."""
    mean = F.try_divide(total("sum"), "n")
    return state.select("user_id", "annonce_id", F.when(F.col("odd") > 0, F.lit(float("nan"))).otherwise(mean).alias("interaction_score"))


def rating_matrix(interactions: DataFrame) -> DataFrame:
    """Mean score per (user, listing) over the scores there are, from sums that lose nothing, whatever their sizes and order."""
    return ratings_of(rating_state(interactions))


def weighted_rating_matrix(interactions: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rating matrix with the score taken from the interaction type; without ``weights`` ratings keep their own score."""
    rated = F.col("interaction_score") if weights is None else None
    return rating_matrix(interactions.withColumn("interaction_score", interaction_weight(F.col("interaction_type"), weights, rated=rated)))


def usable_ratings(ratings: DataFrame) -> DataFrame:
    """Ratings with both ids and a real score, which is a float for ALS."""
    rows = ratings.select("user_id", "annonce_id", F.col("interaction_score").cast("float").alias("interaction_score"))
    return rows.dropna()  # NaN counts as missing


def als_rejects(ratings: DataFrame) -> DataFrame:
    """One row: the number of ratings, of ids beyond 32 bits, which ALS meets under dense numbers, and of ratings without a score."""
    wide = lambda c: F.col(c).isNotNull() & F.col(c).try_cast("int").isNull()
    return ratings.agg(
        F.count("*").alias("n_ratings"),
        F.count_if(wide("user_id")).alias("user_out_of_range"),
        F.count_if(wide("annonce_id")).alias("listing_out_of_range"),
        F.count_if(F.col("interaction_score").isNull() | F.isnan("interaction_score")).alias("no_score"),
    )
