"""Scores that fade with time, kept as sums that are added up across days without reading the history again.

An interaction of ``age`` days counts ``2 ** (-age / half_life)`` times. The days are divided into periods of one half-life. A state holds,
per (user, listing) and period, the scores as they would count at the period's end as seen from its first day, so it does not depend on
the day that is asked about; states of any days add up, and at a given day every period is halved as often as it lies back.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_LIFE = 7  # days
START = date(1970, 1, 1)


def day_of(moment: Column) -> Column:
    return F.datediff(moment, F.lit(START)).cast("long")


def decay_state(interactions: DataFrame, half_life: int = HALF_LIFE) -> DataFrame:
    """(user_id, annonce_id, period, total, weight) of interactions with a score and a date; other rows and NaN scores drop out."""
    rows = interactions.select(
        F.col("user_id").cast("long").alias("user_id"), F.col("annonce_id").cast("long").alias("annonce_id"),
        F.col("interaction_score").cast("double").alias("score"), day_of(F.col("interaction_date")).alias("day"),
    ).filter(F.abs("score") < float("inf")).dropna(subset=["day"])
    period = F.floor(F.col("day") / half_life)
    share = F.pow(F.lit(2.0), (F.col("day") - period * half_life) / F.lit(half_life))
    return rows.groupBy("user_id", "annonce_id", period.alias("period")).agg(F.sum(F.col("score") * share).alias("total"), F.sum(share).alias("weight"))


def merged_decay(states: DataFrame) -> DataFrame:
    return states.groupBy("user_id", "annonce_id", "period").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight"))


def decayed_scores(state: DataFrame, at: date, half_life: int = HALF_LIFE) -> DataFrame:
    """(user_id, annonce_id, decayed, interaction_score) at a day no earlier than the state's: the faded sum and the faded mean."""
    halved = F.pow(F.lit(2.0), (F.col("period") * half_life - day_of(F.lit(at))) / F.lit(half_life))
    sums = state.groupBy("user_id", "annonce_id").agg(F.sum(F.col("total") * halved).alias("decayed"), F.sum(F.col("weight") * halved).alias("faded"))
    return sums.select("user_id", "annonce_id", "decayed", (F.col("decayed") / F.col("faded")).alias("interaction_score"))
