"""Which users to notify about a listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhome.operators.prepare import rating_matrix
from nearhome.operators.ranking import top_per_key
from nearhome.operators.recommend import Recommender, item_scores
from nearhome.schemas import USERS_PER_LISTING
from nearhome.session import written


def distinct_lists(similar: DataFrame) -> DataFrame:
    """(list_id, ids): the different neighbour lists of (announce_id, similar_ids), in id order.

    The listings of a cluster mostly share one list, so everything below is done once per list. The lists are
    counted together before the shuffle, so one that a third of all listings share is no hot key here.
    """
    lists = _asked(similar).groupBy("ids").agg(F.min("announce_id").alias("list_id"))
    return written(lists, "similar-lists")


def listed_items(lists: DataFrame) -> DataFrame:
    """(annonce_id): the listings that occur as somebody's neighbour."""
    return written(lists.select(F.explode("ids").alias("annonce_id")).distinct(), "similar-items")


def observed_scores(interactions: DataFrame, users: DataFrame, items: DataFrame, n: int = USERS_PER_LISTING) -> DataFrame:
    """(annonce_id, user_id, score): the ``n`` known users with the best mean score of each listing in ``items``.

    Interactions with other listings are left out before anything is shuffled by user.
    """
    wanted = interactions.join(items, "annonce_id", "left_semi")
    scored = known_user_ratings(rating_matrix(wanted), users).withColumnRenamed("interaction_score", "score")
    top = top_per_key(written(_real(scored), "observed-scores"), ["annonce_id"], _best_first(), n, split_by="user_id")
    return top.select("annonce_id", "user_id", "score")


def predicted_scores(model: Recommender, items: DataFrame, n: int = USERS_PER_LISTING) -> DataFrame:
    """(annonce_id, user_id, score): the ``n`` users with the best ALS score of each listing in ``items`` the model knows.

    Train the model on ratings of known users only, see ``known_user_ratings``.
    """
    return _real(item_scores(model, items, n))


def known_user_ratings(ratings: DataFrame, users: DataFrame) -> DataFrame:
    return ratings.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")


OUT_ROWS = 1_000_000  # rows that one task gives out
SHARES = 32           # groups of listings among which a task's rows are divided, so that tasks come out even


def target_users(
    similar: DataFrame, lists: DataFrame, scores: DataFrame, n: int = USERS_PER_LISTING, out_rows: int = OUT_ROWS,
) -> DataFrame:
    """(announce_id, user_id, score, rank): the ``n`` users with the highest score over the similar listings.

    ``lists`` are the distinct lists of ``similar``. ``scores`` needs only the ``n`` best users per listing:
    a user whose best score is at listing i and who is not among the ``n`` best there has ``n`` users ahead.
    The users of a list travel as one row. What comes out is up to ``n`` times as many rows as go in, so the listings are
    spread before: those of a list are divided into groups by how many rows they will make, and so are the tasks.
    """
    members = lists.select("list_id", F.explode("ids").alias("annonce_id"))
    # a list has at most its length times ``n`` rows, so one shuffle by list serves the maximum and the ranking
    reached = members.join(scores, "annonce_id").repartition("list_id")
    best = reached.groupBy("list_id", "user_id").agg(F.max("score").alias("score"))
    ranked = top_per_key(best, ["list_id"], _best_first(), n)
    in_order = F.array_sort(F.collect_list(F.struct("rank", "user_id", "score")))
    packed = written(ranked.groupBy("list_id").agg(in_order.alias("users")), "ranked-users")
    asked = written(_asked(similar).join(lists, "ids").select("announce_id", "list_id"), "asked-lists")
    loads = asked.groupBy("list_id").agg(F.count("*").alias("members")).join(packed.select("list_id", F.size("users").alias("width")), "list_id")
    loads = written(loads.select("list_id", (F.col("members") * F.col("width")).alias("rows")), "list-loads")
    tasks = max(1, -(-(loads.agg(F.sum("rows")).first()[0] or 0) // out_rows))
    groups = loads.select("list_id", F.ceil(F.col("rows") * SHARES / out_rows).alias("groups"))
    group = F.pmod(F.xxhash64("announce_id"), F.col("groups"))
    left = asked.join(groups, "list_id").select("announce_id", "list_id", group.alias("group"))
    right = packed.join(groups, "list_id").select("list_id", "users", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"))
    return (
        left.repartition(tasks, "list_id", "group").join(right.repartition(tasks, "list_id", "group").hint("shuffle_hash"), ["list_id", "group"])
        .select("announce_id", F.inline("users").alias("rank", "user_id", "score"))
        .select("announce_id", "user_id", "score", "rank")
    )


def notifications(targets: DataFrame) -> DataFrame:
    return targets.select("announce_id", "user_id")


def not_yet_sent(candidates: DataFrame, sent: DataFrame) -> DataFrame:
    """Notifications that the ledger of sent ones does not hold, so a rerun notifies nobody twice."""
    return candidates.join(sent.select("announce_id", "user_id").distinct(), ["announce_id", "user_id"], "left_anti")


def _asked(similar: DataFrame) -> DataFrame:
    return similar.select("announce_id", F.array_sort(F.array_distinct("similar_ids")).alias("ids"))


def _best_first() -> list:
    return [F.col("score").desc(), F.col("user_id")]


def _real(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("score").isNotNull() & ~F.isnan("score"))
