"""Collaborative filtering: the best listings for every user."""

from __future__ import annotations

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhome.operators.inner_product import top_lists, top_products
from nearhome.operators.numbering import numbered
from nearhome.operators.prepare import usable_ratings
from nearhome.schemas import ALS_ITERATIONS, ALS_RANK, ALS_REG, LISTINGS_PER_USER
from nearhome.session import shared_dir, shuffles_removed, written

BLOCK_RATINGS = 4_000_000
MOST_IDS = 2**31 - 1


class Recommender:
    """An ALS model over dense numbers, with the tables that tell whose they are, so that ids may be any long.

    ``users`` is (user_id, user_no), ``listings`` is (annonce_id, listing_no). Saved and loaded like Spark's own models.
    """

    def __init__(self, model: ALSModel, users: DataFrame, listings: DataFrame):
        self.model, self.users, self.listings = model, users, listings

    def write(self) -> Recommender:
        return self

    def overwrite(self) -> Recommender:
        return self

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/als")
        self.users.write.mode("overwrite").parquet(f"{path}/users")
        self.listings.write.mode("overwrite").parquet(f"{path}/listings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Recommender:
        return cls(ALSModel.load(f"{path}/als"), spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/listings"))


def blocks_for(n_ratings: int) -> int:
    """Blocks of users and of listings, about ``BLOCK_RATINGS`` ratings each."""
    return max(10, -(-n_ratings // BLOCK_RATINGS))


def dense_ids(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(user_id, user_no) and (annonce_id, listing_no): the ids of either kind numbered from 0 in order, in one pass."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("id")) for kind, c in enumerate(("user_id", "annonce_id"))])
    placed = numbered(ratings.select(F.inline(kinds)).distinct(), [F.col("kind"), F.col("id")], "place", "als-ids")
    first = placed.groupBy("kind").agg(F.min("place").alias("first"))  # two rows
    ids = written(placed.join(first, "kind").select("kind", "id", (F.col("place") - F.col("first")).alias("number")), "als-numbers")
    if (ids.agg(F.max("number")).first()[0] or 0) >= MOST_IDS:
        raise ValueError(f"ALS takes at most {MOST_IDS} different users and listings")
    of = lambda kind, key, number: ids.filter(F.col("kind") == kind).select(F.col("id").alias(key), F.col("number").cast("int").alias(number))
    return of(0, "user_id", "user_no"), of(1, "annonce_id", "listing_no")


def fit_als(ratings: DataFrame, seed: int = 42, blocks: int | None = None, checkpoint_interval: int = 1) -> Recommender:
    """ALS on explicit ratings. Pairs with a user or listing unknown to the model are dropped when scored.

    Every ``checkpoint_interval`` iterations Spark cuts the lineage of the factors in ``spark.checkpoint.dir`` and removes the shuffles before;
    those of all iterations in between lie on the disks at once. The factors do not depend on it.
    Without ``blocks`` their number follows the number of ratings.
    """
    shared_dir(ratings.sparkSession)  # in local mode this also names a checkpoint folder
    with shuffles_removed(ratings.sparkSession):
        usable = written(usable_ratings(ratings), "als-ratings")
        users, listings = dense_ids(usable)
        dense = usable.join(users, "user_id").join(listings, "annonce_id").select("user_no", "listing_no", "interaction_score")
        dense = written(dense, "als-dense")
    blocks = blocks or blocks_for(usable.count())
    als = ALS(
        userCol="user_no", itemCol="listing_no", ratingCol="interaction_score",
        rank=ALS_RANK, maxIter=ALS_ITERATIONS, regParam=ALS_REG, coldStartStrategy="drop", seed=seed,
        numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=checkpoint_interval,
    )
    return Recommender(als.fit(dense), users, listings)


def pair_scores(recommender: Recommender, pairs: DataFrame) -> DataFrame:
    """(user_id, annonce_id, prediction) of the pairs whose user and listing the model knows."""
    known = pairs.select("user_id", "annonce_id").join(recommender.users, "user_id").join(recommender.listings, "annonce_id")
    scored = recommender.model.transform(known).select("user_id", "annonce_id", "prediction")
    return scored.filter(F.col("prediction").isNotNull() & ~F.isnan("prediction"))


def factors(recommender: Recommender) -> tuple[DataFrame, DataFrame]:
    """(user_id, vec) and (item_id, vec): the factors under the ids they belong to."""
    users = recommender.model.userFactors.join(recommender.users, F.col("id") == F.col("user_no"))
    listings = recommender.model.itemFactors.join(recommender.listings, F.col("id") == F.col("listing_no"))
    return users.select("user_id", F.col("features").alias("vec")), listings.select(F.col("annonce_id").alias("item_id"), F.col("features").alias("vec"))


def user_recommendations(recommender: Recommender, n: int = LISTINGS_PER_USER) -> DataFrame:
    """(user_id, annonce_id, rating, rank): the ``n`` best listings of every user, seen ones included."""
    best = top_products(*factors(recommender), n)
    return best.select("user_id", F.col("item_id").alias("annonce_id"), F.col("score").cast("float").alias("rating"), "rank")


def user_lists(recommender: Recommender, n: int = LISTINGS_PER_USER) -> DataFrame:
    """(user_id, listings, ratings): what ``user_recommendations`` gives, as one row a user."""
    lists = top_lists(*factors(recommender), n)
    return lists.select("user_id", F.col("items").alias("listings"), F.col("scores").cast("array<float>").alias("ratings"))


def item_scores(recommender: Recommender, items: DataFrame, n: int) -> DataFrame:
    """(annonce_id, user_id, score): the ``n`` users with the best score of each listing in ``items`` the model knows."""
    known = items.select("annonce_id").join(recommender.listings, "annonce_id").select("listing_no")
    best = recommender.model.recommendForItemSubset(known, n).select("listing_no", F.inline("recommendations").alias("user_no", "score"))
    return best.join(recommender.users, "user_no").join(recommender.listings, "listing_no").select("annonce_id", "user_id", "score")


def unseen_only(recommendations: DataFrame, ratings: DataFrame) -> DataFrame:
    """Recommendations without the listings a user already interacted with."""
    return recommendations.join(ratings.select("user_id", "annonce_id").distinct(), ["user_id", "annonce_id"], "left_anti")
