"""The provided test tables seen as the marketplace tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.col("p_name").alias("titre"),
        F.col("p_retailprice").alias("prix"),
        F.col("p_type").alias("type_bien"),
        F.col("p_brand").alias("lease_duration"),
        (F.pmod(key * 7919, F.lit(18000)) / 100.0 - 90).alias("latitude"),
        (F.pmod(key * 104729, F.lit(36000)) / 100.0 - 180).alias("longitude"),
    )


def listing_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listings, some with a missing price or type or a NaN latitude."""
    key = F.col("id")
    return listing(spark, sf_dir).withColumns({
        "prix": F.when(key % 17 != 0, F.col("prix")),
        "latitude": F.when(key % 19 == 0, F.lit(float("nan"))).otherwise(F.col("latitude")),
        "type_bien": F.when(key % 23 != 0, F.col("type_bien")),
    })


def user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


def interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "user_id",
        F.get_json_object("props", "$.k").try_cast("long").alias("annonce_id"),
        F.col("value").cast("float").alias("interaction_score"),
        F.col("event_type").alias("interaction_type"),
        F.col("ts").alias("interaction_date"),
    )


def interaction_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All interactions, some with an unknown user, a missing score or a type outside the domain."""
    key = F.col("id")
    return interaction(spark, sf_dir).withColumns({
        "user_id": F.when(key % 97 == 0, F.lit(-1)).otherwise(F.col("user_id")),
        "interaction_score": F.when(key % 89 != 0, F.col("interaction_score")),
        "interaction_type": F.when(key % 83 == 0, F.lit("BAD")).otherwise(F.col("interaction_type")),
    })


def interaction_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All interactions with the declared type names."""
    kind = F.col("interaction_type")
    names = {"view": "VIEW", "click": "SAVE", "purchase": "CONTACT", "signup": "RATING"}
    named = F.lit("OTHER")
    for old, new in names.items():
        named = F.when(kind == old, F.lit(new)).otherwise(named)
    return interaction(spark, sf_dir).withColumn("interaction_type", named)


def purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as interactions; the ordered quantity is the score."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("annonce_id"),
        F.col("l_quantity").cast("float").alias("interaction_score"),
    )


def saved_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved search of every customer; a third of them look around one place. Some have no radius, no price bound or no type."""
    key, types = F.col("c_custkey"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("type"))
    n_parts = types.count()
    rows = table(spark, sf_dir, "customer").withColumn("part", F.pmod(key * 31, F.lit(n_parts)))
    low = 900.0 + F.pmod(key * 13, F.lit(1000))
    hot = key % 3 == 0
    return rows.join(types, "part").select(
        key.alias("id"), key.alias("user_id"),
        F.when(key % 11 != 0, low).alias("min_prix"), F.when(key % 13 != 0, low + F.pmod(key, F.lit(200))).alias("max_prix"),
        F.when(hot, 48.85 + (key % 7) / 100.0).otherwise(F.pmod(key * 7919, F.lit(18000)) / 100.0 - 90).alias("latitude"),
        F.when(hot, 2.35 + (key % 5) / 100.0).otherwise(F.pmod(key * 104729, F.lit(36000)) / 100.0 - 180).alias("longitude"),
        F.when(key % 29 != 0, 50.0 + F.pmod(key, F.lit(1500))).alias("radius"),
        F.when(key % 4 == 0, F.col("type")).alias("type_bien"),
    )


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("vec"),
    )
