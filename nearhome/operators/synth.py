"""Test tables of any size from integer arithmetic on keys: the same key always gives the same row.

Users come from a given table. A user gets 1 to ``per_user`` listings, a listing 1 to ``per_listing``
attachments, a user ``n`` interactions. Listing id = user id * per_user + slot, so links hold by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearhome.schemas import INTERACTION_TYPES, LEASE_DURATIONS, OLD_ROOMS, OLD_TYPES, ROLES, ROOMS, STATUS_ANNONCE, TYPE_ANNONCE, TYPE_BIEN

MODULUS = 2147483647
MULTIPLIER = 48271
STEP = 12345


def mixed(key: Column, salt: int) -> Column:
    """A number in [0, MODULUS) that looks random in ``key`` and differs by ``salt``; two rounds of x * a mod m."""
    once = F.pmod((key + salt * STEP + 1) * MULTIPLIER, F.lit(MODULUS))
    return F.pmod(once * MULTIPLIER, F.lit(MODULUS))


def pick(values: list[str], key: Column, salt: int) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.pmod(mixed(key, salt), F.lit(len(values))).cast("int"))


def between(key: Column, salt: int, low: int, high: int) -> Column:
    """A whole number from ``low`` to ``high``."""
    return F.pmod(mixed(key, salt), F.lit(high - low + 1)) + low


def _slots(df: DataFrame, count: Column, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)))


def user_roles(users: DataFrame) -> DataFrame:
    """One or both roles per user."""
    both = between(F.col("id"), 1, 1, 2) == 2
    one = F.array(pick(ROLES, F.col("id"), 2))
    return users.select(F.col("id").alias("user_id"), F.explode(F.when(both, F.array(*map(F.lit, ROLES))).otherwise(one)).alias("roles"))


def listings(users: DataFrame, per_user: int = 3) -> DataFrame:
    owned = _slots(users.select(F.col("id").alias("user_id")), between(F.col("user_id"), 3, 1, per_user), "slot")
    key = F.col("id")
    return owned.select((F.col("user_id") * per_user + F.col("slot")).alias("id"), "user_id").select(
        "id",
        F.concat(F.lit("Listing "), key.cast("string")).alias("titre"),
        F.concat(F.lit("Description of listing "), key.cast("string")).alias("description"),
        (between(key, 4, 1_000_000, 30_000_000) / 100.0).alias("prix"),
        pick(LEASE_DURATIONS, key, 5).alias("lease_duration"),
        pick(TYPE_ANNONCE, key, 6).alias("type"),
        pick(ROOMS, key, 7).alias("rooms"),
        (between(key, 8, -9_000, 9_000) / 100.0).alias("latitude"),
        (between(key, 9, -18_000, 18_000) / 100.0).alias("longitude"),
        pick(TYPE_BIEN, key, 10).alias("type_bien"),
        pick(STATUS_ANNONCE, key, 11).alias("status"),
        "user_id",
    )


def listings_old(keys: DataFrame) -> DataFrame:
    """The older listing shape, one row per id of ``keys``."""
    key = F.col("id")
    return keys.select(
        "id",
        F.concat(F.lit("Listing "), key.cast("string")).alias("title"),
        F.concat(F.lit("Description of listing "), key.cast("string")).alias("description"),
        (between(key, 20, 10_000_000, 50_000_000) / F.lit(100)).cast("decimal(10,2)").alias("price"),
        (between(key, 21, -9_000, 9_000) / 100.0).alias("latitude"),
        (between(key, 22, -18_000, 18_000) / 100.0).alias("longitude"),
        pick(OLD_TYPES, key, 23).alias("type"),
        pick(OLD_ROOMS, key, 24).alias("rooms"),
    )


def attachments(listing_ids: DataFrame, per_listing: int = 3) -> DataFrame:
    paths = _slots(listing_ids.select(F.col("id").alias("annonce_id")), between(F.col("annonce_id"), 12, 1, per_listing), "slot")
    name = F.concat_ws("-", F.lit("/uploads/listing"), F.col("annonce_id").cast("string"), F.col("slot").cast("string"))
    return paths.select("annonce_id", F.concat(name, F.lit(".jpg")).alias("attachment_paths"))


def interactions(users: DataFrame, n: int = 5, per_user: int = 3) -> DataFrame:
    """``n`` interactions per user, each with a listing of a user picked among the dense ids 0 .. count - 1."""
    total = users.agg(F.count("*").alias("total"))
    made = _slots(users.select(F.col("id").alias("user_id")), F.lit(n), "slot")
    key = F.col("id")
    owned = made.select((F.col("user_id") * n + F.col("slot")).alias("id"), "user_id").withColumn("owner", F.pmod(mixed(key, 13), total.scalar()))
    slot = F.pmod(mixed(key, 14), between(F.col("owner"), 3, 1, per_user))
    return owned.select(
        "id",
        "user_id",
        (F.col("owner") * per_user + slot).alias("annonce_id"),
        (between(key, 15, 10, 100) / 100.0).alias("interaction_score"),
        pick(INTERACTION_TYPES, key, 16).alias("interaction_type"),
    )
