"""Model freshness and the versions of saved models."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhome.schemas import MODEL_METADATA, RETRAIN_AFTER
from nearhome.sources.versioned import read_if_exists


LOWEST_ID = -(2 ** 63)


def last_id(listings: DataFrame) -> DataFrame:
    """One row with the highest listing id, null for an empty table."""
    return listings.agg(F.max("id").alias("last_id"))


def retrain_check(listings: DataFrame, trained_to: DataFrame, threshold: int = RETRAIN_AFTER) -> DataFrame:
    """(last_id, new_listings, retrain): retrain when ``threshold`` listings came after the last trained id.

    ``trained_to`` is the one-row table of ``last_id``. Without a trained id every listing is new.
    """
    trained = trained_to.agg(F.max("last_id").alias("last_id"))
    first_new = trained.select(F.coalesce(F.col("last_id") + 1, F.lit(LOWEST_ID)))
    counted = listings.filter(F.col("id") >= first_new.scalar()).agg(F.count("*").alias("new_listings"))
    return counted.select(
        trained.scalar().alias("last_id"), "new_listings", (F.col("new_listings") >= threshold).alias("retrain"),
    )


def saved_versions(spark: SparkSession, root: str) -> DataFrame | None:
    """The versions whose training finished, or None."""
    return read_if_exists(spark, f"{root}/versions", MODEL_METADATA)


def save_model(spark: SparkSession, model, root: str, trained_to: int | None) -> int:
    """Saves the model under a new version. The version row is written last, so a half-saved model is never used."""
    known = saved_versions(spark, root)
    newest = known.agg(F.max("version")).first()[0] if known is not None else None
    version = (newest or 0) + 1
    path = f"{root}/model-{version}"
    model.write().overwrite().save(path)
    row = [(version, trained_to, path, datetime.now(timezone.utc))]
    spark.createDataFrame(row, MODEL_METADATA).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def load_or_train(
    spark: SparkSession,
    listings: DataFrame,
    root: str,
    train: Callable[[DataFrame], object],
    load: Callable[[str], object],
    threshold: int = RETRAIN_AFTER,
    catalogue: DataFrame | None = None,
) -> tuple[object, int]:
    """(model, version): the newest saved model, or a new one when there is none, it is stale or cannot be read.

    It is stale by ``retrain_check`` over ``catalogue``, which may hold listings that cannot be trained on.
    """
    known = saved_versions(spark, root)
    if known is not None:
        current = known.orderBy(F.col("version").desc()).first()
        trained_to = known.filter(F.col("version") == current["version"]).select("last_id")
        if not retrain_check(catalogue if catalogue is not None else listings, trained_to, threshold).first()["retrain"]:
            try:
                return load(current["path"]), current["version"]
            except Exception as broken:  # a damaged model is replaced by a fresh one
                print(f"model version {current['version']} cannot be read, training again: {broken}")
    model = train(listings)
    return model, save_model(spark, model, root, last_id(listings).first()[0])
