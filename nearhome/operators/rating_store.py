"""The rating matrix kept up to date batch by batch, without reading the history again.

A folder holds one state a batch (see ``prepare.rating_state``) and a base into which older ones have been merged. Sums are exact, so
the matrix is the same for any division of the interactions into batches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhome.operators.prepare import merged_states, rating_state, ratings_of
from nearhome.session import remove_path
from nearhome.sources import versioned


def fold(interactions: DataFrame, root: str, batch: int) -> None:
    """Adds the interactions of a batch; a repeated batch replaces its own state. Batches have growing numbers."""
    rating_state(interactions).write.mode("overwrite").parquet(f"{root}/batches/batch={batch}")


def state(spark: SparkSession, root: str) -> DataFrame | None:
    """The merged state of the base and of all batches behind it, or None before the first."""
    base, later = versioned.read_current(spark, f"{root}/base"), _batches(spark, root)
    if base is None and later is None:
        return None
    if base is None:
        return merged_states(later)
    rows = base.drop("through")
    if later is not None:
        through = base.agg(F.max("through")).first()[0]
        later = later.filter(F.col("batch") > F.lit(-1 if through is None else through))
        rows = rows.unionByName(later.drop("batch"))
    return merged_states(rows)


def ratings(spark: SparkSession, root: str) -> DataFrame | None:
    found = state(spark, root)
    return None if found is None else ratings_of(found)


def compact(spark: SparkSession, root: str) -> None:
    """Merges all batches there are into the next version of the base; readers see the old one or the new one."""
    later = _batches(spark, root)
    if later is not None:
        newest = later.agg(F.max("batch")).first()[0]
        versioned.publish(state(spark, root).withColumn("through", F.lit(newest).cast("long")), f"{root}/base")


def remove_folded(spark: SparkSession, root: str) -> None:
    """Deletes the batches that the base holds; readers that began before it was published must have ended."""
    base, later = versioned.read_current(spark, f"{root}/base"), _batches(spark, root)
    if base is not None and later is not None:
        through = base.agg(F.max("through")).first()[0]
        for row in later.select("batch").distinct().filter(F.col("batch") <= through).collect():  # a row a batch
            remove_path(spark, f"{root}/batches/batch={row['batch']}")


def _batches(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        rows = spark.read.parquet(f"{root}/batches")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return rows.withColumn("batch", F.col("batch").cast("long"))
