"""Parquet tables that are replaced as a whole: readers see the old version or the new one, never half of it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearhome.session import remove_path

POINTER = T.StructType([T.StructField("version", T.LongType(), False), T.StructField("path", T.StringType(), False)])


def read_if_exists(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The Parquet table at ``path``, or None where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def current(spark: SparkSession, root: str) -> tuple[int, str] | None:
    pointers = read_if_exists(spark, f"{root}/pointers", POINTER)
    newest = pointers.orderBy(F.col("version").desc()).first() if pointers is not None else None
    return (newest["version"], newest["path"]) if newest else None


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    """The latest published version, or None before the first one."""
    found = current(spark, root)
    return spark.read.parquet(found[1]) if found else None


def append_current(df: DataFrame, root: str) -> None:
    """Adds rows to the version that readers see; the first rows make the first version."""
    found = current(df.sparkSession, root)
    if found is None:
        publish(df, root)
    else:
        df.write.mode("append").parquet(found[1])


def publish(df: DataFrame, root: str) -> int:
    """Writes ``df`` as the next version and then points readers to it.

    A failure before the pointer leaves the old version in place, and a rerun overwrites the unfinished one.
    One writer at a time; the new version may be computed from the current one.
    """
    spark = df.sparkSession
    found = current(spark, root)
    version = found[0] + 1 if found else 1
    path = f"{root}/version-{version}"
    df.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(version, path)], POINTER).coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return version


def remove_old(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Deletes all but the newest ``keep`` versions; readers that still hold an older one must have ended."""
    pointers = read_if_exists(spark, f"{root}/pointers", POINTER)
    if pointers is not None:
        for row in pointers.orderBy(F.col("version").desc()).offset(keep).collect():  # one row per publication
            remove_path(spark, row["path"])
