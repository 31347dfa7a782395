"""Session settings and the shared work folder."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs count on. Cluster sizes (executors, memory, shuffle partitions) stay with spark-submit.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a top-n cut runs in every task before the shuffle also for n above Spark's default of 1000
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "nearhome", master: str | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**JOB_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or a local one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="nearhome-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of this application; the folder is of no use once the application has ended."""
    path = os.path.join(shared_dir(spark), f"nearhome-{spark.sparkContext.applicationId}", f"{name}-{uuid.uuid4().hex}")
    for made in _scopes:
        made.append(path)
    return path


_scopes: list[list[str]] = []


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system it lies in, wherever that is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def scratch_kept() -> Iterator[None]:
    """What is written meanwhile outlives the scopes that are open."""
    held, _scopes[:] = _scopes[:], []
    try:
        yield
    finally:
        _scopes[:] = held


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was written to scratch paths meanwhile; results must have been handed on by then."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            remove_path(spark, path)


_REMOVES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of every table written meanwhile go as soon as it is written, not when the driver collects its garbage."""
    before = spark.conf.get(_REMOVES_SHUFFLES, None)
    spark.conf.set(_REMOVES_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_REMOVES_SHUFFLES) if before is None else spark.conf.set(_REMOVES_SHUFFLES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors. It also gives Catalyst the true size
    of the table, so a following join is broadcast only when the written bytes are below
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffled, with AQE splitting skewed keys.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once per application; like ``--py-files``."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="nearhome-code-"), "nearhome")
        archive = shutil.make_archive(target, "zip", root_dir=os.path.dirname(package), base_dir=os.path.basename(package))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


_shipped: set[str] = set()
