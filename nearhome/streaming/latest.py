"""The latest result of every listing, kept beside the checkpoint of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhome.functions.codecs import ids_to_csv
from nearhome.operators.store import from_messages
from nearhome.session import remove_path

ROW = "id long, version long, cluster string, similars_ids string"


def newest_results(messages: DataFrame, version: str = "version") -> DataFrame:
    """(id, version, cluster, similars_ids): of the messages (value, ``version``) of a batch the result of every listing with the highest
    version, and under one version the one with the larger text. Messages without a version or a listing drop out.
    """
    results = from_messages(messages, version).select(
        "id", F.col(version).cast("long").alias("version"),
        F.coalesce(ids_to_csv(F.col("similar_ids")), F.lit("")).alias("similars_ids"), F.coalesce("cluster", F.lit("")).alias("cluster"),
    )
    newest = F.max(F.struct("version", "similars_ids", "cluster")).alias("newest")
    return results.dropna(subset=["version"]).groupBy("id").agg(newest).select("id", "newest.version", "newest.cluster", "newest.similars_ids")


def merged_results(state: DataFrame, newest: DataFrame) -> DataFrame:
    """The state after a batch, with ``changed`` where it gave a listing another result than before.

    A result counts only if its version is above the listing's, so repeated messages, replayed ones and those that arrive late
    change nothing. One with a higher version and the same content raises the version and is not a change.
    """
    fields = ("version", "cluster", "similars_ids")
    old, new = (df.select("id", F.struct(*fields).alias(name)) for df, name in ((state, "old"), (newest, "new")))
    counts = F.col("new").isNotNull() & (F.col("old").isNull() | F.coalesce(F.col("new.version") > F.col("old.version"), F.lit(False)))
    other = F.col("old").isNull() | (F.col("new.cluster") != F.col("old.cluster")) | (F.col("new.similars_ids") != F.col("old.similars_ids"))
    kept = F.when(counts, F.col("new")).otherwise(F.col("old"))
    return old.join(new, "id", "full").select("id", *[kept[c].alias(c) for c in fields], (counts & other).alias("changed"))


def _states(spark: SparkSession, root: str) -> list[int]:
    """The batches that have left a state."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []


def change_batches(sink: Callable[[DataFrame, int], None], root: str, version: str = "version") -> Callable[[DataFrame, int], None]:
    """Hands on to ``sink`` the rows of a batch that change a listing's latest result.

    A batch writes its state under ``root`` as a folder of its own, made of the state that the batch before it has left. One that is
    repeated after a failure starts from that state again and gives out the same; of two results under one version the first batch counts.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [b for b in _states(spark, root) if b < batch_id]
        state = spark.read.schema(ROW).parquet(f"{root}/{before[-1]}") if before else spark.createDataFrame([], ROW)
        merged_results(state, newest_results(batch, version)).write.mode("overwrite").parquet(f"{root}/{batch_id}")
        now = spark.read.schema(f"{ROW}, changed boolean").parquet(f"{root}/{batch_id}")
        sink(now.filter("changed").select("id", "version", "cluster", "similars_ids"), batch_id)
        for b in before[:-1]:
            remove_path(spark, f"{root}/{b}")

    return process
