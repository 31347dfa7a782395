"""The table of similarity results and its message form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhome.functions.codecs import csv_to_ids, ids_to_csv, similar_from_json, similar_to_json
from nearhome.schemas import COSINE_MESSAGE


def to_messages(neighbors: DataFrame) -> DataFrame:
    """(key, value): one JSON message per listing of (id, similar_ids, cluster), with a null key."""
    value = similar_to_json(F.col("id"), F.col("similar_ids"), F.col("cluster"))
    return neighbors.select(F.lit(None).cast("string").alias("key"), value.alias("value"))


def to_cosine_messages(means: DataFrame) -> DataFrame:
    """(key, value): one JSON message per listing of (id, similar_ids, similarity), the mean similarity included."""
    value = F.to_json(F.struct(F.col("id").alias("announceId"), F.col("similar_ids").alias("similarIds"), "similarity"))
    return means.select(F.lit(None).cast("string").alias("key"), value.alias("value"))


def from_cosine_messages(messages: DataFrame) -> DataFrame:
    """(id, similar_ids, similarity) of the well-formed messages."""
    data = messages.select(F.from_json(F.col("value").cast("string"), COSINE_MESSAGE).alias("m"))
    return data.filter(F.col("m.announceId").isNotNull()).select(
        F.col("m.announceId").alias("id"), F.col("m.similarIds").alias("similar_ids"), F.col("m.similarity").alias("similarity"),
    )


def from_messages(messages: DataFrame, *keep: str) -> DataFrame:
    """(id, similar_ids, cluster) of the well-formed messages, and the columns to ``keep``."""
    data = messages.select(similar_from_json(F.col("value")).alias("m"), *keep)
    return data.filter(F.col("m.announceId").isNotNull()).select(
        F.col("m.announceId").alias("id"), F.col("m.similarIds").alias("similar_ids"), F.col("m.clusterId").alias("cluster"), *keep,
    )


def to_csv_table(neighbors: DataFrame) -> DataFrame:
    return neighbors.select(F.col("id").alias("announceId"), ids_to_csv(F.col("similar_ids")).alias("similarsIds"))


def from_csv_table(table: DataFrame) -> DataFrame:
    return table.select(F.col("announceId").cast("long").alias("announce_id"), csv_to_ids(F.col("similarsIds")).alias("similar_ids"))


EPOCH = 2**32  # versions of an epoch: one a batch of a checkpoint


def version_of(epoch: int, batch_id: int) -> int:
    """Grows with the batches of a checkpoint, and with the epochs that checkpoints are given one after another."""
    return epoch * EPOCH + batch_id


def next_epoch(epochs: DataFrame | None, queue: DataFrame | None) -> int:
    """One more than any epoch that was given out or that the queue's versions belong to."""
    newest = [0]
    if epochs is not None:
        newest.append(epochs.agg(F.max("epoch")).first()[0] or 0)
    if queue is not None:
        newest.append((queue.agg(F.max("version")).first()[0] or 0) // EPOCH)
    return max(newest) + 1


def one_per_listing(results: DataFrame, order: list[str]) -> DataFrame:
    """The last result of every listing among those of one batch, by the ``order`` columns and then by the list itself."""
    rest = [c for c in results.columns if c not in ("id", *order)]
    newest = F.max(F.struct(*order, *rest)).alias("newest")
    return results.groupBy("id").agg(newest).select("id", *[f"newest.{c}" for c in rest])


def queue_rows(results: DataFrame, version: int) -> DataFrame:
    """(announceId, similarsIds, version) of results (id, similar_ids), to be appended to the queue."""
    return to_csv_table(results).withColumn("version", F.lit(version).cast("long"))


def pending(queue: DataFrame, processed: DataFrame | None) -> DataFrame:
    """(announceId, similarsIds, version): the latest row of every listing that has not been processed.

    The queue and the list of processed rows only grow, so results stored while a listing is processed stay pending.
    """
    newest = queue.groupBy("announceId").agg(F.max(F.struct("version", "similarsIds")).alias("newest"))
    rows = newest.select("announceId", "newest.similarsIds", "newest.version")
    if processed is None:
        return rows
    return rows.join(processed.select("announceId", "version"), ["announceId", "version"], "left_anti").select("announceId", "similarsIds", "version")


def latest_results(results: DataFrame, version: str) -> DataFrame:
    """One row per listing: the result with the highest version.

    The maximum is combined before the shuffle, so a listing that was computed very often stays cheap.
    """
    rest = [c for c in results.columns if c not in ("id", version)]
    newest = F.max(F.struct(version, *rest)).alias("newest")
    return results.groupBy("id").agg(newest).select("id", "newest.*")


def drain(queue: DataFrame, processed: DataFrame, key: str = "announce_id") -> DataFrame:
    """Queue rows whose listing has not been processed."""
    return queue.join(processed.select(key).distinct(), key, "left_anti")
