"""Exact deduplication of new batches against an immutable snapshot that is screened by binary-fuse filters.

A snapshot is a folder that is written once: a copy of its documents with the digest of every normalised text, the groups of
equal texts in buckets, and one static filter a bucket. Any number of batches can be held against it. The rows of a batch are
grouped among themselves. The digests of these groups pass through the filters; only those that a filter accepts are joined to
the exact buckets, where the normalised texts are compared byte by byte, and only what passes there joins a group of the
snapshot. Every other group of the batch is new, without any look at the snapshot.

Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``. Of equal texts the row with
the most code points in its original text stays, then the smallest doc_id (null last), then any one of repeated rows.
Null texts count as empty; all texts without a word are one group. Long texts are digested and compared whole. An empty
snapshot, batch or table gives its own rows only, or none. Other columns are carried along untouched.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhome.llm import fuse
from nearhome.llm.common import SPACE, by_row, numbered_copy, text_or_empty, without
from nearhome.session import scratch_path, written

KEYS_PER_FILTER = 100_000
_FILTER = "bucket long, seed decimal(20,0), segment int, segments int, prints binary"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def digested(docs: DataFrame) -> DataFrame:
    """(row, doc, digest, points): a numbered copy of the documents with the digest of every whole text."""
    text = text_or_empty()
    return numbered_copy(
        docs, "exact-docs", digest=F.sha2(F.encode(normalised(text), "UTF-8"), 256), points=F.char_length(text).cast("long"),
    )


def equal_groups(rows: DataFrame, new: bool) -> DataFrame:
    """(digest, best, size): one row per text. Rows are counted together before the shuffle, so a hot text is no hot key."""
    order = F.struct(
        (-F.col("points")).alias("fewer"), F.col("doc.doc_id").isNull().alias("no_id"), F.col("doc.doc_id").alias("doc_id"),
        F.lit(new).alias("new"), "row",
    )
    return rows.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("size"))


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One filter per bucket of the snapshot; a bucket holds about ``KEYS_PER_FILTER`` digests."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, prints = fuse.build(rows["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"bucket": [key[0]], "seed": [_decimal(seed)], "segment": [segment], "segments": [segments], "prints": [prints]})

    return _keyed(groups, buckets).select("bucket", "key").groupBy("bucket").applyInPandas(build, _FILTER)


class Snapshot(NamedTuple):
    """``copy`` as of ``digested``, ``groups`` (digest, best, size) and the ``filters`` of their buckets."""

    copy: DataFrame
    groups: DataFrame
    filters: DataFrame
    buckets: int


def build_snapshot(docs: DataFrame, path: str) -> Snapshot:
    """Writes a snapshot of the documents below ``path``, where it stays for later batches."""
    spark = docs.sparkSession
    rows = digested(docs)
    rows.write.option("compression", "zstd").parquet(f"{path}/copy")
    copy = spark.read.schema(rows.schema).parquet(f"{path}/copy")
    equal_groups(slim(copy), False).write.parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    buckets = max(1, -(-groups.count() // KEYS_PER_FILTER))
    snapshot_filters(groups, buckets).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/filters")
    return open_snapshot(spark, path)


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    filters = spark.read.schema(f"{_FILTER}, buckets int").parquet(f"{path}/filters")
    buckets = filters.agg(F.max("buckets")).first()[0] or 1
    return Snapshot(spark.read.parquet(f"{path}/copy"), spark.read.parquet(f"{path}/groups"), filters.drop("buckets"), buckets)


def slim(copy: DataFrame) -> DataFrame:
    return copy.select("row", F.struct("doc.doc_id").alias("doc"), "digest", "points")


def screened(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """(digest): the groups of a new batch that the snapshot's filters accept; none that the snapshot holds is lost.

    A batch much larger than the snapshot is dealt over several copies of the filters, so a task has a bounded number of digests.
    """

    def screen(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(rows):
            return rows[["digest"]].iloc[:0]
        f = held.iloc[0]
        accepted = fuse.contains(rows["key"].to_numpy().view(np.uint64), int(f["seed"]), int(f["segment"]), int(f["segments"]), f["prints"])
        return rows.loc[accepted, ["digest"]]

    shares = max(1, -(-groups.count() // (buckets * KEYS_PER_FILTER)))
    asked = _keyed(groups, buckets).withColumn("share", F.pmod(F.shiftright("key", 32), F.lit(shares)))
    held = filters.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    keys = ["bucket", "share"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(screen, "digest string")


def same_bytes(snapshot: Snapshot, batch: DataFrame, pairs: DataFrame) -> DataFrame:
    """(digest): the accepted digests over equal normalised texts, of ``pairs`` (digest, held_row, new_row)."""
    fetched = lambda copy, row: by_row(
        copy.select("row", F.col("doc.text").alias("text")), pairs.select("digest", F.col(row).alias("row")),
    ).select("digest", normalised(text_or_empty()).alias("text"))
    texts = fetched(snapshot.copy, "held_row").unionByName(fetched(batch, "new_row"))
    return texts.groupBy("digest").agg((F.min("text") == F.max("text")).alias("same")).filter("same").select("digest")


def joined_groups(snapshot: Snapshot, batch: DataFrame, new: DataFrame) -> DataFrame:
    """(digest, best, size): the groups of the batch that belong to one of the snapshot, counted together, written."""
    positives = written(screened(new, snapshot.filters, snapshot.buckets), "exact-positives")
    held = snapshot.groups.select("digest", F.col("best").alias("held"), F.col("size").alias("held_size"))
    pairs = written(positives.join(held, "digest").join(new, "digest"), "exact-pairs")
    same = same_bytes(snapshot, batch, pairs.select("digest", F.col("held.row").alias("held_row"), F.col("best.row").alias("new_row")))
    both = pairs.join(same, "digest", "left_semi")
    return written(both.select("digest", F.least("held", "best").alias("best"), (F.col("held_size") + F.col("size")).alias("size")), "exact-joined")


def _decided(rows: DataFrame, groups: DataFrame, joined: DataFrame, new: bool) -> DataFrame:
    """The decision on every row, by its own groups and those that have been joined; only groups of several rows meet the rows."""
    many = groups.filter("size > 1").join(joined, "digest", "left_anti").select("digest", "best", "size").unionByName(joined)
    found = rows.join(written(many, "exact-many"), "digest", "left")
    return found.select(
        "row", F.lit(new).alias("new"), "doc.doc_id", "digest", "points",
        (F.col("best").isNull() | ((F.col("best.row") == F.col("row")) & (F.col("best.new") == F.lit(new)))).alias("kept"),
        F.when(F.col("best").isNotNull(), F.col("best.doc_id")).otherwise(F.col("doc.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).alias("group_size"),
    )


def dedup_batch(snapshot: Snapshot, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, new, doc_id, digest, points, kept, keep_id, group_size) of the rows of a digested batch, and of the snapshot's.

    A row of the snapshot can lose its place to a longer one of the batch; the snapshot itself stays as it is.
    """
    new = written(equal_groups(slim(batch), True), "exact-batch")
    joined = joined_groups(snapshot, batch, new)
    return _decided(slim(batch), new, joined, True), _decided(slim(snapshot.copy), snapshot.groups, joined, False)


def incoming_half() -> Column:
    """The batch of a one-table run: about half of the rows by the hash of their id; the rest is the snapshot."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1


def halves(docs: DataFrame) -> tuple[Snapshot, DataFrame]:
    """One table as a snapshot and a digested batch."""
    snapshot = build_snapshot(docs.filter(~incoming_half()), scratch_path(docs.sparkSession, "exact-snapshot"))
    return snapshot, digested(docs.filter(incoming_half()))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The documents less all but one of each group of equal texts; all their columns as they came."""
    snapshot, batch = halves(docs)
    of_batch, of_snapshot = dedup_batch(snapshot, batch)
    dropped = lambda rows, name: written(rows.filter("NOT kept").select("row"), name)
    return without(snapshot.copy, dropped(of_snapshot, "exact-old")).unionByName(without(batch, dropped(of_batch, "exact-new")))


def _keyed(groups: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64("digest")
    return groups.select("digest", key.alias("key"), F.pmod(key, F.lit(buckets)).alias("bucket"))


def _decimal(value: int):
    from decimal import Decimal

    return Decimal(value)
