"""Jump consistent hashing of stable keys to shards, by column functions only.

A row's shard follows from its key and the number of shards alone: there is no ring and no table to keep. The key's text
(null: empty) is hashed to 64 bits, and the hash is the seed of a linear congruential sequence whose numbers are the
shard's successive jumps: the last jump below the number of shards is the shard. When shards are appended, the same
sequence goes on, so a row either stays or moves into one of the new shards; ``1 / (shards + 1)`` of the rows move for one.

Rows with the same key share a shard, also repeated rows and rows without a key; texts do not matter. Within a shard the
slots are gapless from 0, ordered by key and content, and found by a range-partitioned sort, so neither a hot shard nor a hot
key is one task's work. Null texts have no bytes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearhome.llm.common import by_row, numbered_copy, packed, quoted, text_or_empty
from nearhome.operators.numbering import numbered
from nearhome.session import written

MULTIPLIER = 2862933555777941757  # fixed value: the sequence is key * MULTIPLIER + 1 modulo 2**64
HEADER = 8  # bytes a record takes besides its text
FIRST_STEPS = 64  # jumps tried at once; a row needs about ln(shards), at most one a shard
ROWS_PER_FILE = 1_000_000

_HALF = 2**32 - 1


def key_halves(key: Column) -> tuple[Column, Column]:
    """The upper and the lower 32 bits of a 64-bit hash of the key's text, each as a long."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return half(1), half(9)


def _low_product(x: Column, factor: int) -> Column:
    """Up to 2**49, and equal to x * factor modulo 2**32, for x and factor below 2**32; nothing overflows on the way."""
    upper = (x * (factor >> 16)).bitwiseAND(F.lit(0xFFFF))
    return x * (factor & 0xFFFF) + F.shiftleft(upper, 16)


def _jump(state: Column) -> Column:
    """The next number of the sequence, in halves, and the jump it makes."""
    hi, lo = state["hi"], state["lo"]
    low_factor, high_factor = MULTIPLIER & _HALF, MULTIPLIER >> 32
    upper = lo * (low_factor >> 16)
    low = lo * (low_factor & 0xFFFF) + F.shiftleft(upper.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftright(upper, 16)
    new_hi = (carry + _low_product(hi, low_factor) + _low_product(lo, high_factor)).bitwiseAND(F.lit(_HALF))
    reach = F.lit(float(2**31)) / (F.shiftright(new_hi, 1) + 1).cast("double")
    jump = ((state["next"] + 1).cast("double") * reach).cast("long")
    return F.struct(new_hi.alias("hi"), low.bitwiseAND(F.lit(_HALF)).alias("lo"), state["next"].alias("shard"), jump.alias("next"))


def _jumped(state: Column, shards: int, steps: int) -> Column:
    """``state`` after at most ``steps`` jumps, ended when the next one leaves ``shards``."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: F.when(s["next"] < shards, _jump(s)).otherwise(s))


def with_shards(rows: DataFrame, key: Column, counts: Sequence[int], names: Sequence[str]) -> DataFrame:
    """``rows`` with one column per growing number of shards, the shard of ``key`` among so many."""
    if not counts or min(counts) < 1 or list(counts) != sorted(counts):
        raise ValueError("numbers of shards must be positive and grow")
    hi, lo = key_halves(key)
    start = F.struct(hi.alias("hi"), lo.alias("lo"), F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"))
    state, done = "jump state", rows.withColumn("jump state", start)
    for shards, name in zip(counts, names):
        done = done.withColumn(state, _jumped(F.col(state), shards, min(shards, FIRST_STEPS)))
        if shards > FIRST_STEPS:  # each jump goes up by one at least, so ``shards`` of them always do
            rest = _jumped(F.col(state), shards, shards - FIRST_STEPS)
            done = done.withColumn(state, F.when(F.col(state)["next"] < shards, rest).otherwise(F.col(state)))
        done = done.withColumn(name, F.col(state)["shard"].cast("int"))
    return done.drop(state)


def with_slots(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``slot``, 0, 1, ... within each ``shard`` in the given order."""
    placed = numbered(rows, [F.col("shard"), *[quoted(c) for c in order]], "slot", "shard-slots")
    first = placed.groupBy("shard").agg(F.min("slot").alias("first slot"))
    return placed.join(first, "shard").withColumn("slot", F.col("slot") - F.col("first slot")).drop("first slot")


def sharded(docs: DataFrame, shards: int, key: str = "doc_id", added: int = 1) -> DataFrame:
    """(row key, size, text_crc32, shard, slot, grown_shard) of every document, the key under its own name.

    ``grown_shard`` is the shard after ``added`` more have been appended.
    """
    data = F.encode(text_or_empty(), "UTF-8")
    slim = docs.select(
        F.monotonically_increasing_id().alias("place"), quoted(key).alias("key"),
        (F.octet_length(data) + HEADER).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
    )
    rows = with_shards(slim, F.col("key"), [shards, shards + added], ["shard", "grown_shard"])
    placed = with_slots(written(rows, "shard-rows"), ["key", "text_crc32", "size", "place"])
    return placed.select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Writes the documents with all their columns below ``path``, a folder a shard, ordered by slot in files of a million rows.

    A shard is written by as many tasks as it has files, so a hot key is no single task's work.
    """
    copy = numbered_copy(docs, "shard-docs")
    slim = with_shards(copy.select("row", F.col("doc")[key].alias("key")), F.col("key"), [shards], ["shard"])
    slots = written(with_slots(slim, ["key", "row"]).select("row", "shard", "slot"), "shard-places")
    file = F.floor(F.col("slot") / ROWS_PER_FILE)
    placed = by_row(copy, slots).select("shard", "slot", file.alias("file"), "doc")
    placed.repartition("shard", "file").sortWithinPartitions("shard", "slot").drop("file").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, shards: Sequence[int] | None = None) -> DataFrame:
    """(shard, slot, doc) of what ``write_shards`` wrote; with ``shards`` only these folders are read."""
    rows = spark.read.parquet(path)
    return rows if shards is None else rows.filter(F.col("shard").isin(list(shards)))


def moved(rows: DataFrame) -> DataFrame:
    """(shard, grown_shard, n_rows, bytes): what has to be copied when the shards are appended; nothing else moves."""
    gone = rows.filter("grown_shard != shard")
    return gone.groupBy("shard", "grown_shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"))
