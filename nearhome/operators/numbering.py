"""Consecutive numbers for the rows of a table, without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearhome.session import written


def numbered(df: DataFrame, order: Sequence[Column], number: str, name: str = "numbered") -> DataFrame:
    """``df`` with ``number`` 0..n-1 in the given order.

    The rows are range-partitioned, sorted and counted within their partition, written, and then shifted by the sizes of the
    partitions before, of which there are as many rows as partitions.
    """
    part, place = f"{number} part", f"{number} place"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(
        ranged.withColumn(part, F.spark_partition_id())
        .withColumn(place, F.monotonically_increasing_id() - F.shiftleft(F.col(part).cast("long"), 33)), name,
    )
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(sizes.select(part, before.alias(number)))  # one row a partition
    return placed.join(shifts, part).withColumn(number, F.col(number) + F.col(place)).drop(part, place)
