"""Top rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearhome.session import written

PART_ROWS = 1_000_000  # rows of a key that one task ranks


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    split_by: str | None = None,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The first ``k`` rows of every key, with their rank.

    Spark drops all but ``k`` rows of a key in each task before the shuffle. With ``split_by`` the keys are counted first,
    and one with more than ``part_rows`` rows is ranked in as many parts as it needs before its best rows meet; ``df`` is
    then read twice and should be written.
    """
    if split_by is not None:
        counts = df.groupBy(*keys).agg(F.count("*").alias("key rows")).filter(F.col("key rows") > part_rows)
        hot = written(counts, "hot-keys")
        if not hot.isEmpty():
            part = F.pmod(F.xxhash64(split_by), F.coalesce(F.ceil(F.col("key rows") / part_rows), F.lit(1)))
            within = Window.partitionBy(*keys, "key part").orderBy(*order)
            placed = df.join(hot, list(keys), "left").withColumn("key part", part)
            df = placed.withColumn(rank, F.row_number().over(within)).filter(F.col(rank) <= k).select(*df.columns)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
