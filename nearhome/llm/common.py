"""What several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearhome.session import scratch_path

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so that columns an operator adds cannot clash with the caller's."""
    return F.struct(*[quoted(c) for c in df.columns])


def unpacked(df: DataFrame, struct: str) -> DataFrame:
    return df.select(f"{struct}.*")


def written_densely(df: DataFrame, name: str) -> DataFrame:
    """Like ``written``, in a form that takes less room: for tables that hold whole texts."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered_copy(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    """(row, doc, columns): every row packed in ``doc`` under a number of its own, written once.

    The number is drawn while writing and read back, so it stays the same however often the copy is read and
    whichever executors are lost. Repeated rows are told apart by it.
    """
    numbered = df.select(
        F.monotonically_increasing_id().alias("row"), packed(df).alias("doc"), *[c.alias(k) for k, c in columns.items()],
    )
    return written_densely(numbered, name)


def by_row(copy: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """``copy`` joined with the narrow table ``rows`` on the unique ``row``.

    What is to be found grows with the corpus, so it is never broadcast: both sides are shuffled, and each task hashes its
    share of the narrow side, so the texts need no sort.
    """
    return copy.join(rows.hint("shuffle_hash"), "row", how)


def without(copy: DataFrame, dropped: DataFrame) -> DataFrame:
    """The caller's rows of a numbered copy, less those whose ``row`` is in ``dropped``."""
    return unpacked(by_row(copy.select("row", "doc"), dropped.select("row"), "left_anti"), "doc")
