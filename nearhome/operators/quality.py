"""Constraint checks that a database would enforce, as counts of violations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of conditions on single rows, all in one pass over the table."""
    counts = df.agg(*[F.count_if(bad).alias(rule) for rule, bad in rules.items()])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col(f"`{rule}`").alias("violations")) for rule in rules
    ])))


def missing(column: str) -> Column:
    return F.col(column).isNull()


def outside(column: str, domain: Sequence[str]) -> Column:
    """A value that is set but not one of the domain."""
    return F.col(column).isNotNull() & ~F.col(column).isin(list(domain))


def duplicate_keys(df: DataFrame, key: str, rule: str) -> DataFrame:
    """Number of key values that occur more than once; counts are combined before the shuffle."""
    per_key = df.filter(F.col(key).isNotNull()).groupBy(key).count()
    return per_key.agg(F.count_if(F.col("count") > 1).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """Number of rows whose key has no parent; a key that fills a third of the child travels as one count."""
    per_key = child.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    lost = per_key.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def audit(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
