"""Database tables over JDBC. Addresses, drivers and credentials come from the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_options(url: str, table: str, properties: dict[str, str], fetch_size: int = 10_000) -> dict[str, str]:
    return {**properties, "url": url, "dbtable": table, "fetchsize": str(fetch_size)}


def split_options(column: str, lower: int, upper: int, partitions: int) -> dict[str, str]:
    """Splits a scan over ``partitions`` ranges of a numeric key; rows outside the bounds go to the end ranges."""
    if partitions < 1 or upper < lower:
        raise ValueError("need at least one partition and lower <= upper")
    return {
        "partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions),
    }


def depth_query(table: str, key: str, partitions: int) -> str:
    """The lowest key of each of ``partitions`` equally large parts of the table, one row a part; the database reads its index for it."""
    parts = f"SELECT {key} AS k, NTILE({partitions}) OVER (ORDER BY {key}) AS part FROM {table} WHERE {key} IS NOT NULL"
    return f"(SELECT MIN(k) AS low FROM ({parts}) p GROUP BY part) b"


def depth_predicates(key: str, lows: list[int]) -> list[str]:
    """Conditions of which every row meets exactly one: the keys between neighbouring bounds, missing keys with the lowest."""
    bounds = sorted(set(lows))[1:]  # what lies below the second one is the first part
    if not bounds:
        return [f"{key} IS NULL OR {key} IS NOT NULL"]
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(bounds, bounds[1:])]
    return [f"{key} IS NULL OR {key} < {bounds[0]}", *inner, f"{key} >= {bounds[-1]}"]


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    key: str | None = None,
    partitions: int = 32,
    even: bool = False,
) -> DataFrame:
    """A table scan. With ``key`` it runs as up to ``partitions`` parallel range scans.

    The ranges hold equally many rows, whatever gaps the whole-numbered key has. ``even`` takes ranges of equal width over the key's
    true bounds instead, for databases without window functions. Filters and column choices made on the result are pushed to the
    database by Spark.
    """
    options = read_options(url, table, properties)
    if key is None or partitions <= 1:
        return spark.read.format("jdbc").options(**options).load()
    if even:
        bounds = f"(SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {table}) b"
        lo, hi = spark.read.format("jdbc").options(**read_options(url, bounds, properties)).load().first()
        if lo is not None:
            options |= split_options(key, int(lo), int(hi), partitions)
        return spark.read.format("jdbc").options(**options).load()
    parts = spark.read.format("jdbc").options(**read_options(url, depth_query(table, key, partitions), properties)).load()
    predicates = depth_predicates(key, [int(r[0]) for r in parts.collect()])
    return spark.read.jdbc(url, table, predicates=predicates, properties={k: v for k, v in options.items() if k not in ("url", "dbtable")})


def exists(spark: SparkSession, url: str, table: str, properties: dict[str, str]) -> bool:
    """Whether the database can describe the table. Spark asks it for no row; other failures than a missing table are raised."""
    try:
        spark.read.format("jdbc").options(**read_options(url, table, properties)).load()
    except Exception as error:
        if missing_table(error):
            return False
        raise
    return True


def missing_table(error: Exception) -> bool:
    """By the SQL state that the driver reports: 42S02 and 42P01 stand for an unknown table."""
    cause = getattr(error, "_origin", None)
    while cause is not None:
        state = cause.getSQLState() if "getSQLState" in dir(cause) else None
        if state in ("42S02", "42P01"):
            return True
        cause = cause.getCause()
    return "TABLE_OR_VIEW_NOT_FOUND" in str(error)


def write_options(url: str, table: str, properties: dict[str, str], batch_size: int = 10_000, connections: int = 32) -> dict[str, str]:
    # numPartitions bounds the parallel connections of the writers
    return {**properties, "url": url, "dbtable": table, "batchsize": str(batch_size), "numPartitions": str(connections)}


def append(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    df.write.format("jdbc").options(**write_options(url, table, properties)).mode("append").save()


def replace(df: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Replaces all rows and keeps the table definition, so that generated keys and indexes stay.

    Pass a result that has been computed and written already: the table is emptied when the write starts.
    """
    options = write_options(url, table, properties) | {"truncate": "true"}
    df.write.format("jdbc").options(**options).mode("overwrite").save()
