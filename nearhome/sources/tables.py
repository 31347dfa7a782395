"""Where the marketplace tables live: a database, or a folder of Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from nearhome.sources import jdbc, versioned


class DatabaseTables:
    """Tables of a database; scans of a table with an ``id`` key are split into ``partitions`` ranges."""

    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str], partitions: int = 32):
        self.spark, self.url, self.properties, self.partitions = spark, url, properties, partitions

    def read(self, name: str, key: str | None = None) -> DataFrame:
        return jdbc.read_table(self.spark, self.url, name, self.properties, key, self.partitions)

    def append(self, df: DataFrame, name: str) -> None:
        jdbc.append(df, self.url, name, self.properties)

    def replace(self, df: DataFrame, name: str) -> None:
        jdbc.replace(df, self.url, name, self.properties)

    def exists(self, name: str) -> bool:
        return jdbc.exists(self.spark, self.url, name, self.properties)


class FolderTables:
    """Parquet tables in a shared folder. All are versioned; rows are appended to the version that readers see."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def read(self, name: str, key: str | None = None) -> DataFrame:
        found = versioned.read_current(self.spark, f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}") if found is None else found

    def append(self, df: DataFrame, name: str) -> None:
        path = f"{self.root}/{name}"
        if versioned.current(self.spark, path) is None and self._plain(path):
            df.write.mode("append").parquet(path)
        else:
            versioned.append_current(df, path)

    def replace(self, df: DataFrame, name: str) -> None:
        versioned.publish(df, f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        path = f"{self.root}/{name}"
        return versioned.current(self.spark, path) is not None or self._plain(path)

    def _plain(self, path: str) -> bool:
        """Whether somebody else has written a table there, without versions."""
        try:
            self.spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return False
            raise
        return True
