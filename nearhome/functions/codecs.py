"""Column codecs for the messages and the comma-separated id lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearhome.schemas import SIMILAR_MESSAGE


def json_field(value: Column, field: str, dtype: str = "string") -> Column:
    """One field of a JSON message given as text or as Kafka's binary value; null when the message is malformed."""
    schema = T.StructType().add(field, dtype)
    return F.from_json(value.cast("string"), schema)[field]


def similar_to_json(announce_id: Column, similar_ids: Column, cluster_id: Column) -> Column:
    return F.to_json(F.struct(
        announce_id.cast("long").alias("announceId"),
        similar_ids.alias("similarIds"),
        cluster_id.cast("string").alias("clusterId"),
    ))


def similar_from_json(value: Column) -> Column:
    return F.from_json(value.cast("string"), SIMILAR_MESSAGE)


def csv_to_ids(csv: Column) -> Column:
    """Comma-separated text to an array of ids; blank or non-numeric entries are left out."""
    parsed = F.transform(F.split(csv, ","), lambda x: F.trim(x).try_cast("long"))
    return F.filter(parsed, lambda x: x.isNotNull())


def csv_rejects(csv: Column) -> Column:
    """How many non-blank entries of the list are not ids."""
    entries = F.filter(F.split(csv, ","), lambda x: F.trim(x) != "")
    return F.size(F.filter(entries, lambda x: F.trim(x).try_cast("long").isNull()))


def ids_to_csv(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")
