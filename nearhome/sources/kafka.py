"""Topics of JSON messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearhome.schemas import INPUT_TOPIC, OUTPUT_TOPIC

STARTING_OFFSETS = ("earliest", "latest")


def source_options(servers: str, topic: str = INPUT_TOPIC, starting: str = "earliest", max_per_trigger: int | None = None) -> dict[str, str]:
    if starting not in STARTING_OFFSETS:
        raise ValueError(f"starting must be one of {STARTING_OFFSETS}")
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return options


def sink_options(servers: str, topic: str = OUTPUT_TOPIC) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def read_stream(spark: SparkSession, servers: str, topic: str = INPUT_TOPIC, starting: str = "earliest", max_per_trigger: int | None = None) -> DataFrame:
    """The message values of a topic as a streaming frame with the column ``value``."""
    options = source_options(servers, topic, starting, max_per_trigger)
    return spark.readStream.format("kafka").options(**options).load().select("value")


def append(messages: DataFrame, servers: str, topic: str = OUTPUT_TOPIC) -> None:
    """Sends (key, value) rows, all in one distributed write."""
    messages.select("key", "value").write.format("kafka").options(**sink_options(servers, topic)).mode("append").save()
