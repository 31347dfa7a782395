"""Similar listings for a stream of new listing ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearhome.functions.codecs import json_field
from nearhome.operators.cosine import CosineIndex, build_index, mean_similarity
from nearhome.operators.features import FeatureModel
from nearhome.operators.neighbors import others_of
from nearhome.operators.prepare import complete_listings
from nearhome.operators.store import to_messages
from nearhome.schemas import NEIGHBOURS, OUTPUT_TOPIC
from nearhome.session import scratch_kept, scratch_scope, written
from nearhome.sources import kafka

Answer = Callable[[DataFrame], DataFrame]
Sink = Callable[[DataFrame, int], None]


def parse_ids(messages: DataFrame, field: str = "announceId") -> DataFrame:
    """(id): the listing ids of JSON messages in ``value``; malformed messages and ids drop out."""
    return messages.select(json_field(F.col("value"), field).try_cast("long").alias("id")).dropna()


def start_similarity(
    messages: DataFrame,
    answer: Answer,
    sink: Sink,
    checkpoint: str,
    field: str = "announceId",
    run_once: bool = False,
    every: str | None = None,
) -> StreamingQuery:
    """Runs ``answer`` on the distinct ids of every micro-batch as one plan and hands the result to ``sink``.

    A batch may be repeated after a failure, always with the same batch id, so sinks should be keyed by it or
    by the listing. ``answer`` is called per batch and can look up the current version of its tables.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            ids = written(batch.distinct(), "stream-ids")
            if not ids.isEmpty():
                sink(answer(ids), batch_id)

    return start_batches(parse_ids(messages, field), process, checkpoint, run_once, every)


def start_batches(
    stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, run_once: bool = False, every: str | None = None,
    mode: str = "append",
) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(process)
    if run_once:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return writer.start()


RANGES = 16  # that go to the source at most; what lies in none of them is not read


def id_ranges(ids: DataFrame, ranges: int = RANGES) -> list[tuple[int, int]]:
    """Bounds of the ids, by equal parts of their span that hold any."""
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return []
    width = (high - low) // ranges + 1
    part = F.floor((F.col("id").cast("decimal(20,0)") - F.lit(str(low)).cast("decimal(20,0)")) / F.lit(str(width)).cast("decimal(20,0)"))
    found = ids.groupBy(part.alias("part")).agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("low").collect()
    return [(r["low"], r["high"]) for r in found]


def rows_of(ids: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of ``table`` with one of the ids; unknown ids drop out.

    A few plain ranges go to the source, so a table ordered by id (a database key, or Parquet written by
    ``ordered_by_id``) is read only where the new listings are.
    """
    inside = F.lit(False)
    for low, high in id_ranges(ids):
        inside = inside | F.col("id").between(low, high)
    return table.filter(inside).join(ids, "id", "left_semi")


def ordered_by_id(table: DataFrame) -> DataFrame:
    return table.repartitionByRange("id").sortWithinPartitions("id")


def stored_answer(neighbors: DataFrame) -> Answer:
    """Looks up results that are already computed."""
    return lambda ids: rows_of(ids, neighbors)


def model_answer(listings: DataFrame, model: FeatureModel, heads: DataFrame, k: int = NEIGHBOURS) -> Answer:
    """Places new listings with the trained pipeline and takes the head of their cluster.

    Only the listings of the batch are scored; incomplete ones drop out. ``heads`` are those of the scored
    catalogue, see ``cluster_heads``.
    """

    def answer(ids: DataFrame) -> DataFrame:
        placed = model.transform(complete_listings(rows_of(ids, listings)))
        return others_of(placed.select("id", F.col("prediction").alias("cluster")), heads, k)

    return answer


def cosine_answer(vectors: DataFrame, k: int = NEIGHBOURS, index: CosineIndex | None = None) -> Answer:
    """Compares the vectors of the batch with all others: (id, similar_ids, similarity) with the mean similarity.

    Without an ``index`` the catalogue is indexed once, before the first batch.
    """
    if index is None:
        with scratch_kept():
            index = build_index(vectors, k)

    def answer(ids: DataFrame) -> DataFrame:
        asked = written(rows_of(ids, vectors), "cosine-asked")
        return mean_similarity(asked, index.search(asked))

    return answer


def parquet_sink(path: str) -> Sink:
    """One folder per batch; a repeated batch replaces its own folder, so nothing appears twice."""

    def write(result: DataFrame, batch_id: int) -> None:
        result.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def kafka_sink(servers: str, topic: str = OUTPUT_TOPIC, encode: Callable[[DataFrame], DataFrame] = to_messages) -> Sink:
    """One distributed write per batch, at least once."""
    return lambda result, batch_id: kafka.append(encode(result), servers, topic)


def similar_stream(messages: DataFrame, neighbors: DataFrame, field: str = "announceId") -> DataFrame:
    """The stateless form: a stream-static join for sinks that Spark writes itself; one result per message."""
    return parse_ids(messages, field).join(neighbors, "id")
