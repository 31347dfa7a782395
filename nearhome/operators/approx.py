"""Approximate cosine neighbours by random hyperplanes, where the exact search would compare too much.

Every table cuts the space with its own planes; vectors on the same sides of all of them share a bucket. A query is compared with its
bucket of every table, and with the buckets behind the planes it lies closest to. Within a bucket the comparison is the exact one, in blocks,
so a bucket with a third of all vectors is divided among tasks and no vector of it is left out. What the tables find is ranked by the
true distance: a neighbour that is found has its exact similarity, one that lies in none of the buckets is missed. The number of planes follows
the size of the catalogue, so that a bucket holds about ``BUCKET_ROWS`` vectors; with less than two buckets the search is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhome.operators import cosine
from nearhome.operators.cosine import BLOCK_ROWS, SPLIT_ROWS
from nearhome.schemas import NEIGHBOURS
from nearhome.session import written

TABLES, PROBES, BUCKET_ROWS, SEED = 8, 3, 2048, 42


def planes_for(count: int, bucket_rows: int = BUCKET_ROWS) -> int:
    return max(0, floor(log2(max(count, 1) / bucket_rows)))


def in_buckets(rows: DataFrame, dims: int, bits: int, tables: int, probes: int, seed: int = SEED) -> DataFrame:
    """(id, vec, grp, cell): every vector once per table, and ``probes`` times more behind its closest planes; ``grp`` is the table."""
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dims))
    shared = rows.sparkSession.sparkContext.broadcast(planes)  # a few vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = cosine._unit_rows(cosine._matrix(batch.column(1)))
            for table, normal in enumerate(shared.value):
                side = unit @ normal.T
                code = (side > 0) @ (1 << np.arange(bits))
                nearest = np.argsort(np.abs(side), axis=1)[:, : min(probes, bits)]
                codes = np.concatenate([code[:, None], code[:, None] ^ (1 << nearest)], axis=1) if bits else code[:, None]
                for column in range(codes.shape[1]):
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0), batch.column(1), pa.array(np.full(len(code), table, np.int32)), pa.array(codes[:, column].astype(np.int64)),
                    ], ["id", "vec", "grp", "cell"])

    vec = rows.schema["vec"].dataType.simpleString()  # floats stay floats
    return rows.select("id", "vec").mapInArrow(run, f"id long, vec {vec}, grp int, cell long")


def approximate_top_k(
    catalogue: DataFrame, k: int = NEIGHBOURS, queries: DataFrame | None = None, tables: int = TABLES, probes: int = PROBES,
    bucket_rows: int = BUCKET_ROWS, seed: int = SEED,
) -> DataFrame:
    """(id, rank, similar_id, similarity): up to ``k`` of the closest other vectors, of (id, vec), with their exact similarity."""
    rows = written(cosine._usable(catalogue, None).select("id", "vec"), "approx-vectors")
    asked = rows if queries is None else written(cosine._usable(queries, None).select("id", "vec"), "approx-asked")
    bits = planes_for(rows.count(), bucket_rows)
    if bits == 0:
        return cosine.cosine_top_k(rows, k, asked)
    dims = rows.select(F.size("vec")).first()[0]
    cand = written(in_buckets(rows, dims, bits, tables, 0, seed), "approx-buckets")
    sizes = written(cand.groupBy("grp", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")), "approx-sizes")
    probed = in_buckets(asked, dims, bits, tables, probes, seed).withColumn("kth", F.lit(None).cast("double"))
    met = cosine._match(written(probed, "approx-probes"), cand, sizes, k, SPLIT_ROWS)
    once = met.groupBy("id", "similar_id").agg(F.min("gap").alias("gap"))  # what several tables have found
    return cosine._reported(cosine._best(once, k))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (id, similar_id) that were found."""
    hit = exact.join(found.select("id", "similar_id"), ["id", "similar_id"], "left_semi").count()
    return hit / max(1, exact.count())
