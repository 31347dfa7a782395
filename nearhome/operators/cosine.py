"""Exact cosine neighbours.

Every vector is compared by blocks of NumPy products, and a block gives out only the best ``k`` of each
query. Groups are divided into cells around pivot vectors, whose number grows with the group. A query meets its own
cell first, which bounds the distance of its k-th neighbour, and after that only the cells that the triangle
inequality cannot rule out. The result is the same as comparing all pairs.

A cell holds about ``CELL_ROWS`` vectors, or as many as the root of a group's size where that is more, which keeps the work
of finding the nearest pivot and that within the cells in balance. A group of less than two cells is one cell. Pivots are a
table like the vectors; no step depends on their fitting into one task or on the driver.

Neighbours are ranked by the squared difference of the unit vectors, which tells apart what the cosine rounds to 1. The
product only makes the shortlist; equal differences go to the lower id. The reported similarity is rounded.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from nearhome.operators.ranking import top_per_key
from nearhome.schemas import NEIGHBOURS
from nearhome.session import written

SIM_DIGITS = 9         # of the reported similarity
BLOCK_ROWS = 32768     # candidates that one task holds at a time
SPLIT_ROWS = 16384     # queries that one task holds at a time
CELL_ROWS = 32768      # vectors around a pivot
KERNEL_ROWS = 128      # query rows of one matrix product
SLACK = 1e-6           # covers rounding in the distance bounds
PAIRS = 1 << 17        # pairs whose difference is taken at once
NO_CELL = -(2 ** 63)   # of a group that is one cell
DELTAS = 8             # parts beside the base of an index
OVERFULL = 4           # times its share, and a cell asks for a new index


def cosine_top_k(
    catalogue: DataFrame,
    k: int = NEIGHBOURS,
    queries: DataFrame | None = None,
    group: str | None = None,
    block_rows: int = BLOCK_ROWS,
    split_rows: int = SPLIT_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(id, rank, similar_id, similarity): the ``k`` other vectors of ``catalogue`` closest to each query.

    Input columns are ``id`` and ``vec``; with ``group`` only vectors of the same group are compared.
    Zero vectors, and vectors with a null, NaN or infinity, have no similarity and are left out.
    """
    index = build_index(catalogue, k, group, block_rows, cell_rows)
    return index.search(catalogue if queries is None else queries, split_rows)


class CosineIndex:
    """The candidates of a catalogue, written once with their cells; any number of searches reads them.

    ``pivots`` is (grp, cell, vec, radius), or None where every group is one cell. ``counts`` is (grp, cell, n). New vectors are added
    as a delta beside what is written; after ``DELTAS`` of them the parts are written as one.
    """

    def __init__(self, cand: DataFrame, pivots: DataFrame | None, counts: DataFrame, k: int, group: str | None, block_rows: int, cell_rows: int, deltas: int = 0):
        self.cand, self.pivots, self.counts, self.k, self.group, self.block_rows = cand, pivots, counts, k, group, block_rows
        self.cell_rows, self.deltas = cell_rows, deltas
        if pivots is None and group is None:
            self.sizes: DataFrame | int = max(1, ceil((counts.agg(F.sum("n")).first()[0] or 0) / block_rows))
        else:
            self.sizes = counts.select("grp", "cell", F.ceil(F.col("n") / block_rows).alias("blocks"))

    def added(self, vectors: DataFrame) -> CosineIndex:
        """The index with new vectors, whose ids it does not hold; only they are read and placed.

        Each goes to the cell of its nearest pivot, whose radius grows where it lies beyond, so all bounds of the search hold on.
        """
        rows = _lowest_copies(_usable(vectors, self.group), self.k + 1)
        pivots = self.pivots
        if pivots is None:
            delta = written(rows.withColumn("cell", F.lit(NO_CELL)), "cosine-delta")
        else:
            placed = written(_placed(written(rows, "cosine-new"), pivots, self.block_rows, SPLIT_ROWS), "cosine-delta")
            reach = placed.groupBy("grp", "cell").agg(F.max("home").alias("home"))
            grown = pivots.join(reach, ["grp", "cell"], "left").withColumn("radius", F.greatest("radius", F.coalesce("home", F.lit(0.0))))
            pivots, delta = written(grown.drop("home"), "cosine-radii"), placed.select("id", "grp", "vec", "cell")
        cand, deltas = self.cand.unionByName(delta), self.deltas + 1
        if deltas > DELTAS:
            cand, deltas = written(cand, "cosine-cells"), 0
        more = delta.groupBy("grp", "cell").agg(F.count("*").alias("n"))
        counts = written(self.counts.unionByName(more).groupBy("grp", "cell").agg(F.sum("n").alias("n")), "cosine-counts")
        return CosineIndex(cand, pivots, counts, self.k, self.group, self.block_rows, self.cell_rows, deltas)

    def outgrown(self) -> bool:
        """Whether a group would be divided more finely if the index were built anew: one of its cells holds ``OVERFULL`` times its share."""
        share = F.greatest(F.lit(self.cell_rows), F.ceil(F.sqrt(F.sum("n").over(Window.partitionBy("grp")))))
        return not self.counts.filter(F.col("n") >= 2 * self.cell_rows).withColumn("share", share).filter(F.col("n") >= OVERFULL * F.col("share")).isEmpty()

    def search(self, queries: DataFrame, split_rows: int = SPLIT_ROWS) -> DataFrame:
        """(id, rank, similar_id, similarity) of the queries (id, vec and, where the index has one, the group)."""
        asked, k = _usable(queries, self.group), self.k
        match = lambda rows: _match(rows, self.cand, self.sizes, k, split_rows)
        unknown = F.lit(None).cast("double").alias("kth")
        if self.pivots is None:
            return _reported(_best(match(asked.select("*", F.lit(NO_CELL).alias("cell"), unknown)), k))
        asked = written(_placed(written(asked, "cosine-asked"), self.pivots, self.block_rows, split_rows), "cosine-queries")
        near = written(_best(match(asked.select("*", unknown)), k), "cosine-own-cell")
        kth = near.filter(F.col("rank") == k).select("id", F.col("gap").alias("kth"))
        visits = _visits(asked.join(kth, "id", "left"), self.pivots, self.block_rows, split_rows)
        return _reported(_best(near.select("id", "similar_id", "gap").unionByName(match(visits)), k))


def build_index(
    catalogue: DataFrame, k: int = NEIGHBOURS, group: str | None = None, block_rows: int = BLOCK_ROWS, cell_rows: int = CELL_ROWS,
) -> CosineIndex:
    """Candidates, cells, radii and block layout of ``catalogue`` (id, vec and the group), for searches of up to ``k``."""
    cand = written(_lowest_copies(_usable(catalogue, group), k + 1), "cosine-candidates")
    pivots = written(_drawn_pivots(cand, cell_rows), "cosine-pivots")
    if pivots.isEmpty():
        cand, pivots = cand.withColumn("cell", F.lit(NO_CELL)), None
    else:
        placed = written(_placed(cand, pivots, block_rows, SPLIT_ROWS), "cosine-cells")
        radius = placed.groupBy("grp", "cell").agg(F.max("home").alias("radius"))
        pivots, cand = written(pivots.join(radius, ["grp", "cell"]), "cosine-radii"), placed.select("id", "grp", "vec", "cell")
    counts = written(cand.groupBy("grp", "cell").agg(F.count("*").alias("n")), "cosine-counts")
    return CosineIndex(cand, pivots, counts, k, group, block_rows, cell_rows)


def _drawn_pivots(cand: DataFrame, cell_rows: int) -> DataFrame:
    """(grp, cell, vec): candidates drawn by their hash, about one a cell, in groups of two cells and more."""
    sizes = cand.groupBy("grp").agg(F.count("*").alias("n"))
    step = F.greatest(F.lit(cell_rows), F.ceil(F.sqrt("n")))
    large = written(sizes.withColumn("step", step).filter(F.col("n") >= 2 * F.col("step")).select("grp", "step"), "cosine-groups")
    return cand.join(large, "grp").filter(F.pmod(F.xxhash64("id"), F.col("step")) == 0).select("grp", F.col("id").alias("cell"), "vec")


def _placed(rows: DataFrame, pivots: DataFrame, block_rows: int, split_rows: int) -> DataFrame:
    """``rows`` (id, grp, vec) with the ``cell`` of the nearest pivot and ``home``, the chord to it; ``NO_CELL`` without pivots."""
    near = _meet(rows, pivots.select(F.col("cell").alias("id"), "grp", "vec"), block_rows, split_rows, _nearest, "id long, cell long, gap double")
    best = near.groupBy("id").agg(F.min(F.struct("gap", "cell")).alias("best"))
    return rows.join(best, "id", "left").select(
        "id", "grp", "vec", F.coalesce("best.cell", F.lit(NO_CELL)).alias("cell"), F.sqrt("best.gap").alias("home"),
    )


def _visits(asked: DataFrame, pivots: DataFrame, block_rows: int, split_rows: int) -> DataFrame:
    """(id, grp, vec, cell, kth): each query once per other cell that may still hold one of its best ``k``.

    ``kth`` is the k-th squared difference found so far, null when fewer were found.
    """
    homes = pivots.select("grp", "cell", F.col("vec").alias("pivot"))
    left = asked.filter(F.col("cell") != NO_CELL).join(homes, ["grp", "cell"])
    right = pivots.select(F.col("cell").alias("id"), "grp", "vec", "radius")
    found = written(_meet(left, right, block_rows, split_rows, _reachable, "id long, cell long"), "cosine-visits")  # without the vectors
    return found.join(left.select("id", "grp", "vec", "kth"), "id").select("id", "grp", "vec", "cell", "kth")


def _meet(left: DataFrame, right: DataFrame, block_rows: int, split_rows: int, job, schema: str) -> DataFrame:
    """Runs ``job`` on every split of ``left`` and block of ``right`` (few rows) of a group."""
    blocks = right.groupBy("grp").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    splits = left.groupBy("grp").agg(F.ceil(F.count("*") / split_rows).alias("splits"))
    layout = written(blocks.join(splits, "grp"), "cosine-meeting")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = left.join(layout, "grp").select(*left.columns, place("splits").alias("split"), each("blocks").alias("block"))
    held = right.join(layout, "grp").select(*right.columns, place("blocks").alias("block"), each("splits").alias("split"))
    keys = ["grp", "block", "split"]
    return dealt.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(job, schema)


def _nearest(asked: pa.Table, pivots: pa.Table) -> pa.Table:
    """The nearest pivot of the block for every row, the lower cell among equals."""
    cells, gaps = np.empty(0, np.int64), np.empty(0)
    if asked.num_rows and pivots.num_rows:
        order = np.argsort(pivots["id"].to_numpy())
        number, unit = pivots["id"].to_numpy()[order], _unit_rows(_matrix(pivots["vec"]))[order]
        rows = _unit_rows(_matrix(asked["vec"]))
        at = np.concatenate([np.argmax(rows[i : i + KERNEL_ROWS] @ unit.T, axis=1) for i in range(0, len(rows), KERNEL_ROWS)])
        cells, gaps = number[at], np.square(rows - unit[at]).sum(axis=1)
    return pa.table({"id": asked["id"] if len(cells) else pa.array([], pa.int64()), "cell": cells, "gap": gaps})


def _reachable(asked: pa.Table, pivots: pa.Table) -> pa.Table:
    """The cells of the block, other than the own one, that a query's reach may touch.

    Chords between unit vectors are Euclidean distances. A vector within reach of the query can lie in another cell only
    if that cell's ball is within reach of the query, and so is the plane halfway between the two pivots.
    """
    ids, cells = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if asked.num_rows and pivots.num_rows:
        number, radius, unit = pivots["id"].to_numpy(), pivots["radius"].to_numpy(), _unit_rows(_matrix(pivots["vec"]))
        known, own, home = asked["id"].to_numpy(), asked["cell"].to_numpy(), asked["home"].to_numpy()
        reach = np.sqrt(asked["kth"].to_numpy().astype(float))
        reach = np.where(np.isnan(reach), np.inf, reach) + SLACK
        rows, centres = _unit_rows(_matrix(asked["vec"])), _unit_rows(_matrix(asked["pivot"]))
        for start in range(0, len(rows), KERNEL_ROWS):
            part = slice(start, start + KERNEL_ROWS)
            chord, between = _chord(rows[part] @ unit.T), _chord(centres[part] @ unit.T)
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(between > SLACK, (chord ** 2 - home[part, None] ** 2) / (2 * between), 0.0)
            hit = (chord - radius <= reach[part, None]) & (plane <= reach[part, None]) & (number != own[part, None])
            query, cell = np.nonzero(hit)
            ids.append(known[part][query])
            cells.append(number[cell])
    return pa.table({"id": np.concatenate(ids), "cell": np.concatenate(cells)})


def mean_similarity(asked: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(id, similar_ids, similarity): neighbours in order and their mean similarity, 0.0 where there is none."""
    in_order = F.array_sort(F.collect_list(F.struct("rank", "similar_id")))
    lists = neighbors.groupBy("id").agg(in_order["similar_id"].alias("similar_ids"), F.avg("similarity").alias("mean"))
    none = F.array().cast("array<bigint>")
    return asked.select("id").join(lists, "id", "left").select(
        "id",
        F.coalesce("similar_ids", none).alias("similar_ids"),
        F.coalesce("mean", F.lit(0.0)).alias("similarity"),
    )


def _usable(df: DataFrame, group: str | None) -> DataFrame:
    grp: Column = F.lit(0) if group is None else F.col(group)
    # floats travel as floats, in half the room; tasks calculate in doubles
    vec = F.col("vec") if df.schema["vec"].dataType == ArrayType(FloatType()) else F.col("vec").cast("array<double>")
    rows = df.select(F.col("id").cast("long").alias("id"), grp.alias("grp"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN sorts above infinity
    whole = finite & F.exists("vec", lambda x: x != 0)
    return rows.filter(F.col("grp").isNotNull() & whole)


def _lowest_copies(df: DataFrame, keep: int) -> DataFrame:
    """Of equal vectors only the lowest ids can rank among the best; the other copies are not needed as candidates."""
    hashed = df.withColumn("vec_hash", F.xxhash64("vec"))
    return top_per_key(hashed, ["grp", "vec_hash", "vec"], [F.col("id")], keep).select("id", "grp", "vec")


def _best(matches: DataFrame, k: int) -> DataFrame:
    return top_per_key(matches, ["id"], [F.col("gap"), F.col("similar_id")], k).select("id", "rank", "similar_id", "gap")


def _reported(best: DataFrame) -> DataFrame:
    return best.select("id", "rank", "similar_id", F.round(1 - F.col("gap") / 2, SIM_DIGITS).alias("similarity"))


def _match(asked: DataFrame, cand: DataFrame, sizes: DataFrame | int, k: int, split_rows: int) -> DataFrame:
    """Best ``k`` of every (query, candidate block) within the same group and cell.

    A cell with many candidates is hashed into blocks and one with many queries into splits, so that a task
    never holds more than a block of candidates and about ``split_rows`` queries, however hot the cell.
    ``sizes`` are the blocks by group and cell, or their number where there is one cell only.
    """
    cell = ["grp", "cell"]
    if isinstance(sizes, int):
        counts = {"blocks": sizes, "splits": ceil(asked.count() / split_rows)}
        counts = {name: F.lit(max(n, 1)).cast("long") for name, n in counts.items()}
        asked, cand = asked.withColumns(counts), cand.withColumns(counts)
    else:
        loads = asked.groupBy(*cell).agg(F.ceil(F.count("*") / split_rows).alias("splits"))
        layout = written(sizes.join(loads, cell), "cosine-layout")
        asked, cand = asked.join(layout, cell), cand.join(layout, cell)
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.select("id", "vec", "kth", *cell, place("splits").alias("split"), each("blocks").alias("block"))
    right = cand.select("id", "vec", *cell, place("blocks").alias("block"), each("splits").alias("split"))
    keys = [*cell, "block", "split"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        lambda q, c: _block_top_k(q, c, k), "id long, similar_id long, gap double",
    )


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.tolist()}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    # scaled by the largest entry first, so that huge or tiny entries neither overflow nor vanish when squared
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _block_top_k(asked: pa.Table, cand: pa.Table, k: int) -> pa.Table:
    """The best ``k`` candidates of each query, or those at least as near as its ``kth`` (a squared difference) where that is known."""
    found = []
    if asked.num_rows and cand.num_rows:
        cand_id = cand["id"].to_numpy()
        order = np.argsort(cand_id)
        cand_id, cand_rows = cand_id[order], _unit_rows(_matrix(cand["vec"]))[order]
        if len(asked) and cand_rows.shape[1] != _matrix(asked["vec"]).shape[1]:
            raise ValueError("vectors of different lengths")
        cand_vec, blur = cand_rows.T, 8e-16 * (cand_rows.shape[1] + 8)  # of the product
        asked_id, asked_vec = asked["id"].to_numpy(), _unit_rows(_matrix(asked["vec"]))
        kth = asked["kth"].to_numpy().astype(float)
        itself = np.searchsorted(cand_id, asked_id)
        itself[itself == len(cand_id)] = 0
        cut = max(len(cand_id) - k, 0)
        for start in range(0, len(asked_id), KERNEL_ROWS):
            part = slice(start, start + KERNEL_ROWS)
            ids, unit, floor = asked_id[part], asked_vec[part], 1 - kth[part] / 2
            sim = unit @ cand_vec
            own = np.flatnonzero(cand_id[itself[part]] == ids)
            sim[own, itself[part][own]] = -np.inf
            open_rows = np.flatnonzero(np.isnan(floor))
            floor[open_rows] = np.partition(sim[open_rows], cut, axis=1)[:, cut]
            row, col = np.nonzero((sim >= floor[:, None] - blur) & (sim > -np.inf))
            value = np.empty(len(row))
            for at in range(0, len(row), PAIRS):
                some = slice(at, at + PAIRS)
                value[some] = np.square(unit[row[some]] - cand_rows[col[some]]).sum(axis=1)
            by_rank = np.lexsort((col, value, row))
            row, col, value = row[by_rank], col[by_rank], value[by_rank]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append((ids[row[keep]], cand_id[col[keep]], value[keep]))
    ids, similar, value = map(np.concatenate, zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return pa.table({"id": ids, "similar_id": similar, "gap": value})


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))
