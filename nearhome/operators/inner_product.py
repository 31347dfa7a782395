"""The items with the largest inner product for every user, exactly and without scoring all pairs.

Items are ordered by falling length and cut into blocks. By the Cauchy-Schwarz inequality no item of a block scores more than
the user's length times the block's greatest length, and the lengths fall from block to block. Every user first meets the head of
the items, which gives a score that the n-th best has at least; all blocks behind the first one that cannot reach it are left out
for this user. The users that need more go on in rounds, of twice as many ranges of blocks each time. A task takes a range and a split of
the users, goes through the items by falling length, raises what its users need, and leaves a user as soon as no item can reach it.
So a user travels once a range and an item once a split, also where the lengths are alike and no block can be left out.

Scores are the sums of the products in order, in doubles; a product in single precision makes the shortlist only. Equal scores go to the lower
id. Vectors with a null, NaN or infinity are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from nearhome.operators.numbering import numbered
from nearhome.session import shuffles_removed, written

BLOCK_ROWS = 1024      # items that a user's needs are told by
RANGE_ROWS = 1 << 20   # items that one task holds
SPLIT_ROWS = 1 << 15   # users that one task holds
SPLITS = 24            # of fewer users, down to ``BLOCK_ROWS`` each
KERNEL_ROWS = 256      # users of one matrix product
SLICE_ROWS = 4096      # items of one matrix product
SLACK = 1e-9           # covers rounding in the bound
SINGLE = 1e15          # lengths above this are not multiplied in single precision


def top_products(users: DataFrame, items: DataFrame, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(user_id, rank, item_id, score): the ``n`` best items of every user, of (user_id, vec) and (item_id, vec)."""
    lists = top_lists(users, items, n, block_rows)
    rows = lists.select("user_id", F.posexplode(F.arrays_zip("items", "scores")).alias("pos", "best"))
    return rows.select("user_id", (F.col("pos") + 1).alias("rank"), F.col("best.items").alias("item_id"), F.col("best.scores").alias("score"))


def top_lists(users: DataFrame, items: DataFrame, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(user_id, items, scores, scored): the best items in order, one row a user, and how many items were scored for it."""
    with shuffles_removed(users.sparkSession):
        return _top_lists(users, items, n, block_rows)


def _top_lists(users: DataFrame, items: DataFrame, n: int, block_rows: int) -> DataFrame:
    asked = _usable(users, "user_id")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x))
    placed = numbered(_usable(items, "item_id").withColumn("length", length), [F.col("length").desc(), F.col("item_id")], "place", "product-items")
    placed = written(placed.withColumn("block", F.floor(F.col("place") / block_rows)), "product-blocks")
    bounds = placed.groupBy("block").agg(F.max("length").alias("length")).orderBy("block").collect()
    limits = np.array([r["length"] for r in bounds])  # one number a block
    done = min(ceil(n / block_rows), len(bounds))
    head = placed.filter(F.col("block") < done).select("item_id", "vec").toArrow()  # the first blocks that hold n items
    state = written(_met_head(asked, head, limits, n, block_rows), "product-head")
    per = max(1, RANGE_ROWS // block_rows)
    finished, width = [], per
    while done < len(bounds):
        finished.append(state.filter(F.col("last") < done))
        active = state.filter(F.col("last") >= done)
        count = active.count()
        if not count:
            break
        end = min(done + width, len(bounds))
        state = written(_met_blocks(active, count, placed, limits, done, end, per, n, block_rows), f"product-round-{end}")
        done, width = end, 2 * width
    else:
        finished.append(state)
    found = finished[0]
    for part in finished[1:]:
        found = found.unionByName(part)
    return found.select("user_id", "items", "scores", "scored")


def _usable(df: DataFrame, key: str) -> DataFrame:
    vec = F.col("vec") if df.schema["vec"].dataType == ArrayType(FloatType()) else F.col("vec").cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias(key), vec.alias("vec"))
    return rows.filter(F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def _lists(asked: DataFrame) -> str:
    vec = asked.schema["vec"].dataType.simpleString()
    return f"user_id long, vec {vec}, items array<long>, scores array<double>, kth double, last long, scored long"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def last_block(lengths: np.ndarray, kth: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The last block with an item that may score ``kth`` for a user of this length; the limits fall."""
    with np.errstate(divide="ignore", invalid="ignore"):
        needed = np.where(np.isnan(kth) | (kth <= 0), -np.inf, kth * (1 - SLACK) / lengths)
    return np.searchsorted(-limits, -needed, "right") - 1


def _ranked(row: np.ndarray, ids: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[keep], ids[keep], score[keep]


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _best(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, n: int, step: int, held: Found | None = None) -> tuple[Found, np.ndarray]:
    """(row, id, score) of the ``n`` best items of every row that score ``floor`` at least, ``held`` ones included, in order; and how many were scored.

    The items are gone through by falling length, ``step`` at first and then in growing slices.
    """
    rows = rows.astype(np.float64, copy=False)
    lengths = np.sqrt(np.square(vectors, dtype=np.float64).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    ids, vectors, lengths = ids[order], vectors[order], lengths[order]
    reach = np.linalg.norm(rows, axis=1)
    kind = np.float32 if max(reach.max(initial=0), lengths.max(initial=0)) < SINGLE else np.float64
    blur = (vectors.shape[1] + 8) * float(np.finfo(kind).eps) * (lengths[0] if len(lengths) else 0.0)
    held = held or (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    scored, done = np.zeros(len(rows), np.int64), []
    for start in range(0, len(rows), KERNEL_ROWS):
        part, own = rows[start : start + KERNEL_ROWS], reach[start : start + KERNEL_ROWS]
        quick = part.astype(kind)
        least = np.where(np.isnan(floor[start : start + KERNEL_ROWS]), -np.inf, floor[start : start + KERNEL_ROWS])
        ends = np.searchsorted(held[0], [start, start + len(part)])
        found, fresh = [(held[0][slice(*ends)] - start, held[1][slice(*ends)], held[2][slice(*ends)])], 0
        at, width = 0, step
        while at < len(ids):
            live = np.flatnonzero((least <= 0) | (own * lengths[at] >= least * (1 - SLACK)))
            if not len(live):
                break
            some = vectors[at : at + width]
            near = quick[live] @ some.astype(kind, copy=False).T
            cut = least[live]
            open_rows = np.flatnonzero(np.isneginf(cut))
            if len(open_rows) and len(some) > n:
                cut[open_rows] = np.partition(near[open_rows], len(some) - n, axis=1)[:, len(some) - n]
            cut = (cut - 2 * blur * own[live] - 1e-30).astype(kind)
            hit = np.flatnonzero(near >= np.nextafter(cut, kind(-np.inf))[:, None])
            row, col = live[hit // len(some)], hit % len(some)
            left, right = part[row], some[col].astype(np.float64)
            score = np.zeros(len(row))
            for k in range(vectors.shape[1]):
                score += left[:, k] * right[:, k]
            keep = score >= least[row]
            found.append((row[keep], ids[at + col[keep]], score[keep]))
            scored[start + live] += len(some)
            at, width, fresh = at + len(some), min(2 * width, max(SLICE_ROWS, step)), fresh + int(keep.sum())
            if fresh >= n * len(part) // 4:
                found, fresh = [_ranked(*map(np.concatenate, zip(*found)), n)], 0
                row, count = np.unique(found[0][0], return_counts=True)
                nth = (np.cumsum(count) - 1)[count == n]
                least[row[count == n]] = np.maximum(least[row[count == n]], found[0][2][nth])
        row, item, score = _ranked(*map(np.concatenate, zip(*found)), n)
        done.append((row + start, item, score))
    return tuple(map(np.concatenate, zip(*done))) if done else held, scored


def _listed(found: Found, count: int, n: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Items and scores as lists, and the n-th score of every row that has one."""
    ends = np.searchsorted(found[0], np.arange(count + 1))
    kth, full = np.full(count, np.nan), np.diff(ends) == n
    kth[full] = found[2][ends[1:][full] - 1]
    offsets = pa.array(ends.astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(found[1], pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(found[2], pa.float64())), pa.array(kth)


def _met_head(asked: DataFrame, head: pa.Table, limits: np.ndarray, n: int, step: int) -> DataFrame:
    shared = asked.sparkSession.sparkContext.broadcast((head["item_id"].to_numpy(), _matrix(head["vec"]), limits))  # n items, rounded up to blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, falling = shared.value
        for batch in batches:
            rows = _matrix(batch.column(1))
            found, scored = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), np.zeros(len(rows), np.int64)
            if len(ids) and len(rows):
                found, scored = _best(rows, ids, vectors, np.full(len(rows), np.nan), n, step)
            items, scores, kth = _listed(found, len(rows), n)
            last = last_block(np.linalg.norm(rows.astype(np.float64), axis=1), kth.to_numpy(zero_copy_only=False), falling)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), items, scores, kth, pa.array(last, pa.int64()), pa.array(scored)],
                ["user_id", "vec", "items", "scores", "kth", "last", "scored"],
            )

    return asked.mapInArrow(run, _lists(asked))


def split_count(users: int) -> int:
    return max(1, ceil(users / SPLIT_ROWS), min(SPLITS, ceil(users / BLOCK_ROWS)))


def _met_blocks(active: DataFrame, count: int, placed: DataFrame, limits: np.ndarray, start: int, end: int, per: int, n: int, step: int) -> DataFrame:
    """``active`` after its users have met those of the blocks from ``start`` to ``end`` that they need.

    A task holds a range of ``per`` blocks and a split of the users. What a user has so far goes along with the first range; the lists of
    several ranges are ranked once a round.
    """
    splits, ranges = split_count(count), ceil((end - start) / per)
    last = F.floor((F.least(F.col("last"), F.lit(end - 1)) - start) / per).cast("long")
    left = active.withColumn("split", F.pmod(F.xxhash64("user_id"), F.lit(splits))).withColumn("range", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    left = left.select("user_id", *[F.when(F.col("range") == 0, F.col(c)).alias(c) for c in ("items", "scores", "scored")], "kth", "vec", "range", "split")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long")))
    within = F.floor((F.col("block") - start) / per).cast("long")
    right = placed.filter(F.col("block").between(start, end - 1)).select("item_id", "vec", within.alias("range"), every.alias("split"))

    def meet(users: pa.Table, items: pa.Table) -> pa.Table:
        if not users.num_rows:
            return users.select(["user_id", "vec", "items", "scores", "kth"]).append_column("last", pa.array([], pa.int64())).append_column("scored", pa.array([], pa.int64()))
        lists, scores = users["items"].combine_chunks(), users["scores"].combine_chunks()
        sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        held = (np.repeat(np.arange(len(users)), sizes), lists.flatten().to_numpy(), scores.flatten().to_numpy())
        found, scored = held, np.zeros(len(users), np.int64)
        if items.num_rows:
            found, scored = _best(_matrix(users["vec"]), items["item_id"].to_numpy(), _matrix(items["vec"]), users["kth"].to_numpy().astype(float), n, step, held)
        rows, values, kth = _listed(found, len(users), n)
        before = np.nan_to_num(users["scored"].to_numpy().astype(float)).astype(np.int64)
        return pa.table({
            "user_id": users["user_id"], "vec": users["vec"], "items": rows, "scores": values, "kth": kth,
            "last": pa.array(np.zeros(len(users), np.int64)), "scored": pa.array(before + scored),
        })

    keys = ["range", "split"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, _lists(active))
    if ranges > 1:
        pairs = F.transform(F.arrays_zip("items", "scores"), lambda x: F.struct((-x["scores"]).alias("down"), x["items"].alias("item_id")))
        merged = F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, n)
        lists = lists.groupBy("user_id").agg(F.first("vec").alias("vec"), merged.alias("best"), F.sum("scored").alias("scored")).select(
            "user_id", "vec", F.transform("best", lambda x: x["item_id"]).alias("items"), F.transform("best", lambda x: -x["down"]).alias("scores"),
            F.when(F.size("best") == n, -F.element_at("best", -1)["down"]).otherwise(F.lit(float("nan"))).alias("kth"), F.lit(0).cast("long").alias("last"), "scored",
        )
    shared = active.sparkSession.sparkContext.broadcast(limits)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kth = batch.column(4).to_numpy(zero_copy_only=False).astype(float)
            needed = last_block(np.linalg.norm(_matrix(batch.column(1)).astype(np.float64), axis=1), kth, shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(needed, pa.int64()), batch.column(6)], batch.schema.names)

    return lists.mapInArrow(again, _lists(active))


def all_scores(users: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(user_id, best): the ``n`` highest scores of every user, from the products with all items.

    ``users`` are (user_id, vec, floor): scores clearly below a user's ``floor`` are taken and not given out, so that a pair costs time and
    no room; without a floor (null) up to ``n`` of every range of items come out. No item is left out by its length.
    """
    asked, offered = written(users.select("user_id", "vec", "floor"), "scores-users"), written(items.select("item_id", "vec"), "scores-items")
    splits, ranges = split_count(asked.count()), max(1, ceil(offered.count() / RANGE_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asked.select("*", F.pmod(F.xxhash64("user_id"), F.lit(splits)).alias("split"), every(ranges).alias("range"))
    right = offered.select("vec", F.pmod(F.xxhash64("item_id"), F.lit(ranges)).alias("range"), every(splits).alias("split"))

    def meet(asked: pa.Table, offered: pa.Table) -> pa.Table:
        rows, scores = [np.empty(0, np.int64)], [np.empty(0)]
        if asked.num_rows and offered.num_rows:
            vectors, all_rows = _matrix(offered["vec"]), _matrix(asked["vec"])
            floor = asked["floor"].to_numpy().astype(float)
            floor = np.where(np.isnan(floor), -np.inf, floor - 1e-4 * np.maximum(1.0, np.abs(floor)))
            for start in range(0, len(all_rows), KERNEL_ROWS):
                part = all_rows[start : start + KERNEL_ROWS]
                for at in range(0, len(vectors), SLICE_ROWS):
                    some = vectors[at : at + SLICE_ROWS]
                    near, cut = part @ some.T, floor[start : start + KERNEL_ROWS].astype(part.dtype)
                    many = np.flatnonzero((near >= cut[:, None]).sum(axis=1) > n)
                    if len(many):
                        cut[many] = np.partition(near[many], len(some) - n, axis=1)[:, len(some) - n]
                    hit = np.flatnonzero(near >= cut[:, None])
                    row, col = hit // len(some), hit % len(some)
                    rows.append(row + start)
                    scores.append(np.einsum("ij,ij->i", part[row].astype(np.float64), some[col].astype(np.float64)))
        row, score = np.concatenate(rows), np.concatenate(scores)
        row, _, score = _ranked(row, np.zeros(len(row), np.int64), score, n)
        ends = np.searchsorted(row, np.arange(asked.num_rows + 1))
        return pa.table({"user_id": asked["user_id"], "scores": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(score))})

    keys = ["range", "split"]
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "user_id long, scores array<double>")
    return lists.groupBy("user_id").agg(F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("scores")))), 1, n).alias("best"))
