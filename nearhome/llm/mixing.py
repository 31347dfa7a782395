"""A mix of sources with target sizes, drawn by the cube method.

A document's size is its number of words. The sources in code-point order, null last, weigh 3, 1, 2 and so on again, and
share ``SHARE`` times all words by weight. A target stops at ``REPEAT`` times its source's size; what is above is shared
again by weight until no target is above.

A source with the rate target / size takes each of its documents as often as the whole part says, and once more with the
fractional part as inclusion probability. The extra draws are balanced: the probabilities move along directions in which the
totals of words and of documents stay as they are, at random to one side or the other and fairly, until they are 0 or 1 (flight).
The largest documents are decided first, each against all others that are undecided; after that three at a time are moved. A source is
dealt into blocks of about ``BLOCK`` documents that fly by themselves until ``LAND`` documents are left. These fly again in blocks of
the next round, until one block is left. Its last ``LAND`` documents land together: a linear programme over their outcomes keeps
every document's probability and makes the expected distance from the totals least; one outcome is drawn from its solution. So every
document is taken with its probability, also in a source of few documents, whose words then miss the target by as much as they must.

The draw depends on ids, sizes and the seed only, so reruns agree; repeated rows and rows without an id are separate documents and are
dealt to blocks one by one. Null texts have no words and are taken as often as any other document of their source, which adds no
words. Long texts are counted whole. Without any word all targets are 0; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhome.llm.common import WORD, by_row, numbered_copy, text_or_empty, unpacked
from nearhome.operators.numbering import numbered
from nearhome.session import written

WEIGHTS = (3, 1, 2)
SHARE, REPEAT = 1.5, 2
BLOCK, LAND, SEED = 4_000, 14, 42
SETTLED = 128  # documents of a block that are decided against all others
PIVOTS = 400  # of the linear programme; any of its steps keeps the probabilities
TINY = 1e-9


def targets(rows: DataFrame) -> DataFrame:
    """(source, source_no, source_size, target) of every source in ``rows`` (source, size)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = numbered(sizes, [F.col("source").asc_nulls_last()], "source_no", "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int"))
    sources = written(ordered.withColumn("weight", weight), "mix-weights")
    cap, level, capped = REPEAT * F.col("source_size"), 0.0, -1
    total = SHARE * (sources.agg(F.sum("source_size")).first()[0] or 0)
    while total:
        full = cap <= F.lit(level) * F.col("weight")
        n, taken, weights = sources.agg(
            F.count_if(full), F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))),
        ).first()
        if n == capped or not weights:
            break
        level, capped = (total - taken) / weights, n
    return sources.select(
        "source", "source_no", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"),
    )


def flight(chances: np.ndarray, sizes: np.ndarray, random: np.random.Generator, land: int = 0) -> np.ndarray:
    """Moves the chances to 0 or 1 until ``land`` documents, two at least, are left; the sums of chances and of words stay."""
    x, size = chances.astype(float).tolist(), sizes.astype(float).tolist()
    held: list[int] = []
    draws = iter(random.random(len(x)).tolist())
    waiting = [i for i in range(len(x)) if TINY < x[i] < 1 - TINY]
    for place, i in enumerate(waiting):
        if len(held) + len(waiting) - place <= land:
            break
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - x[k]) / d if d > 0 else -x[k] / d) for k, d in zip(held, u) if d)
        down = min((x[k] / d if d > 0 else (x[k] - 1) / d) for k, d in zip(held, u) if d)
        step = up if next(draws) * (up + down) < down else -down
        for k, d in zip(held, u):
            x[k] = min(1.0, max(0.0, x[k] + step * d))
        held = [k for k in held if TINY < x[k] < 1 - TINY]
    return np.array([v if TINY < v < 1 - TINY else round(v) for v in x])


def settled(chances: np.ndarray, sizes: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Decides the ``SETTLED`` largest documents, or all but ``LAND``; the others share the change, so that both sums stay."""
    x = chances.astype(float)
    for large in np.argsort(-sizes, kind="stable")[:SETTLED]:
        while TINY < x[large] < 1 - TINY:
            left = np.flatnonzero((x > TINY) & (x < 1 - TINY))
            if len(left) <= LAND:
                return x
            totals = np.stack([np.ones(len(left)), sizes[left] / max(1.0, sizes[left].max())])
            one = (left == large).astype(float)
            u = one - totals.T @ np.linalg.lstsq(totals @ totals.T, totals @ one, rcond=None)[0]
            moved = np.abs(u) > TINY
            if not moved.any():
                return x
            left, u = left[moved], u[moved]
            up = np.where(u > 0, (1 - x[left]) / u, -x[left] / u).min()
            down = np.where(u > 0, x[left] / u, (x[left] - 1) / u).min()
            x[left] += (up if random.random() * (up + down) < down else -down) * u
            x[x < TINY], x[x > 1 - TINY] = 0.0, 1.0
    return x


def landing(chances: np.ndarray, sizes: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Decides the few undecided by a draw that keeps every chance and the sums as nearly as the chances allow.

    The outcomes' probabilities solve a linear programme, by the simplex method from the outcomes that take the documents one after
    another by falling chance.
    """
    x = chances.copy()
    left = np.flatnonzero((x > 0) & (x < 1))
    if not len(left):
        return x
    outcomes = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
    moves = outcomes - x[left]
    cost = np.abs(moves @ sizes[left]) / max(1.0, sizes[left].max()) + 1e-3 * np.abs(moves.sum(axis=1))
    rows, wanted = np.concatenate([outcomes, np.ones((len(outcomes), 1))], axis=1).T, np.append(x[left], 1.0)
    basis = np.append(0, np.cumsum(1 << np.argsort(-x[left], kind="stable")))
    for _ in range(PIVOTS):
        held = rows[:, basis]
        gains = cost - np.linalg.solve(held.T, cost[basis]) @ rows
        best = int(np.argmin(gains))
        if gains[best] > -TINY:
            break
        weights, change = np.maximum(np.linalg.solve(held, wanted), 0.0), np.linalg.solve(held, rows[:, best])
        with np.errstate(divide="ignore", invalid="ignore"):
            basis[int(np.argmin(np.where(change > TINY, weights / change, np.inf)))] = best
    weights = np.maximum(np.linalg.solve(rows[:, basis], wanted), 0.0)
    drawn_at = np.searchsorted(np.cumsum(weights), random.random() * weights.sum(), "right")
    x[left] = outcomes[basis[min(int(drawn_at), len(basis) - 1)]]
    return x


def drawn(units: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(row, extra): 0 or 1 for every row of ``units`` (row, doc_id, source_no, size, chance)."""
    out_schema = "row long, doc_id long, source_no long, size long, chance double"

    def fly(turn: int):
        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            ids = rows["doc_id"].to_numpy(float, na_value=np.nan)
            rows = rows.iloc[np.lexsort((rows["row"], ids, rows["mixed"], -rows["size"]))]
            random = np.random.default_rng([seed, turn, int(key[0]), int(key[1])])
            sizes = rows["size"].to_numpy(float)
            chances = flight(settled(rows["chance"].to_numpy(float), sizes, random), sizes, random, LAND)
            rows["chance"] = landing(chances, sizes, random) if rows["blocks"].iloc[0] == 1 else chances
            return rows[["row", "doc_id", "source_no", "size", "chance"]]

        return run

    decided, turn = None, 0
    while True:
        # numbers within a source deal its rows evenly, also those with one id or none
        order = [F.col("source_no"), F.col("mixed"), F.col("doc_id"), F.col("size"), F.col("row")]
        placed = numbered(units.withColumn("mixed", F.xxhash64(F.lit(seed + turn), "doc_id")), order, "place", f"mix-places-{turn}")
        shares = written(placed.groupBy("source_no").agg(F.min("place").alias("first"), F.ceil(F.count("*") / block).alias("blocks")), f"mix-blocks-{turn}")
        dealt = placed.join(shares, "source_no").withColumn("block", (F.col("place") - F.col("first")) % F.col("blocks"))
        flown = written(dealt.groupBy("source_no", "block").applyInPandas(fly(turn), out_schema), f"mix-round-{turn}")
        done = flown.filter("chance = 0 OR chance = 1").select("row", F.col("chance").cast("int").alias("extra"))
        decided = done if decided is None else decided.unionByName(done)
        if (shares.agg(F.max("blocks")).first()[0] or 0) <= 1:
            return decided
        units, turn = flown.filter("chance > 0 AND chance < 1"), turn + 1  # ``LAND`` documents a block at most


def mixed(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` (row, doc_id, source, size), written, with source_size, target and ``times``."""
    rates = written(targets(rows), "mix-targets").withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    rates = rates.withColumn("whole", F.floor(F.col("rate") + TINY).cast("int"))
    rates = rates.withColumn("chance", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    rated = written(rows.join(rates, rows["source"].eqNullSafe(rates["source"])).drop(rates["source"]), "mix-rated")
    units = rated.filter(F.col("chance") > TINY).select("row", F.col("doc_id").cast("long").alias("doc_id"), "source_no", "size", "chance")
    extra = drawn(units, seed)
    return rated.join(extra, "row", "left").select(
        "row", "doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("times"),
    )


def words(text: F.Column) -> F.Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(row, doc_id, source, size) of the documents, written."""
    return written(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.col("source").cast("string").alias("source"), words(text_or_empty()).alias("size"),
    ), "mix-sizes")


def mix(docs: DataFrame) -> DataFrame:
    """The documents, each as often as the mix takes it; all their columns as they came."""
    copy = numbered_copy(docs, "mix-docs", size=words(text_or_empty()))
    rows = written(copy.select("row", "doc.doc_id", F.col("doc.source").cast("string").alias("source"), "size"), "mix-sizes")
    times = written(mixed(rows).filter("times > 0").select("row", F.array_repeat(F.lit(0), F.col("times")).alias("each")), "mix-times")
    return unpacked(by_row(copy.select("row", "doc"), times).select("doc", F.explode("each")), "doc")
