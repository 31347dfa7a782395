"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 poor, 2 good; of several ratings of a document the lowest counts. One weight per hashed feature is
shared by all grades, and ordered thresholds divide the line: P(grade <= k) = logistic(threshold_k - weights . features).
The model gives the expected grade and the tail probabilities P(grade >= k); documents whose tail at the top grade is at
least ``SELECT`` are kept.

Features are hashed: the words of a text without case and outer punctuation, their shapes, and how often words repeat.
A feature counts once a text. It is scaled by how far the share of texts that have it differs between low and high
grades beyond ``ERRORS`` standard errors, so features without evidence are left out.

The model is fitted on ``ROWS`` rated documents at most, those with the smallest hashes of their id; this documented bound
allows to broadcast their ids. The fit is L-BFGS on the driver with gradients summed by Spark tasks. All documents are
scored in one pass. Null texts have no feature but that of no words. With no rating at all the expected grade and the
tails are those of thresholds at even odds, and nothing is selected against: every document is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhome.session import written

GRADES = 3
ROWS = 20_000
BUCKETS = 1 << 18
ERRORS, RIDGE, SELECT = 3.0, 1e-4, 0.3
TASKS, STEPS, MEMORY, ENOUGH = 12, 40, 8, 1e-4
_SHAPES = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def features(text: str | None) -> np.ndarray:
    """The buckets of a whole text, each once, in order."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").split()
    different = set(words)
    plain = {w.strip(b".,;:!?\"'()").lower() for w in different}
    shapes = {_RUNS.sub(rb"\1", w.translate(_SHAPES)) for w in different}
    counts = [b"%d tenths differ" % (10 * len(different) // max(1, len(words))), b"%d bits long" % len(words).bit_length()]
    found = [*(xxh64_intdigest(w) for w in plain), *(xxh64_intdigest(w, 1) for w in shapes), *(xxh64_intdigest(w, 2) for w in counts)]
    return np.unique(np.array(found, np.uint64) % np.uint64(BUCKETS)).astype(np.int32)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): the lowest grade among a document's ratings; incomplete ratings are left out."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))


def rated_features(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """(grade, features) of at most ``rows`` rated documents, written in ``TASKS`` parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["grade", "features"])

    chosen = written(grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "model-ratings")
    rated = docs.join(F.broadcast(chosen), "doc_id").select("grade", F.col("text").cast("string"))  # ``rows`` ids at most
    return written(rated.mapInArrow(run, "grade int, features binary").repartition(TASKS), "model-features")


class Model:
    """Weights per bucket (already scaled) and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, found: list[np.ndarray]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each set of buckets."""
        line = np.array([self.weights[f].sum() for f in found])
        return _logistic(line[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _thresholds(raw: np.ndarray) -> np.ndarray:
    """The first as it is, the others by the logarithms of their gaps, so they are always in order."""
    return np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])


def loss_and_slopes(grade: np.ndarray, rows: np.ndarray, flat: np.ndarray, scale: np.ndarray, point: np.ndarray) -> np.ndarray:
    """[negative log likelihood, its slopes by the point] of some rated texts; ``flat`` are their buckets, ``rows`` whose."""
    n = len(scale)
    cuts = np.concatenate([[-np.inf], _thresholds(point[n:]), [np.inf]])
    line = np.bincount(rows, weights=(point[:n] * scale)[flat], minlength=len(grade))
    high, low = (_logistic(np.clip(cuts[grade + k] - line, -35, 35)) for k in (1, 0))
    chance = np.maximum(high - low, 1e-12)
    by_high, by_low = high * (1 - high) / chance, low * (1 - low) / chance
    out = np.zeros(1 + n + GRADES - 1)
    out[0] = -np.log(chance).sum()
    out[1 : n + 1] = scale * np.bincount(flat, weights=(by_high - by_low)[rows], minlength=n)
    by_cut = np.array([by_low[grade == k + 1].sum() - by_high[grade == k].sum() for k in range(GRADES - 1)])
    out[n + 1] = by_cut.sum()
    out[n + 2 :] = np.exp(point[n + 1 :]) * np.cumsum(by_cut[::-1])[::-1][1:]
    return out


def _sums(rated: DataFrame, size: int, job) -> np.ndarray:
    """The sum over tasks of the vector that ``job`` makes of a task's (grades, rows, flat buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            found = [np.frombuffer(x.as_py(), np.int32) for x in batch.column(1)]
            if found:
                rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
                total += job(batch.column(0).to_numpy().astype(int), rows, np.concatenate(found))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = rated.coalesce(TASKS).mapInArrow(run, "total binary").collect()  # a vector of fixed size per task, ``TASKS`` of them
    return sum((np.frombuffer(p["total"]) for p in parts), np.zeros(size))


def _evidence(rated: DataFrame, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, scales) of the features whose share differs between low and high grades, by the texts that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((BUCKETS, GRADES), np.int64)
        for batch in batches:
            for grade, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts[np.frombuffer(x.as_py(), np.int32), grade] += 1
        at = np.flatnonzero(counts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(counts[at, k]) for k in range(GRADES))], ["bucket", *names])

    names = [f"grade_{k}" for k in range(GRADES)]
    counts = rated.coalesce(TASKS).mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in names))
    totals = counts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names])
    scales = []
    for k in range(1, GRADES):
        low, high = (sum(map(F.col, some), F.lit(0.5)) for some in (names[:k], names[k:]))
        apart = F.abs(F.log(low / float(texts[:k].sum() + 1)) - F.log(high / float(texts[k:].sum() + 1)))
        scales.append(apart - ERRORS * F.sqrt(1 / low + 1 / high))
    found = totals.select("bucket", F.greatest(*scales).alias("scale")).filter("scale > 0").orderBy("bucket").collect()  # BUCKETS rows at most
    return np.array([r["bucket"] for r in found], np.int64), np.array([r["scale"] for r in found], float)


def _renumbered(rated: DataFrame, used: np.ndarray) -> DataFrame:
    """The rated features by their place in ``used``, without the others, written: so each step sends the tasks little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int32)
        place[used] = np.arange(len(used))
        for batch in batches:
            places = [place[np.frombuffer(x.as_py(), np.int32)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[p >= 0].tobytes() for p in places], pa.binary())], ["grade", "features"])

    return written(rated.mapInArrow(run, "grade int, features binary"), "model-places")


def fitted(rated: DataFrame) -> Model | None:
    """The model, or None without two different grades."""
    texts = np.zeros(GRADES)
    for grade, n in rated.groupBy("grade").count().collect():
        texts[grade] = n
    n = texts.sum()
    if (texts > 0).sum() < 2:
        return None
    used, scale = _evidence(rated, texts)
    size = len(used)
    slim = _renumbered(rated, used)

    def objective(point: np.ndarray) -> tuple[float, np.ndarray]:
        job = lambda grade, rows, flat: loss_and_slopes(grade, rows, flat, scale, point)
        total = _sums(slim, 1 + size + GRADES - 1, job) / n
        total[1 : size + 1] += RIDGE * point[:size]
        return total[0] + RIDGE / 2 * (point[:size] @ point[:size]), total[1:]

    shares = np.clip(np.cumsum(texts)[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(shares / (1 - shares))
    point = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    point = _minimum(objective, point)
    weights = np.zeros(BUCKETS)
    weights[used] = point[:size] * scale
    return Model(weights, _thresholds(point[size:]))


def _minimum(objective, point: np.ndarray) -> np.ndarray:
    """L-BFGS with step halving."""
    value, slope = objective(point)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        turn, used = slope.copy(), []
        for move, change in reversed(moves):
            used.append((move @ turn) / (change @ move))
            turn -= used[-1] * change
        turn *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else 1 / max(1e-9, np.abs(slope).max())
        for (move, change), a in zip(moves, reversed(used)):
            turn += move * (a - (change @ turn) / (change @ move))
        step = 1.0
        while True:
            there = point - step * turn
            next_value, next_slope = objective(there)
            if next_value <= value - 1e-4 * step * (slope @ turn) or step < 1e-3:
                break
            step /= 2
        if next_value >= value:
            return point
        pair = (there - point, next_slope - slope)
        if pair[0] @ pair[1] > 1e-12:
            moves = [*moves, pair][-MEMORY:]
        done = value - next_value < ENOUGH * abs(value)
        point, value, slope = there, next_value, next_slope
        if done:
            break
    return point


def graded(docs: DataFrame, model: Model | None, keep: list[str], select: float = SELECT) -> DataFrame:
    """The ``keep`` columns, ``expected_grade``, ``p_ge_1``, ``p_ge_2`` and ``kept`` of every document."""
    model_or_even = model or Model(np.zeros(BUCKETS), np.zeros(GRADES - 1))
    shared = docs.sparkSession.sparkContext.broadcast(model_or_even)  # BUCKETS numbers, whatever the corpus
    names = [f"p_ge_{k}" for k in range(1, GRADES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = shared.value.tails([features(t.as_py()) for t in batch.column(len(keep))]).round(9)
            columns = [tails.sum(axis=1), *tails.T]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, columns)], [*keep, "expected_grade", *names])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} double" for c in ("expected_grade", *names))])
    done = docs.select(*keep, F.col("text").cast("string").alias("text to grade")).mapInArrow(run, schema)
    return done.withColumn("kept", F.lit(True) if model is None else F.col(names[-1]) >= select)
