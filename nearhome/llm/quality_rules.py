"""Quality rules: counts over the words of a text, and a likelihood ratio of hashed n-grams.

Words are ``[^\\x20\\x09-\\x0D]+``. A text fails the base rules with fewer than ``MIN_WORDS`` words, or when more than
``MAX_REPEAT`` percent of its words lie in a window of ``WINDOW`` words that the text has twice or more.

The others are judged by two multinomials over hashed one- and two-word n-grams: that of trusted target documents and
that of the raw corpus. The score is the mean log ratio of a text's n-grams. Every document at or above the threshold is
kept, so the same document is always judged alike. The threshold lies ``MARGIN`` times as far below the median of the
trusted documents' own scores as their ``TAIL`` quantile does, so that documents like the trusted ones stay.

The raw model counts every n-gram of all documents, the target model those of all trusted ones, and the quantiles are
those of all trusted documents (by a sketch with a rank error of 1 in 100,000). Trusted are ids labelled with quality 1
and never with quality 0 or toxic 1. Without any trusted document the method keeps what the base rules keep.

A null or empty text has no words and fails. Repeated rows are judged alike; a null doc_id is never trusted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhome.llm.common import packed, unpacked, written_densely
from nearhome.session import written

MIN_WORDS, MAX_REPEAT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"
BUCKETS = 1 << 14
TAIL, MARGIN = 0.005, 2.0
CHUNK = 1 << 20  # words hashed at once

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def word_ids(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """A number per different word in order of first sight, for every word of a text."""
    seen: dict[bytes, int] = {}
    number = seen.setdefault
    return np.fromiter((number(w, len(seen)) for w in words), np.int64, len(words)), list(seen)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window (a power of two words) that occurs twice or more; exact, by doubling the window."""
    if len(ids) <= window:
        return 0
    width = 1
    while width < window:
        _, ids, times = np.unique(ids[:-width] * (len(ids) + 1) + ids[width:], return_inverse=True, return_counts=True)
        if len(times) == len(ids):
            return 0
        width *= 2
    starts = np.flatnonzero(times[ids] > 1)
    edges = np.zeros(len(ids) + window, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def measures(data: bytes, words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """The values of ``MEASURES`` for a text in UTF-8."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    chars = int(((flat & 0xC0) != 0x80).sum())
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(ids)


def ngram_buckets(ids: np.ndarray, vocabulary: list[bytes], buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all one- and two-word n-grams of a text, in pieces of bounded size."""
    from xxhash import xxh64_intdigest

    hashes = np.fromiter((xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    for at in range(0, len(ids), CHUNK):
        words = hashes[ids[at : at + CHUNK + 1]]
        pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + (words[1:] ^ np.uint64(0xD6E8FEB86659FD93))
        pairs = (pairs ^ (pairs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        yield (words[:CHUNK] >> np.uint64(20)).astype(np.int64) % buckets
        yield (pairs >> np.uint64(20)).astype(np.int64) % buckets


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id): the distinct ids with good labels only."""
    good = (
        labels.filter("doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")).filter("quality = 1 AND toxic = 0")
    )
    return good.select("doc_id")


def counted(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in all documents and in the trusted ones; a task sends its ``BUCKETS`` sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts, known = batch.column(0), batch.column(1).to_pylist()
            for at in range(batch.num_rows):
                for buckets in ngram_buckets(*word_ids((texts[at].as_py() or "").encode("utf-8", "surrogatepass").split())):
                    counts = np.bincount(buckets, minlength=BUCKETS)
                    raw += counts
                    if known[at]:
                        target += counts
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    sums = _flagged(docs, trusted).mapInArrow(run, "bucket long, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, n, m in sums.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # BUCKETS rows at most
        raw[bucket], target[bucket] = n, m
    return raw, target


def scored(docs: DataFrame, keep: list[str], ratios: np.ndarray) -> DataFrame:
    """The ``keep`` columns, ``scored_id`` (the doc_id), the measures, and ``score``: the mean log ratio of all n-grams, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # BUCKETS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found, scores = batch.column(len(keep)), [], []
            for at in range(batch.num_rows):
                data = (texts[at].as_py() or "").encode("utf-8", "surrogatepass")
                words = data.split()
                ids, vocabulary = word_ids(words)
                found.append(measures(data, words, ids))
                total = sum(float(shared.value[b].sum()) for b in ngram_buckets(ids, vocabulary))
                scores.append(round(total / max(1, 2 * len(ids) - 1), 9))
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], batch.column(len(keep) + 1), *columns, pa.array(scores, pa.float64())], names)

    names = [*keep, "scored_id", *MEASURES, "score"]
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"scored_id {types['doc_id']}", *(f"{c} long" for c in MEASURES), "score double"])
    return docs.select(*keep, F.col("text").cast("string").alias("text to score"), F.col("doc_id").alias("scored_id")).mapInArrow(run, schema)


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw per bucket, with one added to every count; all zero without a target."""
    if not target.sum():
        return np.zeros(len(raw))
    share = lambda counts: np.log((counts + 1.0) / (counts.sum() + len(counts)))
    return share(target) - share(raw)


def judged(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, the measures, ``score``, ``base_failed`` and ``kept``, one row per document.

    The texts are read twice, once to count and once to score. To count, they are shuffled once to meet the trusted ids; the
    quantiles need a join of ids and scores only.
    """
    trusted = written(trusted_ids(labels), "quality-trusted")
    scores = written_densely(scored(docs, keep, log_ratios(*counted(docs, trusted))), "quality-scores")
    good = scores.select(F.col("scored_id").alias("doc_id"), "score").join(trusted.hint("shuffle_hash"), "doc_id", "left_semi")
    quantiles = good.select(F.percentile_approx("score", [0.5, TAIL], 100_000).alias("q")).first()["q"]
    threshold = float("-inf") if quantiles is None else quantiles[0] - MARGIN * (quantiles[0] - quantiles[1])
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return scores.select(
        *keep, *MEASURES, "score", base_failed.alias("base_failed"), (~base_failed & (F.col("score") >= F.lit(threshold))).alias("kept"),
    )


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep; all their columns as they came. They go along with their scores, so no join is needed."""
    whole = docs.select(packed(docs).alias("doc")).select("doc", "doc.doc_id", "doc.text")
    return unpacked(judged(whole, labels, ["doc"]).filter("kept"), "doc")


def _flagged(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(text to count, trusted). Ids grow with the labels, so they are never broadcast."""
    ids = trusted.select("doc_id", F.lit(True).alias("known")).hint("shuffle_hash")
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text to count")).join(ids, "doc_id", "left")
    return joined.select("text to count", F.coalesce("known", F.lit(False)).alias("trusted"))
