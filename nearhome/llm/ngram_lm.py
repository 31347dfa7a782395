"""Stupid-backoff language-model scores of all documents under the n-gram counts of all others.

For a word behind its context, the longest n-gram that ends there and occurs in other documents counts:
``BACKOFF ** (orders given up) * count(n-gram) / count(context)``; the context of a single word is all words. A word that
occurs nowhere else counts as ``UNSEEN`` times. Counts are those of the whole corpus less those of the document itself, so
no document vouches for itself. The score is the mean natural logarithm over the words of a text.

Three steps, each a Spark shuffle of its own:

1. Texts are packed into chunks of whole documents, which are written. A chunk's n-grams are hashed, counted and sent to
   the parts of the count tables, which divide the hashes. An n-gram travels once a chunk, however frequent it is, so no part is hot.
2. A part adds up the counts of all chunks and joins them back to the n-grams of each chunk.
3. A chunk explodes its texts into n-grams again, meets their counts and sums up the logarithms per document.

Between the steps, the sorted hashes of a chunk and part travel as one row with packed differences, and the counts come
back in the same order, so they need no hashes. The number of parts follows the size of the corpus. N-grams are told apart
by 64-bit hashes. A null or empty text has no words and the score 0; repeated rows count as documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhome.llm.common import WORD, by_row, numbered_copy
from nearhome.session import written

ORDER, BACKOFF, UNSEEN = 2, 0.4, 0.5
CHUNK = 8 << 20  # bytes of text
PART = 8 << 20  # bytes of text per part of the count tables
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed_ngrams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(hashes, first words, lengths): for each order the n-grams of all texts and where they begin; words per text."""
    from xxhash import xxh64_intdigest

    seen: dict[bytes, int] = {}
    number, parts = seen.setdefault, []
    for text in texts:
        words = text.split()
        parts.append(np.fromiter((number(w, len(seen)) for w in words), np.int64, len(words)))
    lengths = np.array([len(p) for p in parts], np.int64)
    vocabulary = np.fromiter(map(xxh64_intdigest, seen), np.uint64, len(seen))
    words = vocabulary[np.concatenate(parts)] if parts else np.zeros(0, np.uint64)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    hashes, starts = [words * _MIX], [np.arange(len(words))]
    for k in range(1, order):
        begin = starts[-1][starts[-1] + k < len(words)]
        begin = begin[text_of[begin] == text_of[begin + k]]
        shorter = hashes[-1][np.searchsorted(starts[-1], begin)]
        mixed = (shorter ^ (shorter >> np.uint64(29))) * _MIX + words[begin + k] + np.uint64(k)
        hashes.append((mixed ^ (mixed >> np.uint64(32))) * _MIX)
        starts.append(begin)
    return hashes, starts, lengths


def _packed_numbers(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, compressed, behind their count and width."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return np.array([len(values), values.itemsize], np.uint32).tobytes() + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked_numbers(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data[:8], np.uint32).tolist()
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"u{width}").ravel()


def _borders(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part begins in sorted hashes; a part is a range of them."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))


def chunked(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(chunk, texts), written: whole documents, ``keep`` and text, packed up to ``CHUNK`` bytes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made = [], 0, 0
        for batch in batches:
            begin, texts = 0, batch.column(len(keep))
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for at in range(batch.num_rows):
                size += sizes[at]
                if size >= CHUNK:
                    yield row([*held, batch.slice(begin, at + 1 - begin)], made)
                    held, size, made, begin = [], 0, made + 1, at + 1
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield row(held, made)

    def row(batches: list[pa.RecordBatch], made: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(table)
        chunk = TaskContext.get().partitionId() << 32 | made
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "texts"])

    texts = docs.select(*keep, F.col("text").cast("string").alias("text to score"))
    return written(texts.mapInArrow(run, "chunk long, texts binary"), "lm-chunks")


def _opened(packed: bytes) -> tuple[pa.Table, list[bytes]]:
    """The columns and the encoded texts of a chunk."""
    table = pa.ipc.open_stream(packed).read_all()
    texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in table.column(table.num_columns - 1)]
    return table.select(table.column_names[:-1]), texts


def chunk_ngrams(chunks: DataFrame, parts: int, order: int) -> DataFrame:
    """(chunk, part, hashes, counts): the different n-grams of every chunk, by part of the count tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                texts = _opened(batch.column(1)[at].as_py())[1]
                keys, counts = np.unique(np.concatenate(hashed_ngrams(texts, order)[0]), return_counts=True)
                del texts
                edges = _borders(keys, parts).tolist()
                spans = [(p, a, b) for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[at].as_py()] * len(spans), pa.int64()), pa.array([p for p, _, _ in spans], pa.int32()),
                    pa.array([_packed_numbers(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in spans], pa.binary()),
                    pa.array([_packed_numbers(counts[a:b].astype(np.uint32)) for _, a, b in spans], pa.binary()),
                ], ["chunk", "part", "hashes", "counts"])

    return chunks.select("chunk", "texts").mapInArrow(run, "chunk long, part int, hashes binary, counts binary")


def joined_counts(ngrams: DataFrame) -> DataFrame:
    """(chunk, part, data): for every n-gram of a chunk, in order of hashes, how often it occurs in the other chunks."""

    def run(rows: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpacked_numbers(h.as_py()), dtype=np.uint64) for h in rows["hashes"]]
        counts = [_unpacked_numbers(c.as_py()).astype(np.int64) for c in rows["counts"]]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(place, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])[:-1]
        others = [_packed_numbers((totals[p] - c).astype(np.uint64)) for p, c in zip(np.split(place, ends), counts)]
        return pa.table([rows["chunk"], rows["part"], pa.array(others, pa.binary())], ["chunk", "part", "data"])

    return ngrams.groupBy("part").applyInArrow(run, "chunk long, part int, data binary")


def text_scores(texts: list[bytes], others: np.ndarray, total: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, sum of logarithms, words scored at the full order) per text.

    ``others`` are the counts outside these texts of their different n-grams in order of hashes, ``total`` is the number of
    words of the corpus.
    """
    hashes, starts, lengths = hashed_ngrams(texts, order)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    _, place, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    outside = []  # per order: the counts of every n-gram in other documents
    for found, begin in zip(np.split(place, np.cumsum([len(h) for h in hashes])[:-1]), starts):
        own_key, own_place, own = np.unique(text_of[begin] * len(counts) + found, return_inverse=True, return_counts=True)
        outside.append(counts[found] + others[found] - own[own_place])
    words = np.maximum(1, total - lengths)[text_of] if len(text_of) else np.zeros(0)
    # shortest first; a longer n-gram that occurs elsewhere takes over, one that does not costs the factor
    logs = np.log(np.where(outside[0] > 0, outside[0], UNSEEN) / words)
    full = outside[0] > 0
    for k in range(1, order):
        end, known = starts[k] + k, outside[k] > 0
        context = outside[k - 1][np.searchsorted(starts[k - 1], starts[k])]
        logs[end] += np.log(BACKOFF)
        logs[end[known]] = np.log(outside[k][known] / context[known])
        full = np.zeros(len(text_of), bool)
        full[end[known]] = True
    sums = np.bincount(text_of, weights=logs, minlength=len(texts)).astype(float)  # without any word NumPy gives integers
    return lengths, sums, np.bincount(text_of, weights=full, minlength=len(texts)).astype(np.int64)


def scored(docs: DataFrame, keep: list[str], order: int = ORDER) -> DataFrame:
    """The ``keep`` columns, ``n_words``, ``n_full`` (words scored at the full order), ``log_sum`` and ``score``."""
    text = F.col("text").cast("string")
    size, total = docs.select(F.sum(F.octet_length(text)), F.sum(F.regexp_count(text, F.lit(WORD)))).first()
    total = total or 0
    chunks = chunked(docs, keep)
    counts = written(joined_counts(chunk_ngrams(chunks, -(-max(size or 0, 1) // PART), order)), "lm-counts")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")  # the texts, then the counts in order of hashes
        table, texts = _opened(rows["data"][0].as_py())
        packs = [_unpacked_numbers(d.as_py()).astype(np.int64) for d in rows["data"][1:]]
        lengths, sums, full = text_scores(texts, np.concatenate([*packs, np.zeros(0, np.int64)]), total, order)
        means = (sums / np.maximum(1, lengths)).round(9)
        return pa.table([*table.columns, *map(pa.array, (lengths, full, sums.round(6), means))], [*keep, "n_words", "n_full", "log_sum", "score"])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n_words long, n_full long, log_sum double, score double"])
    both = chunks.select("chunk", F.lit(-1).alias("part"), F.col("texts").alias("data")).unionByName(counts)
    return both.groupBy("chunk").applyInArrow(run, schema)


def document_ngrams(rows: DataFrame, order: int) -> DataFrame:
    """(row, hash, own): the different n-grams of every document of (row, text), and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0), batch.column(1)):
                keys, own = np.unique(np.concatenate(hashed_ngrams([(text.as_py() or "").encode("utf-8", "surrogatepass")], order)[0]), return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(keys), row.as_py())), pa.array(keys.view(np.int64)), pa.array(own.astype(np.int64)),
                ], ["row", "hash", "own"])

    return rows.select("row", "text").mapInArrow(run, "row long, hash long, own long")


def scored_relationally(docs: DataFrame, keep: list[str], order: int = ORDER) -> DataFrame:
    """As ``scored``, by a count table and joins alone: the n-grams of every document meet the summed counts by hash and are
    summed up per document. A document's n-grams all travel, twice; see the README for what that costs."""
    copy = numbered_copy(docs, "lm-docs", text=F.col("text").cast("string"))
    total = copy.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    grams = written(document_ngrams(copy, order), "lm-ngrams")
    counts = grams.groupBy("hash").agg(F.sum("own").alias("n"))
    outside = grams.join(counts, "hash").select("row", "hash", (F.col("n") - F.col("own")).alias("others"))
    lists = outside.groupBy("row").agg(F.collect_list(F.struct("hash", "others")).alias("known"))
    names = [*keep, "n_words", "n_full", "log_sum", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                text = (batch.column(len(keep))[at].as_py() or "").encode("utf-8", "surrogatepass")
                known = batch.column(len(keep) + 1)[at].as_py() or []
                order_of = np.argsort(np.array([k["hash"] for k in known], np.int64).view(np.uint64), kind="stable")
                others = np.array([k["others"] for k in known], np.int64)[order_of]
                lengths, sums, full = text_scores([text], others, total, order)
                means = (sums / np.maximum(1, lengths)).round(9)
                columns = [pa.array(lengths), pa.array(full), pa.array(sums.round(6)), pa.array(means)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, 1) for i in range(len(keep))), *columns], names)

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n_words long, n_full long, log_sum double, score double"])
    both = by_row(copy, lists, "left").select(*[F.col("doc")[c].alias(c) for c in keep], F.col("text").alias("text to score"), "known")
    return both.mapInArrow(run, schema)
