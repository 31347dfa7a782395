"""Ranked lexical search over document FP-trees, by depth-first branch and bound.

The query items are taken in blocks. For a block, every document becomes its vector of term frequencies restricted to the
block's terms. The vectors, ordered by falling document frequency, are laid into a trie per some thousand documents, so
that documents share the path of their commonest terms; paths without a fork are one node, and small neighbouring branches
share a leaf. Every node knows the largest frequency of each term and the smallest length value ``m`` below it. An item's
score grows with the frequencies and falls with ``m``, so these bound all scores below a node: the search of an item goes down
the most promising branch first and leaves out those that cannot reach its ``k``-th best score. A task keeps the best of all
its tries, so its bounds tighten as it goes; the best of the tasks are merged by Spark. Nothing is approximated.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII in the whole text; only A-Z are
lower-cased. A null text has no term and is not counted. ``N``, the total length and the document frequencies cover all
documents. Equal scores rank by doc_id (null last); repeated rows each count and rank, and repeated items are each
answered. Items without a term, terms that no document holds and empty tables give no rows. Columns other than doc_id,
text and item_id, text are not read. A very long text is cut into terms piece by piece.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearhome.session import written

TOP = 50
BLOCK_ITEMS = 1_000  # items searched at once, and
BLOCK_TERMS = 8_192  # how many different terms they may have, unless one item alone has more
TREE_DOCS = 4_096  # documents of a trie, and
TREE_CELLS = 8_000_000  # how many node and term pairs it may have
LEAF = 32  # documents of a leaf
PIECE = 1 << 20  # bytes of a text that are split at once
MERGES = 256  # groups of tasks whose best are ranked before all meet

_SPACE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_VECTOR = "doc_id long, n long, terms array<int>, tfs array<long>"
_FOUND = "item int, doc_id long, score long"


def terms_of(text: str) -> Iterator[list[bytes]]:
    """All terms of a text in UTF-8, in lists of bounded size."""
    data, at = text.encode("utf-8", "surrogatepass").translate(_SPACE), 0
    while at < len(data):
        end = data.rfind(b" ", at, at + PIECE) if len(data) - at > PIECE else len(data)
        if end <= at:
            end = data.find(b" ", at + PIECE)
            end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end + 1


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """(item_id, its different terms) in blocks; no more than a block is on the driver at a time."""
    block, terms = [], set()
    for item_id, text in items.select("item_id", F.col("text").cast("string")).toLocalIterator():
        own = sorted({t for piece in terms_of(text or "") for t in piece})
        if block and (len(block) == BLOCK_ITEMS or len(terms.union(own)) > BLOCK_TERMS):
            yield block
            block, terms = [], set()
        block.append((item_id, own))
        terms.update(own)
    if block:
        yield block


def restricted_vectors(docs: DataFrame, vocabulary: Mapping[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: its length and its frequencies of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(dict(vocabulary))  # the terms of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts, n = Counter(), 0
                for piece in terms_of(text.as_py() or ""):
                    n += len(piece)
                    counts.update(filter(known.__contains__, piece))
                if n:
                    rows.append((doc_id, n, [known[t] for t in counts], list(counts.values())))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))],
                ["doc_id", "n", "terms", "tfs"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _VECTOR)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_value(n_docs: int, total: int) -> Column:
    """100 - 50 + (50 * n * N) div L, in decimals, since the product may pass 64 bits."""
    return F.expr(f"50 + (50BD * CAST(n AS DECIMAL(13, 0)) * CAST({n_docs} AS DECIMAL(15, 0))) div CAST({total} AS DECIMAL(20, 0))")


class Tree:
    """An FP-tree over documents whose ``terms`` are ranks by falling document frequency, ascending within a document.

    ``starts`` are the documents' places in ``terms`` and ``tfs``; every document has a term.
    """

    def __init__(self, terms: np.ndarray, tfs: np.ndarray, starts: np.ndarray, m: np.ndarray, weights: np.ndarray):
        count = len(m)
        node, self.children, parents = self._nodes(terms, np.append(starts, len(terms)), count, len(weights))
        order = np.argsort(node, kind="stable")
        lengths = np.diff(np.append(starts, len(terms)))
        entries = np.repeat(starts[order] - np.cumsum(lengths[order]) + lengths[order], lengths[order]) + np.arange(len(terms))
        self.order, self.terms = order, terms[entries]
        self.starts = np.cumsum(lengths[order]) - lengths[order]
        tfs, doc = tfs[entries], np.repeat(np.arange(count), lengths[order])
        self.parts = weights[self.terms] * (1_000_000_000 * tfs // (1000 * tfs + 20 * m[order][doc]))
        first = np.searchsorted(node[order], np.arange(len(parents) + 1))
        self.first, self.last = first[:-1], first[1:]  # a node's own documents; none unless it is a leaf
        most, least = np.zeros((len(parents), len(weights)), np.int64), np.full(len(parents), np.iinfo(np.int64).max)
        np.maximum.at(most, (node[order][doc], self.terms), tfs)
        np.minimum.at(least, node, m)
        for k in range(len(parents) - 1, 0, -1):
            np.maximum(most[parents[k]], most[k], out=most[parents[k]])
            least[parents[k]] = min(least[parents[k]], least[k])
        self.bounds = weights * (1_000_000_000 * most // (1000 * most + 20 * least[:, None]))

    @staticmethod
    def _nodes(terms: np.ndarray, offsets: np.ndarray, count: int, n_terms: int) -> tuple[np.ndarray, dict[int, tuple[int, int]], list[int]]:
        """The leaf of every document, the range of children of every inner node, and the parent of every node."""
        node, children, parents = np.zeros(count, np.int64), {}, [-1]
        length, active, depth = np.diff(offsets), np.arange(count if count > LEAF else 0), 0
        while len(active):
            place = np.minimum(offsets[active] + depth, len(terms) - 1)
            here = np.where(depth < length[active], terms[place], -1)
            values, branch, counts = np.unique(node[active] * (n_terms + 1) + here + 1, return_inverse=True, return_counts=True)
            parent, ended = values // (n_terms + 1), values % (n_terms + 1) == 0
            first = np.append(True, parent[1:] != parent[:-1])
            group, small = np.cumsum(first) - 1, counts <= LEAF
            before = np.cumsum(counts * small) - counts * small
            bucket = np.where(small, (before - before[first][group]) // LEAF, count + np.arange(len(values)))
            codes, child = np.unique(group * 2 * (count + len(values)) + bucket, return_inverse=True)
            kids = np.bincount(codes // (2 * (count + len(values))))
            forks = kids > 1
            starts = len(parents) + np.cumsum(kids * forks) - kids * forks
            within = child - (np.cumsum(kids) - kids)[group]
            target = np.where(forks[group], starts[group] + within, parent)
            for at, n, p in zip(starts[forks].tolist(), kids[forks].tolist(), parent[first][forks].tolist()):
                children[p] = (at, at + n)
                parents.extend([p] * n)
            node[active] = target[branch]
            active = active[~(small | ended)[branch]]
            depth += 1
        return node, children, parents

    def search(self, item: np.ndarray, wanted: np.ndarray, best: Best, ids: np.ndarray, missing: np.ndarray) -> None:
        """Puts the documents that may be among the best for the terms ``item``, marked in ``wanted``, into ``best``."""
        stack = [(int(self.bounds[0, item].sum()), 0)]
        while stack:
            bound, node = stack.pop()
            if bound < best.least:
                continue
            if node in self.children:
                a, b = self.children[node]
                bounds = self.bounds[a:b].take(item, axis=1).sum(axis=1)
                order = np.argsort(bounds, kind="stable")
                stack.extend((bound, a + k) for bound, k in zip(bounds[order].tolist(), order.tolist()) if bound >= best.least)
            else:
                a, b = self.first[node], self.last[node]
                lo, hi = self.starts[a], self.starts[b] if b < len(self.starts) else len(self.terms)
                scores = np.add.reduceat(self.parts[lo:hi] * wanted[self.terms[lo:hi]], self.starts[a:b] - lo)
                good = np.flatnonzero(scores >= best.least)
                if len(good):
                    docs = self.order[a + good]
                    best.add(scores[good], ids[docs], missing[docs])


class Best:
    """The best ``k`` documents of an item so far; ``least`` is the score another one needs, 1 until there are ``k``."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        missing = np.append(self.missing, missing)
        order = np.lexsort((ids, missing, -scores))[: self.k]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def trees(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, weights: np.ndarray) -> Iterator[tuple[Tree, np.ndarray, np.ndarray]]:
    """(tree, ids, which ids are null) over some thousand documents each; the documents have a term of the block."""
    step = max(LEAF, min(TREE_DOCS, TREE_CELLS * LEAF // (4 * len(weights))))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            doc_id, m, terms, tfs = batch.slice(at, step).columns
            lengths = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            places = ranks[terms.flatten().to_numpy(zero_copy_only=False)]
            order = np.lexsort((places, np.repeat(np.arange(len(lengths)), lengths)))
            missing = doc_id.is_null().to_numpy(zero_copy_only=False)
            ids = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
            frequencies = tfs.flatten().to_numpy(zero_copy_only=False)[order]
            yield Tree(places[order], frequencies, np.cumsum(lengths) - lengths, m.to_numpy(zero_copy_only=False), weights), ids, missing


def best_of_tasks(vectors: DataFrame, items: list[np.ndarray], ranks: np.ndarray, weights: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score): the ``k`` best of every task for every item, which is its terms' ranks."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, ranks, weights))  # one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, places, worth = shared.value
        found, wanted = [Best(k) for _ in queries], np.zeros(len(worth), np.int64)
        for tree, ids, missing in trees(batches, places, worth):
            for best, item in zip(found, queries):
                wanted[item] = 1
                tree.search(item, wanted, best, ids, missing)
                wanted[item] = 0
        for number, best in enumerate(found):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(best.ids), number, np.int32)), pa.array(best.ids, mask=best.missing), pa.array(best.scores),
            ], ["item", "doc_id", "score"])

    return vectors.select("doc_id", "m", "terms", "tfs").mapInArrow(run, _FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` documents of every item with their rank; first those of groups of tasks, then of all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    some = found.withColumn("group", F.spark_partition_id() % MERGES).withColumn("rank", rank("item", "group")).filter(F.col("rank") <= k)
    return some.withColumn("rank", rank("item")).filter(F.col("rank") <= k).drop("group")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item with a score above 0."""
    spark, results = docs.sparkSession, []
    item_type = dict(items.dtypes)["item_id"]
    for number, block in enumerate(item_blocks(items)):
        terms = sorted({t for _, own in block for t in own})
        if not terms:
            continue
        vocabulary = {t: i for i, t in enumerate(terms)}
        vectors = written(restricted_vectors(docs, vocabulary), f"search-vectors-{number}")
        n_docs, total = vectors.agg(F.count("*"), F.sum("n")).first()
        held = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row a term of the block
        if not held:
            continue
        order = sorted(held, key=lambda t: (-held[t], t))
        ranks = np.full(len(terms), -1, np.int64)
        ranks[order] = np.arange(len(order))
        weights = np.array([weight(n_docs, held[t]) for t in order], np.int64)
        queries = [np.array([ranks[vocabulary[t]] for t in own if vocabulary[t] in held], np.int64) for _, own in block]
        usable = vectors.filter(F.size("terms") > 0).withColumn("m", length_value(n_docs, total).cast("long"))
        found = written(best_of_tasks(usable, queries, ranks, weights, k), f"search-found-{number}")
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, item_id {item_type}")
        results.append(ranked(found, k).join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    empty = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results) if results else empty
