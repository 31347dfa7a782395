"""SimHash near-deduplication with an inverted index over byte positions.

Fingerprint: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are three words joined by a space, repeats
included; fewer words are one shingle, no word (or a null text) gives zero. A bit is 1 when it is set in more than half
of the shingles' XXH64 values (seed 42). Two fingerprints link when at most three bits differ.

Three differing bits touch at most three of the eight bytes, so linked fingerprints share at least five bytes in their
positions. The postings of single bytes would hold a 256th of the corpus each. The index therefore is over quadruples of
positions with their four bytes: the 14 blocks of the Steiner system S(3,4,8), of which one at least lies within any five
shared positions. Within a posting list the shared positional bytes of each pair are tallied, pairs with fewer than five
are dropped and the rest is verified by the bit distance. A list gives out a forest of its links, not the pairs.

A posting list longer than ``LIST`` is divided by one more byte: of the four other bytes at least one is shared as well.
What is then still longer differs in 24 bits only, so it holds at most 2**24 different fingerprints and its links are
looked up by flipping up to three of those bits. No list is cut.

Documents with equal fingerprints are counted together first. Repeated rows and ids are told apart by their row.
Component ids are the smallest doc_id reached; null ids are never the smallest, and null where there is no other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearhome.llm.common import numbered_copy, without
from nearhome.llm.components import connected
from nearhome.session import written

SEED, SHINGLE, BITS, BYTES = 42, 3, 3, 8
LIST = 4096  # members compared pair by pair; longer lists go the other way
CHUNK = 1 << 16  # shingles whose bits are unpacked at once
ROWS = 256  # rows of a block of pairs
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Blocks of four positions such that any three positions outside lie in none of the block: affine planes of GF(2)^3.
QUADS = [q for q in combinations(range(BYTES), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes: splits at \x20, \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(width, len(words)) - 1 :].tolist()
    first = starts[: len(last)].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(last), CHUNK):
        hashes = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(last)).tobytes(), "big")


def fingerprints(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``fp`` (the fingerprint as a signed long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep))
            found = np.fromiter((fingerprint(texts[i].as_py()) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found.view(np.int64))], [*keep, "fp"])

    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "fp long"])
    return df.select(*keep, F.col(text).cast("string").alias("text to print")).mapInArrow(run, schema)


def hexadecimal(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- links ---

def _local_roots(values: np.ndarray) -> np.ndarray:
    """For different fingerprints (uint64): the index of the smallest member that each reaches within the list."""
    roots = np.arange(len(values))
    while True:
        lowest = roots.copy()
        for at in range(0, len(values), ROWS):
            differing = values[at : at + ROWS, None] ^ values[None, :]
            shared = (differing.view(np.uint8).reshape(*differing.shape, BYTES) == 0).sum(axis=2, dtype=np.uint8)
            retained = shared >= BYTES - BITS
            retained[retained] = np.bitwise_count(differing[retained]) <= BITS
            lowest[at : at + ROWS] = np.where(retained, roots[None, :], len(values)).min(axis=1)
        lowest = lowest[lowest]
        if (lowest == roots).all():
            return roots
        roots = lowest


def _dense_roots(values: np.ndarray, free: list[int]) -> np.ndarray:
    """The same for a list that differs only in the bytes ``free``, by looking up what up to three flipped bits give."""
    small = np.zeros(len(values), np.int64)
    for place, byte in enumerate(free):
        small |= ((values >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64) << (8 * place)
    flips = [sum(1 << b for b in bits) for k in range(1, BITS + 1) for bits in combinations(range(8 * len(free)), k)]
    at = np.full(1 << (8 * len(free)), len(values), np.int32)
    at[small] = np.arange(len(values))
    known = np.concatenate([np.arange(len(values)), [len(values)]])  # the last stands for absent members
    while True:
        lowest = known.copy()
        for flip in flips:
            lowest[:-1] = np.minimum(lowest[:-1], known[at[small ^ flip]])
        lowest = lowest[lowest]
        if (lowest == known).all():
            return known[:-1]
        known = lowest


def _forest(values: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hung = np.flatnonzero(roots != np.arange(len(values)))
    return values[hung].view(np.int64), values[roots[hung]].view(np.int64)


def _byte(position: int) -> F.Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255))


def _postings(prints: DataFrame) -> DataFrame:
    """(quad, value, fp): the fingerprint in each of its 14 posting lists."""
    joined = lambda q: sum((F.shiftleft(_byte(p), 8 * i) for i, p in enumerate(q)), F.lit(0).cast("long"))
    lists = F.array(*[F.struct(F.lit(n).alias("quad"), joined(q).alias("value")) for n, q in enumerate(QUADS)])
    return prints.select("fp", F.inline(lists).alias("quad", "value"))


def _links_of_lists(posted: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): forests of the lists of bounded length; only lists with two members at least reach Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, found = batch.column(0), []
            for i in range(len(lists)):
                values = np.sort(lists[i].values.to_numpy().view(np.uint64))
                found.append(_forest(values, _local_roots(values)))
            a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    lists = posted.groupBy(*keys).agg(F.collect_list("fp").alias("fps"))
    return lists.select("fps").mapInArrow(run, "a long, b long")


def _links_of_long_lists(posted: DataFrame) -> DataFrame:
    """(a, b): forests of lists that share five bytes and are longer than ``LIST``; at most 2**24 members each."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        quad, more = int(key[0]), int(key[2])
        values = np.sort(rows["fp"].to_numpy().view(np.uint64))
        free = [p for p in range(BYTES) if p not in QUADS[quad] and p != more]
        a, b = _forest(values, _dense_roots(values, free))
        return pd.DataFrame({"a": a, "b": b})

    return posted.groupBy("quad", "value", "more", "byte").applyInPandas(run, "a long, b long")


def _sized(posted: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``posted`` with the length ``n`` of its list, without lists of one member."""
    counts = posted.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return posted.join(written(counts, f"{name}-lengths"), keys)


def links(prints: DataFrame, limit: int = LIST) -> DataFrame:
    """(a, b): links that connect what the different fingerprints ``fp`` within ``BITS`` bits connect."""
    postings = written(_postings(prints), "simhash-postings")
    keys = ["quad", "value"]
    lengths = written(postings.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"), "simhash-lengths")
    sized = postings.join(lengths, keys)
    found = written(_links_of_lists(sized.filter(F.col("n") <= limit), keys), "simhash-links")
    if lengths.filter(F.col("n") > limit).isEmpty():
        return found
    others = [[p for p in range(BYTES) if p not in q] for q in QUADS]
    more = F.array(*[F.array(*map(F.lit, o)) for o in others])[F.col("quad")]
    fifth = [*keys, "more", "byte"]
    divided = (
        sized.filter(F.col("n") > limit).select("quad", "value", "fp", F.explode(more).alias("more"))
        .withColumn("byte", F.call_function("shiftrightunsigned", "fp", 8 * F.col("more")).bitwiseAND(F.lit(255)))
    )
    divided = written(_sized(written(divided, "simhash-divided"), fifth, "simhash-divided"), "simhash-sized")
    short = _links_of_lists(divided.filter(F.col("n") <= limit), fifth)
    return written(found.unionByName(short).unionByName(_links_of_long_lists(divided.filter(F.col("n") > limit))), "simhash-all-links")


def near_duplicates(rows: DataFrame, limit: int = LIST) -> DataFrame:
    """(row, doc_id, fp, component_id, keep_row) for written ``rows`` (row, doc_id, fp); keep_row is the row that stays."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    prints = written(rows.groupBy("fp").agg(F.min(order).alias("best"), F.count("*").alias("n")), "simhash-prints")
    nodes = connected(links(prints.select("fp"), limit)).select(F.col("node").alias("fp"), "root")
    placed = prints.join(nodes, "fp", "left").filter("n > 1 OR root IS NOT NULL").select(F.coalesce("root", "fp").alias("root"), "fp", "best")
    placed = written(placed, "simhash-placed")
    best = placed.groupBy("root").agg(F.min("best").alias("kept"))
    members = written(placed.join(best, "root").select("fp", "kept"), "simhash-members")
    return rows.join(members, "fp", "left").select(
        "row", "doc_id", "fp", F.when(F.col("kept").isNotNull(), F.col("kept.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("kept.row", "row").alias("keep_row"),
    )


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents less all but the smallest doc_id of each component; all their columns as they came."""
    copy = numbered_copy(docs, "simhash-docs")
    rows = written(fingerprints(copy.select("row", "doc.doc_id", "doc.text"), ["row", "doc_id"]), "simhash-rows")
    decided = near_duplicates(rows)
    return without(copy, written(decided.filter("row != keep_row").select("row"), "simhash-dropped"))
