"""Collocations: phrases whose words occur together more often than apart, mined level by level with double-array tries.

Words are counted per language, and the frequent ones numbered. A byte trie of them turns every text into an array of word
numbers, in which 0 stands for an infrequent word and for the end of a piece. A phrase of ``k + 1`` words is a pair of
neighbouring phrases of ``k`` words, so every level is the same: (1) a pair can be frequent only if both its members are, so the
places whose neighbours are both frequent are gathered, and a pair is a candidate once enough of its places are seen; a task
tells of no more than that many, and no frequent phrase is left out. (2) Tries over the candidates are broadcast, ``PART_KEYS``
pairs each and ``PARTS`` at a time, and in every task the states of all text positions whose pair belongs to a trie go down byte
by byte, at once; the accepting states are binned and the tasks' sums added up, which gives the counts. (3) The frequent pairs are
numbered and the arrays rewritten for the next level.

Texts are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into words; only A-Z are lower-cased. A null
text is empty, a null language ``und``. Everything is counted per language. A phrase's score is floor(1000000 * a * a / (l * r))
for the cut into a front that occurs ``l`` times and a rest that occurs ``r`` times; the lowest counts, of equal ones the
first, and l and r are of that cut. A candidate is dropped when a longer candidate around it is at least half as frequent.
Equal scores rank by frequency, then by the phrase's bytes. Repeated rows count as often as they stand there. Empty tables give no
rows; columns other than text and lang are not read. Words longer than ``LONG_WORD`` bytes go through the trie by their SHA-256.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearhome.llm import double_array
from nearhome.llm.common import text_or_empty, written_densely
from nearhome.llm.double_array import DoubleArray
from nearhome.operators.numbering import numbered
from nearhome.session import written

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2_000
SHARE = 50  # per cent of a phrase's occurrences that a longer one must have to replace it
PART_KEYS = 250_000  # pairs of a trie, which is what a broadcast holds,
WORD_KEYS = 500_000  # words of one,
PARTS = 4  # and tries that a task has in hand during a pass over the arrays
LONG_WORD = 64
SEGMENT = 1 << 20  # bytes of text that a task has in hand
ROW = 256  # numbers, or as many more as reach the end of a piece, that travel together; Spark bounds a batch by its rows only
CHUNK = 1 << 18  # places that a task has in hand
SLICE = 64  # bins that travel together; where a task has found none of them, they do not
HELD = 1 << 21  # pairs a task gathers before it hands them on,
HELD_WORDS = 1 << 19  # words,
HANDED = 1 << 16  # and pairs it hands on at once

_BREAK, _BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"
_FOLD = bytes(10 if b in _BREAK else 32 if b in _BLANK else b + 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.array([2 if b == 10 else 1 if b == 32 else 0 for b in range(256)], np.int8)
_CUT = re.compile(rb"[.,;:!?\n-\r]")
_TRIE = "part int, base binary, check binary, value binary, keys binary"


# --- texts ---

def segments(text: str) -> Iterator[bytes]:
    """The text in UTF-8, cut between pieces into stretches of about ``SEGMENT`` bytes."""
    data, at = text.encode("utf-8", "surrogatepass"), 0
    while at < len(data):
        cut = _CUT.search(data, at + SEGMENT) if len(data) - at > SEGMENT else None
        end = cut.end() if cut else len(data)
        yield data[at:end]
        at = end


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over the whole texts; counted in the task before the shuffle."""

    def handed(counts: dict[str, Counter]) -> pa.RecordBatch:
        words = pa.array([w for c in counts.values() for w in c], pa.binary()).cast(pa.string())
        langs = pa.array([lang for lang, c in counts.items() for _ in c], pa.string())
        return pa.RecordBatch.from_arrays([langs, words, pa.array([n for c in counts.values() for n in c.values()], pa.int64())], ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = defaultdict(Counter), 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = counts[lang]
                for data in segments(text.as_py()):
                    size -= len(own)
                    own.update(data.translate(_FOLD).split())
                    size += len(own)
                if size > HELD_WORDS:
                    yield handed(counts)
                    counts, size = defaultdict(Counter), 0
        if size:
            yield handed(counts)

    counted = docs.mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, length, place) of the words of folded text; places are consecutive, with one left out between pieces."""
    codes = np.frombuffer(data, np.uint8)
    kind = _KIND[codes]
    edges = np.diff(np.concatenate([[0], kind == 0, [0]]).astype(np.int8))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[start]
    apart = np.append(False, piece[1:] != piece[:-1])[: len(start)]
    return codes, start, end - start, np.arange(len(start)) + np.cumsum(apart)


def word_key(word: bytes) -> bytes:
    """What stands for a word in a trie; the first byte of a digest occurs in no UTF-8."""
    return word if len(word) <= LONG_WORD else b"\xfe" + hashlib.sha256(word).digest()


def lang_key(lang: str) -> bytes:
    return lang.encode("utf-8", "surrogatepass") + b"\xff"


def words_to_numbers(trie: DoubleArray, roots: list[int], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, offsets): per place of the texts the value of its word in ``trie`` below the text's root, or 0.

    ``offsets`` tell where each text begins. Between pieces and behind every text there is a 0.
    """
    codes, start, length, place = word_places(b"\n".join(texts).translate(_FOLD))
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int32)
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    text = np.searchsorted(begins, start, "right") - 1
    numbers = np.zeros(int(place[-1]) + 2, np.int32)
    offsets = np.append(place, len(numbers))[np.searchsorted(text, np.arange(len(texts) + 1))].astype(np.int32)
    root = np.array(roots, np.int64)[text]
    at, depth = np.flatnonzero((length <= LONG_WORD) & (root >= 0)), 0
    states = root[at]
    while len(at):
        done = length[at] == depth
        numbers[place[at[done]]] = np.maximum(trie.value[states[done]], 0)
        at, states = at[~done], states[~done]
        known, states = trie.step(states, codes[start[at] + depth])
        at, depth = at[known], depth + 1
    for k in np.flatnonzero((length > LONG_WORD) & (root >= 0)):
        state = trie.state_of(word_key(codes[start[k] : start[k] + length[k]].tobytes()), int(root[k]))
        numbers[place[k]] = max(0, int(trie.value[state])) if state >= 0 else 0
    return numbers, offsets


# --- tries ---

def parts_of(count: int, size: int) -> int:
    return max(1, -(-count // size))


def pair_part(left, right, parts: int):
    """The trie a pair belongs to; of columns or of arrays. Pairs with a common member are spread."""
    return (left * 31 + right) % parts


def with_pair_part(pairs: DataFrame, count: int) -> DataFrame:
    left, right = F.shiftright("pair", 32), F.col("pair").bitwiseAND(F.lit(2**32 - 1))
    return pairs.withColumn("part", pair_part(left, right, parts_of(count, PART_KEYS)).cast("int"))


def _trie_row(part: int, trie: DoubleArray, keys: np.ndarray) -> pd.DataFrame:
    arrays = [trie.base, trie.check, trie.value, keys]
    return pd.DataFrame([[part, *(a.tobytes() for a in arrays)]], columns=["part", "base", "check", "value", "keys"])


def word_tries(words: DataFrame) -> DataFrame:
    """One trie a part of (part, lang, word, id): language and word to its number."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys = [lang_key(lang) + word_key(word.encode("utf-8", "surrogatepass")) for lang, word in zip(rows["lang"], rows["word"])]
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        trie = double_array.build(np.frombuffer(b"".join(keys), np.uint8), lengths, rows["id"].to_numpy(np.int32))
        return _trie_row(key[0], trie, np.zeros(0, np.int64))

    return words.groupBy("part").applyInPandas(build, _TRIE)


def pair_bytes(left: np.ndarray, right: np.ndarray) -> Iterator[np.ndarray]:
    """The eight bytes of pairs of numbers, one after another for all pairs; the commoner a number the smaller it is."""
    for side in (left, right):
        for shift in (24, 16, 8, 0):
            yield (side >> shift) & 255


def pair_tries(pairs: DataFrame) -> DataFrame:
    """One trie a part of (part, pair, id): the pair's bytes to its number, or to its place in ``keys`` where ids are null."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pair = rows["pair"].to_numpy(np.int64)
        data = np.stack(list(pair_bytes(pair >> 32, pair & 0xFFFFFFFF)), axis=1).astype(np.uint8)
        values = np.arange(len(pair), dtype=np.int32) if rows["id"].isna().any() else rows["id"].to_numpy(np.int32)
        return _trie_row(key[0], double_array.build(data.ravel(), np.full(len(pair), 8), values), pair)

    return pairs.groupBy("part").applyInPandas(build, _TRIE)


def loaded(tries: DataFrame, at_once: int) -> Iterator[list[tuple]]:
    """(part, broadcast) of the tries, some at a time; a broadcast is (trie, keys) of a bounded number of keys."""
    context = tries.sparkSession.sparkContext
    parts = sorted(r["part"] for r in tries.select("part").collect())
    for start in range(0, len(parts), at_once):
        held = []
        for part in parts[start : start + at_once]:  # the driver has one in hand
            columns = tries.filter(F.col("part") == part).toArrow().to_pydict()
            trie = DoubleArray(*(np.frombuffer(columns[c][0], np.int32) for c in ("base", "check", "value")))
            held.append((part, context.broadcast((trie, np.frombuffer(columns["keys"][0], np.int64)))))
            del columns, trie
        yield held
        for _, shared in held:
            shared.destroy()


# --- arrays of numbers, some pieces of a text a row ---

def encoded(docs: DataFrame, tries: DataFrame) -> DataFrame:
    """(ids): the arrays of word numbers, as bytes. Each part's trie passes over the texts, which go along until the last one."""
    rows, count = docs, tries.count()
    for number, [(_, shared)] in enumerate(loaded(tries, 1)):
        first, last = number == 0, number == count - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=last) -> Iterator[pa.RecordBatch]:
            trie, _ = shared.value
            for batch in batches:
                roots = {lang: trie.state_of(lang_key(lang)) for lang in batch.column(0).unique().to_pylist()}
                for langs, texts, before in _stretches(batch, first):
                    ids, offsets = words_to_numbers(trie, [roots[lang] for lang in langs], texts)
                    ids = ids if first else np.maximum(ids, before)
                    if last:
                        yield pa.RecordBatch.from_arrays([in_rows(ids, row_ends(ids))], ["ids"])
                    else:
                        whole = pa.array(texts, pa.binary()).cast(pa.string())
                        own = [ids[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
                        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), whole, pa.array(own, pa.binary())], ["lang", "text", "ids"])

        rows = written_densely(rows.mapInArrow(run, "ids binary" if last else "lang string, text string, ids binary"), "phrase-words")
    return rows


def _stretches(batch: pa.RecordBatch, first: bool) -> Iterator[tuple[list[str], list[bytes], np.ndarray | None]]:
    """(languages, texts, their numbers so far) in stretches of about ``SEGMENT`` bytes."""
    langs, texts, size, begin = [], [], 0, 0
    numbers = lambda end: None if first else numbers_of(batch.slice(begin, end - begin), 2)[0]
    for at, (lang, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
        for data in segments(text.as_py()) if first else [text.as_py().encode("utf-8", "surrogatepass")]:
            langs.append(lang)
            texts.append(data)
            size += len(data)
            if size > SEGMENT:
                yield langs, texts, numbers(at + 1)
                langs, texts, size, begin = [], [], 0, at + 1
    if texts:
        yield langs, texts, numbers(batch.num_rows)


def row_ends(ids: np.ndarray) -> np.ndarray:
    """Where the rows end that the numbers are cut into: each behind a 0, so no pair reaches from one row into the next."""
    zeros = np.flatnonzero(ids == 0)
    ends = np.searchsorted(zeros, np.arange(ROW - 1, len(ids), ROW))
    return np.unique(np.append(zeros[ends[ends < len(zeros)]] + 1, len(ids))) if len(ids) else np.zeros(0, np.int64)


def in_rows(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The numbers as bytes, a row up to each of ``ends``."""
    offsets = np.append(0, 4 * ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(np.int32, copy=False))])


def numbers_of(batch: pa.RecordBatch, column: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, ends) of all rows of a batch. A row ends with 0, so a pair never reaches from one into the next."""
    values = batch.column(column).cast(pa.large_binary())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64, len(values) + 1, 8 * values.offset) if len(values) else np.zeros(1, np.int64)
    count = int(at[-1] - at[0]) // 4
    return np.frombuffer(data, np.int32, count, int(at[0])) if count else np.zeros(0, np.int32), (at[1:] - at[0]) // 4


def neighbours(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, left, right) of all places whose number and whose next one are not 0, which is what Apriori leaves; ``CHUNK`` places at a time."""
    for start in range(0, len(ids) - 1, CHUNK):
        some = ids[start : start + CHUNK + 1]
        at = np.flatnonzero((some[:-1] > 0) & (some[1:] > 0))
        yield start + at, some[at].astype(np.int64), some[at + 1].astype(np.int64)


def pair_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left << 32 | right


def gathered(held: np.ndarray, counts: np.ndarray, pairs: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted pairs ``held`` and their counts up to ``most`` with ``pairs`` added."""
    pairs, n = np.unique(pairs, return_counts=True)
    at = np.searchsorted(held, pairs)
    known = np.zeros(len(pairs), bool)
    known[at < len(held)] = held[at[at < len(held)]] == pairs[at < len(held)]
    counts[at[known]] = np.minimum(counts[at[known]] + n[known], most)
    return np.insert(held, at[~known], pairs[~known]), np.insert(counts, at[~known], np.minimum(n[~known], most))


def candidates(rows: DataFrame, min_count: int) -> DataFrame:
    """(pair): the pairs with ``min_count`` places or more. A task counts to ``min_count`` at most before it tells of a pair."""

    def handed(held: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(held), HANDED):
            some = slice(at, at + HANDED)
            yield pa.RecordBatch.from_arrays([pa.array(held[some]), pa.array(counts[some])], ["pair", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int32)
        for batch in batches:
            for _, left, right in neighbours(numbers_of(batch)[0]):
                held, counts = gathered(held, counts, pair_of(left, right), min_count)
                if len(held) > HELD:
                    yield from handed(held, counts)
                    held, counts = held[:0], counts[:0]
        yield from handed(held, counts)

    seen = rows.mapInArrow(run, "pair long, seen int").groupBy("pair").agg(F.sum("seen").alias("seen"))
    return seen.filter(F.col("seen") >= min_count).select("pair")


def descend(trie: DoubleArray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which pairs end in an accepting state, its value): all states go down one level at a time."""
    at, states = np.arange(len(left)), np.zeros(len(left), np.int64)
    for symbols in pair_bytes(left, right):
        known, states = trie.step(states, symbols[at])
        at = at[known]
    return at, trie.value[states]


def counted(rows: DataFrame, tries: DataFrame, parts: int) -> list[DataFrame]:
    """(pair, n) of the candidates of every pass, written: a task bins its accepting states, Spark adds up."""
    found = []
    for held in loaded(tries, PARTS):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            bins = [np.zeros(len(shared.value[1]), np.int64) for _, shared in held]
            for batch in batches:
                for _, left, right in neighbours(numbers_of(batch)[0]):
                    of = pair_part(left, right, parts)
                    for bin_, (part, shared) in zip(bins, held):
                        own = np.flatnonzero(of == part)
                        bin_ += np.bincount(descend(shared.value[0], left[own], right[own])[1], minlength=len(bin_))
            for bin_, (part, _) in zip(bins, held):
                slices = np.append(bin_, np.zeros(-len(bin_) % SLICE, np.int64)).reshape(-1, SLICE)
                some = np.flatnonzero(slices.any(axis=1))
                ends = pa.array(np.arange(len(some) + 1) * SLICE, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(some), part, np.int32)), pa.array(some, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(slices[some].ravel())),
                ], ["part", "slice", "bins"])

        def named(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, at = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                bins = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, SLICE)
                for part, shared in held:
                    row, place = np.nonzero(bins[of == part])
                    pairs = shared.value[1][at[of == part][row] * SLICE + place]
                    yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(bins[of == part][row, place])], ["pair", "n"])

        slices = rows.mapInArrow(run, "part int, slice int, bins array<long>").groupBy("part", "slice")
        sums = slices.agg(*[F.sum(F.get("bins", F.lit(k))).alias(f"b{k}") for k in range(SLICE)])
        sums = sums.select("part", "slice", F.array(*[f"b{k}" for k in range(SLICE)]).alias("bins")).mapInArrow(named, "pair long, n long")
        found.append(written(sums, "phrase-counts"))
    return found


def rewritten(rows: DataFrame, tries: DataFrame, parts: int) -> DataFrame:
    """(ids): the arrays of the next level, at every place the number of the frequent pair that begins there."""
    count = -(-tries.count() // PARTS)
    for number, held in enumerate(loaded(tries, PARTS)):
        first, last = number == 0, number == count - 1

        def run(batches: Iterator[pa.RecordBatch], held=held, first=first, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, ends = numbers_of(batch)
                more = np.zeros(len(ids), np.int32) if first else numbers_of(batch, 1)[0].copy()
                for place, left, right in neighbours(ids):
                    of = pair_part(left, right, parts)
                    for part, shared in held:
                        own = np.flatnonzero(of == part)
                        some, value = descend(shared.value[0], left[own], right[own])
                        more[place[own[some]]] = value
                columns = [in_rows(more, ends)] if last else [batch.column(0), in_rows(more, ends)]
                yield pa.RecordBatch.from_arrays(columns, ["ids"] if last else ["ids", "more"])

        rows = written_densely(rows.mapInArrow(run, "ids binary" if last else "ids binary, more binary"), "phrase-level")
    return rows


# --- phrases ---

def with_numbers(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``id`` 1, 2, ... by falling ``n``, so that the commonest have the smallest."""
    others = [F.col(c) for c in rows.columns if c not in ("n", "fronts", "backs")]
    return written(numbered(rows, [F.col("n").desc(), *others], "id", name).withColumn("id", (F.col("id") + 1).cast("int")), name)


def next_level(rows: DataFrame, below: DataFrame, min_count: int) -> DataFrame:
    """The frequent phrases one word longer than those of ``below``, whose numbers ``rows`` holds.

    (id, left, right, lang, phrase, last, n, fronts, backs): ``left`` and ``right`` are the numbers of the phrase without its last
    and its first word; ``fronts`` and ``backs`` are how often its first 1, 2, ... and its last 1, 2, ... words occur.
    """
    found = written(candidates(rows, min_count), "phrase-candidates")
    count = found.count()
    tries = written(pair_tries(with_pair_part(found, count).withColumn("id", F.lit(None).cast("int"))), "phrase-tries")
    frequent = None
    for sums in counted(rows, tries, parts_of(count, PART_KEYS)):
        frequent = sums if frequent is None else frequent.unionByName(sums)
    if frequent is None:
        frequent = found.withColumn("n", F.lit(0).cast("long"))
    pairs = frequent.filter(F.col("n") >= min_count).select(
        F.shiftright("pair", 32).cast("int").alias("left"), F.col("pair").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("right"), "n",
    )
    front = below.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("begin"), F.array_append("fronts", F.col("n")).alias("fronts"))
    back = below.select(F.col("id").alias("right"), "last", F.array_append("backs", F.col("n")).alias("backs"))
    joined = pairs.join(front, "left").join(back, "right")
    phrases = joined.select("left", "right", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "n", "fronts", "backs")
    return with_numbers(phrases, "phrase-frequent")


def lowest_cut() -> Column:
    """(score, l, r) of the cut with the lowest score; products are decimals, which are exact up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    cuts = F.transform(F.sequence(F.lit(1), F.size("fronts")), lambda k: F.struct(
        F.get("fronts", k - 1).alias("l"), F.get("backs", F.size("fronts") - k).alias("r"), k.alias("k"),
    ))
    square = (wide(F.col("n")) * wide(F.col("n"))).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    scored = F.transform(cuts, lambda c: F.struct(
        F.call_function("div", square.cast("decimal(38,0)"), (wide(c["l"]) * wide(c["r"])).cast("decimal(38,0)")).alias("score"),
        c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"),
    ))
    return F.array_min(scored)


def replaced(below: DataFrame, above: DataFrame, share: int) -> DataFrame:
    """``below`` without the phrases that a phrase one word longer replaces.

    What a still longer one would replace, the one between replaces too, since it is at least as frequent.
    """
    inside = above.select(F.explode(F.array("left", "right")).alias("id"), "n").groupBy("id").agg(F.max("n").alias("longer"))
    longer = written(inside, "phrase-longer")
    return below.join(longer, "id", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("n"))).drop("longer")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, share: int = SHARE, top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of two to ``max_words`` words of every language."""
    slim = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text")).filter("text != ''")
    counts = written(word_counts(slim), "phrase-word-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    words = with_numbers(counts.filter(F.col("n") >= min_count), "phrase-numbers")
    part = F.pmod(F.xxhash64("lang", "word"), F.lit(parts_of(words.count(), WORD_KEYS))).cast("int")
    tries = written(word_tries(words.withColumn("part", part)), "phrase-word-tries")
    none = F.array().cast("array<long>")
    below = words.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "n", none.alias("fronts"), none.alias("backs"))
    kept, above = [], None
    if not words.isEmpty():
        rows = encoded(slim, tries)
        for size in range(2, max_words + 1):
            above = next_level(rows, below, min_count)
            if size > 2:
                kept.append(replaced(below, above, share))
            below = above
            if above.isEmpty():
                break
            if size < max_words:
                pairs = above.select((F.shiftleft(F.col("left").cast("long"), 32) + F.col("right")).alias("pair"), "id")
                count = above.count()
                rows = rewritten(rows, written(pair_tries(with_pair_part(pairs, count)), "phrase-tries"), parts_of(count, PART_KEYS))
        kept.append(below)
    else:
        kept.append(below.filter(F.lit(False)))
    return best_phrases([k.select("lang", "phrase", "n", "fronts", "backs") for k in kept], totals, top)


def best_phrases(levels: list[DataFrame], totals: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of every language; those of groups first, so that no language is one task's work.

    There are as many groups as make a group and the best of all groups about equally large.
    """
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    cut = lowest_cut()
    scored = written(phrases.select("lang", "phrase", F.col("n").alias("a"), cut.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "phrase-scores")
    groups = max(1, ceil(sqrt(scored.count() / top)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    some = scored.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(groups))).withColumn("rank", rank("lang", "group")).filter(F.col("rank") <= top)
    best = some.withColumn("rank", rank("lang")).filter(F.col("rank") <= top)
    return best.join(totals.withColumnRenamed("total", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
