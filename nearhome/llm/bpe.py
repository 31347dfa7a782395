"""Byte-level BPE by SentencePiece, from a rank file.

The vocabulary becomes a SentencePiece BPE model: every byte is written as one character of a private alphabet, every
token is a piece whose score is its negative rank, and the normaliser is the identity. SentencePiece merges the pair
with the best score first, leftmost among equals, which is the merge order of the ranks. Each match of the pattern
(pre-token) is encoded by itself; one that is a token as a whole is that token. Decoding maps ids back to bytes.

Null texts count as empty and have no ids. Ids unknown to the vocabulary raise an error when decoded. Repeated rows are
encoded alike; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

ALPHABET = 0x100  # byte b is the character U+0100 + b: letters only, none that SentencePiece treats in a special way
CACHED = 300_000  # pre-tokens a worker remembers
SLICE = 8 << 20  # bytes of ids or of decoded text in a batch that goes back to Spark


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank, of a file with one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def byte_string(data: bytes) -> str:
    return "".join(chr(ALPHABET + b) for b in data)


_BYTES = {b: chr(ALPHABET + b) for b in range(256)}


def _mapped(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(_BYTES)


def _varint(value: int) -> bytes:
    value &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes(out + bytes([value]))


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def serialised_model(ranks: dict[bytes, int]) -> bytes:
    """The model as a protocol buffer. Fields 1, 2, 3: pieces, trainer and normaliser settings; ids are ranks.

    The ranks must be 0..n-1. The unknown piece that SentencePiece asks for follows at n; no text reaches it, since
    all 256 bytes are tokens.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the ranks must be 0..n-1 and hold every byte")
    piece = lambda text, score, kind: _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))
    pieces = b"".join(piece(byte_string(t), -float(ranks[t]), 1) for t in tokens) + piece("<unk>", 0.0, 2)
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens)) + b"".join(_number(f, -1) for f in (41, 42, 43))
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return pieces + _block(2, trainer) + _block(3, normaliser)


class Encoder:
    """Ids of texts as little-endian int32 bytes. One per worker; remembers up to ``CACHED`` pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.whole = {token.decode("utf-8"): rank for token, rank in ranks.items() if _is_text(token)}
        self.split = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(ranks))
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        parts = self.split(text)
        new = [p for p in set(parts).difference(self.known)]
        if new:
            if len(self.known) + len(new) > CACHED:
                self.known = {}
                new = list(set(parts))
            rest = [p for p in new if p not in self.whole]
            for p in new:
                if p in self.whole:
                    self.known[p] = struct.pack("<i", self.whole[p])
            for p, ids in zip(rest, self.pieces.encode([_mapped(p) for p in rest], num_threads=1) if rest else ()):
                self.known[p] = np.array(ids, "<i4").tobytes()
        return b"".join(map(self.known.__getitem__, parts))


def _is_text(token: bytes) -> bool:
    try:
        token.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def encode(df: DataFrame, vocabulary: str, pattern: str, keep: list[str], text: str = "text", ids: str = "ids") -> DataFrame:
    """The ``keep`` columns and the ids (array of int) of every whole ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(read_ranks(vocabulary), pattern)
        for batch in batches:
            texts, done, found, size = batch.column(len(keep)), 0, [], 0
            for at in range(len(texts)):
                found.append(encoder.encode(texts[at].as_py() or ""))
                size += len(found[-1])
                if at + 1 == len(texts) or size > SLICE:
                    ends = np.cumsum([0, *(len(x) // 4 for x in found)])
                    flat = pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32())
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                    kept = [batch.column(i).slice(done, len(found)) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*kept, lists], [*keep, ids])
                    done, found, size = at + 1, [], 0

    types = dict(zip(df.columns, (f.dataType.simpleString() for f in df.schema.fields)))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{ids}` array<int>"])
    return df.select(*[f"`{c}`" for c in keep], df[text].cast("string").alias("text to encode")).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, keep: list[str], ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The ``keep`` columns and the bytes (binary) of the ``ids``; null where the ids are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(vocabulary)
        tokens = pa.array(sorted(ranks, key=ranks.__getitem__), pa.binary())
        sizes = np.array([len(t) for t in sorted(ranks, key=ranks.__getitem__)])
        for batch in batches:
            lists = batch.column(len(keep))
            done = 0
            while done < len(lists):
                take = max(1, int(np.searchsorted(_lengths(lists, done), SLICE // 4, "right")))
                part = lists.slice(done, take)
                flat = part.flatten()
                bytes_at = np.concatenate([[0], np.cumsum(sizes[flat.to_numpy(zero_copy_only=False)])])
                ends = np.concatenate([[0], _lengths(part, 0)])
                data = tokens.take(flat).buffers()[2] if len(flat) else pa.py_buffer(b"")
                offsets = pa.py_buffer(bytes_at[ends].astype("<i4").tobytes())
                valid = None if not part.null_count else pa.py_buffer(np.packbits(part.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
                decoded = pa.Array.from_buffers(pa.binary(), len(part), [valid, offsets, data])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(done, take) for i in range(len(keep))), decoded], [*keep, out])
                done += take

    types = dict(zip(df.columns, (f.dataType.simpleString() for f in df.schema.fields)))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{out}` binary"])
    return df.select(*[f"`{c}`" for c in keep], f"`{ids}`").mapInArrow(run, schema)


def _lengths(lists: pa.ListArray, start: int) -> np.ndarray:
    """Running number of list elements from ``start`` on; a null list has none."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists.slice(start)), 0)
    return np.cumsum(sizes.to_numpy(zero_copy_only=False))
