import hashlib

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.conftest import ODD
from nearhome.llm import bpe, queries

RANKS = bpe.read_ranks(queries.VOCABULARY)
KNOWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def ids_of(text):
    import numpy as np

    return np.frombuffer(ENCODER.encode(text), "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_ids_are_those_of_the_rank_merges(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids_of(text) == KNOWN.encode_ordinary(text)


def test_model_is_what_sentencepiece_reads():
    model = sentencepiece.SentencePieceProcessor(model_proto=bpe.serialised_model(RANKS))
    assert model.vocab_size() == len(RANKS) + 1 and model.unk_id() == len(RANKS)
    assert all(model.piece_to_id(bpe.byte_string(t)) == r and model.get_score(r) == -r for t, r in list(RANKS.items())[::997])


def test_ranks_with_a_gap_are_refused():
    with pytest.raises(ValueError):
        bpe.serialised_model({b"a": 0, b"b": 2})


def test_cache_may_be_dropped(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    small = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for text in ("a b c d e f g", "h i a b", "zz yy xx a"):
        assert small.encode(text) == ENCODER.encode(text)


def test_query_on_odd_documents(spark, odd, none, folder):
    found = queries.op1_byte_bpe(spark, folder(documents=odd)).collect()
    sha = lambda data: hashlib.sha256(data).hexdigest()
    expected = []
    for i, text, _ in ODD:
        ids = KNOWN.encode_ordinary(text or "")
        expected.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert queries.op1_byte_bpe(spark, folder(documents=none)).count() == 0


def test_round_trip_keeps_columns(spark, odd):
    encoded = bpe.encode(odd, queries.VOCABULARY, public_tokenizers.PATTERN, ["doc_id", "row"], ids="tokens")
    decoded = bpe.decode(encoded, queries.VOCABULARY, ["doc_id", "row"], ids="tokens", out="bytes")
    texts = sorted(bytes(r["bytes"]).decode() for r in decoded.collect())
    assert texts == sorted(t or "" for _, t, _ in ODD)
    assert decoded.columns == ["doc_id", "row", "bytes"]


def test_null_ids_decode_to_null(spark):
    df = spark.createDataFrame([(1, [72, 0]), (2, None), (3, [])], "k int, ids array<int>")
    found = {r["k"]: r["decoded"] for r in bpe.decode(df, queries.VOCABULARY, ["k"]).collect()}
    tokens = {r: t for t, r in RANKS.items()}
    assert found == {1: tokens[72] + tokens[0], 2: None, 3: b""}
