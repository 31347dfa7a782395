import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm.conftest import ODD, frame, prose
from nearhome.llm import quality_rules, queries

LABELS = "doc_id long, quality int, toxic int, `n_words` string"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {p for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def measured(text):
    data = (text or "").encode()
    words = data.split()
    return quality_rules.measures(data, words, quality_rules.word_ids(words)[0])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ä#", "\n", " ", "\t", "c d", "\x0b", "\x85", "|"]), max_size=120))
def test_measures(parts):
    text = " ".join(parts)
    assert measured(text) == brute(text)


def test_repeats_on_odd_texts():
    for text in ["a " * 30, prose(1, 40) + "\n" + prose(1, 40), "the same eight words stand here twice now " * 2, *[t for _, t, _ in ODD if t and len(t) < 10**5]]:
        assert measured(text) == brute(text)


def test_buckets_do_not_depend_on_the_pieces(monkeypatch):
    ids, vocabulary = quality_rules.word_ids(prose(5, 300).encode().split())
    whole = np.bincount(np.concatenate(list(quality_rules.ngram_buckets(ids, vocabulary))), minlength=quality_rules.BUCKETS)
    monkeypatch.setattr(quality_rules, "CHUNK", 11)
    pieces = np.bincount(np.concatenate(list(quality_rules.ngram_buckets(ids, vocabulary))), minlength=quality_rules.BUCKETS)
    assert (whole == pieces).all() and whole.sum() == 2 * 300 - 1


def test_log_ratios():
    assert not quality_rules.log_ratios(np.ones(4), np.zeros(4)).any()
    ratios = quality_rules.log_ratios(np.array([5.0, 5, 0, 0]), np.array([9.0, 1, 0, 0]))
    assert ratios[0] > 0 > ratios[1]
    assert ratios[0] == pytest.approx(np.log(10 / 14) - np.log(6 / 14))


def brute_verdicts(docs, trusted):
    """(id, score, kept) from the definition, with all n-grams in one piece."""
    found = []
    for i, text in docs:
        pieces = list(quality_rules.ngram_buckets(*quality_rules.word_ids((text or "").encode().split())))
        found.append(np.concatenate([*pieces, np.zeros(0, np.int64)]))
    count = lambda chosen: np.bincount(np.concatenate(chosen), minlength=quality_rules.BUCKETS) + 1.0
    raw, target = count(found), count([f for (i, _), f in zip(docs, found) if i in trusted])
    ratios = np.log(target / target.sum()) - np.log(raw / raw.sum())
    scores = [round(float(ratios[f].sum()) / max(1, len(f)), 9) for f in found]
    good = sorted(s for (i, _), s in zip(docs, scores) if i in trusted)
    middle, tail = (good[int(np.ceil(q * len(good))) - 1] for q in (0.5, quality_rules.TAIL))
    passes = lambda m: m[0] >= 20 and 100 * m[4] <= 30 * m[0]
    return [(i, s, passes(brute(t)) and s >= middle - quality_rules.MARGIN * (middle - tail)) for (i, t), s in zip(docs, scores)]


def corpus(spark):
    good = [(i, " ".join(prose(i % 7, 40).split()[:30] + prose(100 + i, 10).split()), "a") for i in range(200)]
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(500 + i, 40).split()), "a") for i in range(30)]
    labels = [(i, 1, 0, "x") for i in range(0, 200, 2)] + [(1000 + i, 0, 0, "x") for i in range(10)] + [(None, 1, 0, "x"), (1, None, None, "x"), (4, 0, 0, "x")]
    return frame(spark, good + junk + ODD), spark.createDataFrame(labels, LABELS)


def test_query(spark, folder, none):
    docs, labels = corpus(spark)
    found = queries.op4_quality_rules(spark, folder(documents=docs, labels=labels)).collect()
    texts = sorted(brute(r["text"]) for r in docs.collect())
    assert sorted(tuple(r[m] for m in quality_rules.MEASURES) for r in found) == texts
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in found)
    assert not any(r["kept"] for r in found if r["base_failed"])
    expected = brute_verdicts([(r["doc_id"], r["text"]) for r in docs.collect()], set(range(0, 200, 2)) - {4})
    assert sorted((str(r["doc_id"]), r["score"], r["kept"]) for r in found) == sorted((str(i), s, k) for i, s, k in expected)
    assert not all(k for _, _, k in expected)
    empty = queries.op4_quality_rules(spark, folder(documents=none, labels=labels))
    assert empty.count() == 0


def test_all_trusted_documents_count(spark):
    n = 25_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('a', id % 50, ' b c') AS text")
    trusted = quality_rules.trusted_ids(spark.range(0, n, 1).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").union(spark.sql("SELECT 7L, 0, 0")))
    raw, target = quality_rules.counted(docs, trusted)
    assert raw.sum() == 5 * n and target.sum() == 5 * (n - 1)  # three words and two pairs each


def test_without_labels_the_base_rules_decide(spark, folder):
    docs, labels = corpus(spark)
    found = queries.op4_quality_rules(spark, folder(documents=docs, labels=labels.limit(0))).collect()
    assert found and all(r["kept"] == (not r["base_failed"]) for r in found)


def test_stage_keeps_columns(spark):
    docs, labels = corpus(spark)
    kept = quality_rules.good_documents(docs, labels)
    assert kept.columns == docs.columns
    verdicts = quality_rules.judged(docs, labels, ["doc_id"]).filter("kept")
    assert kept.count() == verdicts.count() > 150
