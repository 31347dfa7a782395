import math
from collections import Counter

import pytest

from llm.conftest import ODD, frame, prose
from nearhome.llm import ngram_lm, queries


def brute(texts, order):
    """(words, words scored at the full order, mean logarithm) per text, straight from the definition."""
    split = [(t or "").encode().split() for t in texts]
    grams = lambda w: Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    every = Counter()
    for w in split:
        every.update(grams(w))
    total = sum(map(len, split))
    out = []
    for w in split:
        own, logs, full = grams(w), 0.0, 0
        count = lambda g: every[g] - own[g]
        for i in range(len(w)):
            longest = min(order - 1, i)
            for k in range(longest, -1, -1):
                gram = tuple(w[i - k : i + 1])
                if count(gram) or k == 0:
                    below = count(gram[:-1]) if k else max(1, total - len(w))
                    logs += math.log(0.4 ** (longest - k) * (count(gram) or 0.5) / below)
                    full += k == order - 1 and count(gram) > 0
                    break
        out.append((len(w), full, round(logs / max(1, len(w)), 9)))
    return out


def corpus():
    common = prose(1, 300).split()
    return [" ".join(common[i % 40 : i % 40 + 30] + prose(i % 50, 10).split()) for i in range(120)] + [None, "", "x", "x y", "x y"]


@pytest.mark.parametrize("order, chunk, part", [(1, 1 << 24, 1 << 24), (2, 1 << 24, 1 << 24), (2, 700, 900), (3, 1000, 3000), (4, 10**6, 2000)])
def test_scores_are_those_of_the_definition(spark, monkeypatch, order, chunk, part):
    monkeypatch.setattr(ngram_lm, "CHUNK", chunk)
    monkeypatch.setattr(ngram_lm, "PART", part)
    texts = corpus()
    df = frame(spark, [(i, t, "a") for i, t in enumerate(texts)]).repartition(3)
    found = {r["doc_id"]: (r["n_words"], r["n_full"], r["score"]) for r in ngram_lm.scored(df, ["doc_id"], order).collect()}
    for i, (n, full, score) in enumerate(brute(texts, order)):
        assert found[i][:2] == (n, full)
        assert found[i][2] == pytest.approx(score, abs=1e-6)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_the_relational_form_gives_the_same(spark, order):
    texts = corpus()
    df = frame(spark, [(i, t, "a") for i, t in enumerate(texts)]).repartition(3)
    found = {r["doc_id"]: (r["n_words"], r["n_full"], r["score"]) for r in ngram_lm.scored_relationally(df, ["doc_id"], order).collect()}
    for i, (n, full, score) in enumerate(brute(texts, order)):
        assert found[i] == (n, full, pytest.approx(score, abs=1e-6))


def test_query_on_odd_documents(spark, odd, none, folder):
    found = sorted((str(r["doc_id"]), r["n_words"], r["n_full"]) for r in queries.op8_stupid_backoff(spark, folder(documents=odd)).collect())
    assert found == sorted((str(i), n, full) for (i, _, _), (n, full, _) in zip(ODD, brute([t for _, t, _ in ODD], 2)))
    assert queries.op8_stupid_backoff(spark, folder(documents=none)).count() == 0
