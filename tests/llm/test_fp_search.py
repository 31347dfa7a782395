import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm.conftest import EXTRA, ODD, frame, prose
from llm.test_sql import compare
from nearhome.llm import fp_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, items, k=50):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    docs = [(i, Counter(terms(t))) for i, t, _ in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    found = []
    for item_id, text in items:
        own, scores = set(terms(text)), []
        for i, c, n in docs:
            m = 100 - 50 + (50 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        found += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return sorted(found, key=str)


def benchmark(spark, items):
    return spark.createDataFrame([(*item, *EXTRA) for item in items], "item_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA))


def check(spark, folder, rows, items):
    found = queries.op11_fp_search(spark, folder(documents=frame(spark, rows), benchmark=benchmark(spark, items)))
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, items)


ITEMS = [
    (1, prose(1, 20)), (2, prose(3, 200)), (2, prose(3, 200)), (3, None), (4, ""), (5, "no such terms ZZZ9"), (None, "ONE two GRÜSSE grüße İstanbul"),
    (6, "one; one. x" + "x" * 299_999), (7, "secret abcdefgh \U0001f600 naïve"), (8, " ".join(prose(s, 60) for s in range(1, 5))),
]


def test_query_on_odd_documents(spark, folder):
    check(spark, folder, ODD, ITEMS)


def test_odd_documents_by_sql(spark, odd, folder):
    compare(spark, "op11_fp_search", folder(documents=odd, benchmark=benchmark(spark, ITEMS)))


def test_empty_tables(spark, odd, none, folder):
    for docs, items in ((none, ITEMS), (odd, []), (none, []), (odd, [(1, None)])):
        assert queries.op11_fp_search(spark, folder(documents=docs, benchmark=benchmark(spark, items))).count() == 0


def skewed(n):
    """Documents over few words of falling frequency: long shared paths, a third equal copies, many ties."""
    pick = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(i, "w0 w1 w2 w3 w4 w4" if i % 3 == 0 else " ".join(pick.choices(words, weights, k=pick.randint(1, 40))), "a") for i in range(n)]


SKEWED_ITEMS = [(i, " ".join(f"w{(i * 7 + j * j) % 60}" for j in range(i % 12 + 1))) for i in range(30)] + [(99, "w0 w1 w4")]


@pytest.mark.parametrize("leaf, tree, block", [(32, 4096, 1000), (2, 100, 7), (1, 37, 1)])
def test_a_third_of_the_rows_in_one_group(spark, folder, monkeypatch, leaf, tree, block):
    monkeypatch.setattr(fp_search, "BLOCK_ITEMS", block)
    monkeypatch.setattr(fp_search, "LEAF", leaf)
    monkeypatch.setattr(fp_search, "TREE_DOCS", tree)
    check(spark, folder, skewed(900), SKEWED_ITEMS if block > 1 else SKEWED_ITEMS[:3])


def test_blocks_by_terms(spark, folder, monkeypatch):
    monkeypatch.setattr(fp_search, "BLOCK_TERMS", 5)
    blocks = list(fp_search.item_blocks(benchmark(spark, SKEWED_ITEMS[:10])))
    assert sum(map(len, blocks)) == 10 and len(blocks) > 2
    check(spark, folder, skewed(200), SKEWED_ITEMS[:4])


def tree_of(rows):
    docs = [Counter(terms(t)) for _, t, _ in rows]
    df = Counter(t for c in docs for t in c)
    ranks = {t: r for r, t in enumerate(sorted(df, key=lambda t: (-df[t], t)))}
    vectors = [sorted((ranks[t], n) for t, n in c.items()) for c in docs]
    flat, starts = [p for v in vectors for p in v], np.cumsum([0] + [len(v) for v in vectors])[:-1]
    m = np.array([50 + sum(c.values()) for c in docs])
    tree = fp_search.Tree(np.array([r for r, _ in flat]), np.array([n for _, n in flat]), starts, m, np.arange(len(ranks), dtype=np.int64) + 1)
    return tree, vectors, m


def test_bounds_hold_below_every_node():
    tree, vectors, m = tree_of(skewed(700))
    weights = np.arange(tree.bounds.shape[1]) + 1

    def below(node):
        if node in tree.children:
            return [d for child in range(*tree.children[node]) for d in below(child)]
        return tree.order[tree.first[node] : tree.last[node]].tolist()

    assert sorted(below(0)) == list(range(700)) and len(tree.children) > 10
    for node in range(len(tree.first)):
        for d in below(node):
            for rank, tf in vectors[d]:
                assert weights[rank] * (10**9 * tf // (1000 * tf + 20 * m[d])) <= tree.bounds[node, rank]


def test_branches_are_left_out():
    """Most documents are never scored once good ones are known."""
    rows = [(i, "w0 w1 " + f"v{i % 40} u{i % 9}", "a") for i in range(2000)] + [(2000 + i, "rare " * (i + 1), "a") for i in range(60)]
    tree, _, _ = tree_of(rows)
    best, item = fp_search.Best(5), np.array([tree.bounds.shape[1] - 1])
    wanted = np.zeros(tree.bounds.shape[1], np.int64)
    wanted[item] = 1
    ids = np.arange(len(rows))
    visits = []
    tree.first = type("Counted", (), {"__getitem__": lambda self, k, first=tree.first: visits.append(k) or first[k]})()
    tree.search(item, wanted, best, ids, np.zeros(len(rows), bool))
    assert len(best.ids) == 5 and len(visits) < 10


def test_long_texts_are_split_at_terms(monkeypatch):
    monkeypatch.setattr(fp_search, "PIECE", 16)
    text = "ab  cd " * 50 + "x" * 100 + " é" + "yz" * 9 + "  end"
    assert [t.decode() for piece in fp_search.terms_of(text) for t in piece] == terms(text)
    assert list(fp_search.terms_of("")) == []
