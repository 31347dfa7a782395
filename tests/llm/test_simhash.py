import random
import re

import numpy as np
import xxhash

from llm.conftest import ODD, frame, prose
from nearhome.llm import queries, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            bits[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(shingles))


def brute_roots(prints):
    """The index of the smallest reachable member, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(prints))]


def near(seed, groups, members, spread):
    """Fingerprints in groups around a centre."""
    pick = random.Random(seed)
    out = set()
    for _ in range(groups):
        centre = pick.getrandbits(64)
        for _ in range(members):
            out.add(centre ^ sum(1 << b for b in pick.sample(range(64), pick.randint(0, spread))))
    return sorted(out)


def roots_by(spark, values, limit):
    signed = [(v - (v >> 63 << 64),) for v in values]
    from nearhome.llm.components import connected
    from nearhome.session import written

    prints = written(spark.createDataFrame(signed, "fp long"), "test-prints")
    found = {r["node"]: r["root"] for r in connected(simhash.links(prints, limit)).collect()}
    return [found.get(s, s) for s, in signed]


def same_classes(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_quads_cover_any_three_positions():
    assert len(simhash.QUADS) == 14
    for a in range(8):
        for b in range(8):
            for c in range(8):
                assert any(not {a, b, c} & set(q) for q in simhash.QUADS)


def test_links_equal_all_pairs(spark):
    values = near(1, 12, 25, 4) + near(2, 200, 1, 0)
    assert same_classes(roots_by(spark, values, simhash.LIST), brute_roots(values))


def test_long_lists_take_the_other_way(spark):
    pick = random.Random(5)
    base = pick.getrandbits(64)
    values = sorted({base ^ pick.getrandbits(16) for _ in range(500)} | {base ^ (pick.getrandbits(8) << 40) for _ in range(60)} | set(near(3, 20, 5, 4)))
    assert same_classes(roots_by(spark, values, 20), brute_roots(values))


def test_local_and_dense_roots_agree():
    pick = np.random.default_rng(3)
    values = np.unique(pick.integers(0, 1 << 24, 3000).astype(np.uint64))
    values = np.sort((values & np.uint64(0xFF)) | (values & np.uint64(0xFFFF00)) << np.uint64(16))
    assert (simhash._dense_roots(values, [0, 3, 4]) == simhash._local_roots(values)).all()


def test_query_on_odd_documents(spark, odd, none, folder):
    found = queries.op7_simhash(spark, folder(documents=odd)).collect()
    prints = [brute_print(t) for _, t, _ in ODD]
    roots = brute_roots(prints)
    lowest = {}
    for (i, _, _), r in zip(ODD, roots):
        lowest[r] = min((x for x in (lowest.get(r), i) if x is not None), default=None)
    expected = [(i, f"{p:016x}", lowest[r]) for (i, _, _), p, r in zip(ODD, prints, roots)]
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert queries.op7_simhash(spark, folder(documents=none)).count() == 0


def test_stage_keeps_one_document_of_each_group(spark, odd, none):
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns
    prints = [brute_print(r["text"]) for r in kept.collect()]
    assert len(set(brute_roots(prints))) == len(prints) == len(set(brute_roots([brute_print(t) for _, t, _ in ODD])))
    assert simhash.near_dedup(none).count() == 0


def test_a_third_of_the_rows_in_one_group(spark):
    long = prose(9, 400).split()
    rows = []
    for i in range(900):
        words = long.copy()
        if i % 3 == 0:
            words[i % 400] = "changed"
        else:
            words = prose(i, 30).split()
        rows.append((i, " ".join(words), "a"))
    prints = [brute_print(t) for _, t, _ in rows]
    kept = simhash.near_dedup(frame(spark, rows)).count()
    assert kept == len(set(brute_roots(prints)))


def test_whole_texts_beyond_a_chunk(monkeypatch):
    text = prose(8, 500)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == whole == brute_print(text)
