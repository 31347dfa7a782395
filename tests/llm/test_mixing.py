import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from llm.conftest import ODD, frame
from nearhome.llm import mixing, queries
from nearhome.session import written


def brute_targets(sizes):
    """{source: target} by sharing what is above the double again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, budget = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        level = (budget - sum(2 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in free))
        above = {s for s in free if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not above:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= above


def sizes_of(rows):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return sizes


def check(found, rows, slack):
    sizes = sizes_of(rows)
    target = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], rel=1e-9, abs=1e-6)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    assert len(found) == len(rows)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= slack(s)


def test_query_on_odd_documents(spark, odd, none, folder):
    found = queries.op3_source_mix(spark, folder(documents=odd)).collect()
    largest = {}
    for _, text, source in ODD:
        largest[source] = max(largest.get(source, 0), len((text or "").split()))
    check(found, ODD, lambda s: largest[s])
    assert queries.op3_source_mix(spark, folder(documents=none)).count() == 0


def test_words_come_near_the_target_and_reruns_agree(spark, folder):
    rows = [(i, " ".join(["w"] * (1 + i * i % 97 + 400 * (i % 50 == 0))), ["hot", "b", "c", None, "e"][i % 3 and i % 5]) for i in range(6000)]
    path = folder(documents=frame(spark, rows))
    found = queries.op3_source_mix(spark, path).collect()
    target = brute_targets(sizes_of(rows))
    check(found, rows, lambda s: 0.01 * target[s])
    again = queries.op3_source_mix(spark, path).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


UNIT = "row long, doc_id long, source_no long, size long, chance double"


def test_rounds_of_small_blocks_give_balanced_draws(spark):
    rows = [(i, i, 0, 1 + i % 83, 0.3) for i in range(3000)]
    units = written(spark.createDataFrame(rows, UNIT), "units")
    found = mixing.drawn(units, block=50).join(units, "row").agg(F.count("*"), F.sum("extra"), F.sum(F.col("extra") * F.col("size"))).first()
    assert found[0] == 3000
    assert abs(found[1] - 900) <= 3
    assert abs(found[2] - 0.3 * sum(r[3] for r in rows)) <= 100


def test_repeated_and_missing_ids_are_spread(spark, monkeypatch):
    """All rows of one id, or without any, do not meet in one block."""
    sizes = []
    monkeypatch.setattr(mixing, "written", lambda df, name: written(df, name) if not name.startswith("mix-round") else seen(written(df, name)))

    def seen(df):
        sizes.append(df.count())
        return df

    rows = [(i, None if i % 2 else 7, 0, 1 + i % 9, 0.4) for i in range(4000)]
    units = written(spark.createDataFrame(rows, UNIT), "units")
    found = mixing.drawn(units, block=100).join(units, "row").agg(F.count("*"), F.sum("extra")).first()
    # 40 blocks leave 14 documents each at most; one block of all rows would leave 14 for the second round
    assert found[0] == 4000 and abs(found[1] - 1600) <= 3 and 100 < sizes[1] <= 40 * mixing.LAND


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 500)), max_size=60), st.integers(0, 2**30))
def test_flight_keeps_both_totals(units, seed):
    chances, sizes = np.array([c for c, _ in units] or [0.0]), np.array([s for _, s in units] or [0])
    moved = mixing.flight(chances, sizes, np.random.default_rng(seed))
    assert moved.sum() == pytest.approx(chances.sum(), abs=1e-4)
    assert (moved * sizes).sum() == pytest.approx((chances * sizes).sum(), rel=1e-6, abs=1e-2)
    assert ((moved > 0) & (moved < 1)).sum() <= 2
    assert set(mixing.landing(moved, sizes.astype(float), np.random.default_rng(seed))) <= {0.0, 1.0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 500)), min_size=1, max_size=80), st.integers(0, 2**30))
def test_settling_keeps_both_totals(units, seed):
    chances, sizes = np.array([c for c, _ in units]), np.array([s for _, s in units]).astype(float)
    moved = mixing.settled(chances, sizes, np.random.default_rng(seed))
    assert moved.sum() == pytest.approx(chances.sum(), abs=1e-4)
    assert (moved * sizes).sum() == pytest.approx((chances * sizes).sum(), rel=1e-5, abs=1e-2)


def draw(chances, sizes, seed):
    random = np.random.default_rng(seed)
    return mixing.landing(mixing.flight(mixing.settled(chances, sizes, random), sizes, random, mixing.LAND), sizes, random)


@pytest.mark.parametrize("n", [1, 2, 14, 40])
def test_every_chance_is_kept(n):
    """All documents, at the ``LAND`` in use; a source of 14 documents and less has its landing only."""
    random = np.random.default_rng(n)
    sizes, chances = np.floor(np.exp(random.normal(4, 1, n))), random.uniform(0.1, 0.9, n)
    draws = np.array([draw(chances, sizes, [k, n]) for k in range(500)])
    assert set(draws.ravel()) <= {0.0, 1.0}
    assert np.abs(draws.mean(axis=0) - chances).max() < 4.5 * np.sqrt(0.25 / 500)
    assert len({tuple(d) for d in draws}) > 1


def test_words_and_documents_are_balanced():
    random = np.random.default_rng(3)
    sizes = np.floor(np.exp(random.normal(5, 1.2, 600))) + 1
    sizes[:3] = [20_000, 15_000, 9_000]
    off = [draw(np.full(600, 0.37), sizes, k) - 0.37 for k in range(60)]
    assert np.mean([abs((d * sizes).sum()) for d in off]) < 0.005 * sizes.sum() and np.mean([abs(d.sum()) for d in off]) < 1.5


def test_stage_repeats_documents(spark, odd, none):
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    sizes = sizes_of(ODD)
    target = brute_targets(sizes)
    words, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in mixed.collect():
        words[r["source"]] += len((r["text"] or "").split())
    for _, text, source in ODD:
        largest[source] = max(largest[source], len((text or "").split()))
    assert all(abs(words[s] - target[s]) <= largest[s] for s in sizes)
    assert mixing.mix(none).count() == 0
