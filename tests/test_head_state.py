import random

import pytest

from nearhome.operators import head_state, neighbors
from nearhome.session import written

SCHEMA = "id long, cluster string, prix double"


def frame(spark, rows):
    return spark.createDataFrame([(i, c, p) for i, (c, p) in rows.items()], SCHEMA)


def same(spark, state, catalogue, k):
    found = {r["cluster"]: r["head"] for r in head_state.heads(state, k).collect()}
    assert found == {r["cluster"]: r["head"] for r in neighbors.cluster_heads(frame(spark, catalogue), "cluster", k).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_recomputation_after_every_batch(spark, seed):
    """New, changed, moved and leaving listings, among them whole heads; a third of all listings in one cluster."""
    pick, k = random.Random(seed), 2
    place = lambda i: "hot" if i % 3 == 0 else pick.choice("abcd")
    catalogue = {i: (place(i), float(pick.randint(1, 60))) for i in range(200)}
    state = written(head_state.head_state(frame(spark, catalogue), "cluster", k), "state")
    refills = 0
    for batch in range(6):
        changes = {i: (place(i), float(pick.randint(1, 60))) for i in pick.sample(range(400), 25)}
        heads = [i for r in head_state.heads(state, k).collect() for i in r["head"]]
        cheapest = sorted(catalogue, key=lambda i: catalogue[i][1])[: 20 if batch % 2 else 3]
        changes |= {i: (None, None) for i in [*pick.sample(heads, min(4, len(heads))), *cheapest]}
        for i, row in changes.items():
            catalogue.pop(i, None)
            if row[0] is not None:
                catalogue[i] = row
        state = written(head_state.updated(state, frame(spark, changes), k), "state")
        refills += head_state.exhausted(state, k).count()
        state = written(head_state.refilled(state, frame(spark, catalogue), "cluster", k), "state")
        same(spark, state, catalogue, k)
        assert max(len(r["best"]) for r in state.collect()) <= head_state.size_for(k)
    assert refills < 6 * 5  # most batches need no look at the catalogue


def test_merging_the_states_of_two_parts(spark):
    pick, k = random.Random(5), 3
    catalogue = {i: (pick.choice("ab"), float(pick.randint(1, 9))) for i in range(150)}
    part = lambda odd: head_state.head_state(frame(spark, {i: r for i, r in catalogue.items() if (i % 3 == 0) == odd}), "cluster", k)
    same(spark, head_state.merged(part(True), part(False), k), catalogue, k)


def test_empty_clusters_and_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    state = written(head_state.head_state(none, "cluster"), "state")
    assert head_state.heads(state).count() == 0
    state = written(head_state.updated(state, frame(spark, {1: ("a", 2.0), 2: ("a", 1.0), 3: ("b", 5.0), 4: ("b", None)})), "state")
    assert {r["cluster"]: r["head"] for r in head_state.heads(state).collect()} == {"a": [2, 1], "b": [3]}
    state = written(head_state.updated(state, frame(spark, {3: (None, None)})), "state")
    assert {r["cluster"]: r["head"] for r in head_state.heads(state).collect()} == {"a": [2, 1]}
    assert head_state.exhausted(state).count() == 0
