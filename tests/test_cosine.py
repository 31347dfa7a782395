import numpy as np
import pytest
from pyspark.sql import functions as F

from nearhome.operators import cosine


def frame(spark, vectors, groups=None, first=0):
    rows = [(first + i, None if groups is None else groups[i], [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "id long, grp string, vec array<double>")
    return df if groups is not None else df.drop("grp")


def brute(vectors, k, groups=None):
    """All pairs, the plain way: by the squared difference of the unit vectors, not rounded."""
    m = np.array(vectors, dtype=float)
    whole = np.flatnonzero(np.abs(m).max(axis=1) > 0)
    unit = cosine._unit_rows(m[whole])
    best = {}
    for at, i in enumerate(whole.tolist()):
        gaps = np.square(unit - unit[at]).sum(axis=1)
        near = [(gap, j) for gap, j in zip(gaps.tolist(), whole.tolist()) if j != i and (groups is None or groups[i] == groups[j])]
        for rank, (gap, j) in enumerate(sorted(near)[:k], 1):
            best[i, rank] = (j, round(1 - gap / 2, cosine.SIM_DIGITS))
    return best


def result(df):
    rows = df.collect()
    found = {(r["id"], r["rank"]): (r["similar_id"], r["similarity"]) for r in rows}
    assert len(found) == len(rows)
    return found


def same(found, expected):
    assert found.keys() == expected.keys()
    for key, (similar, similarity) in expected.items():
        assert found[key][0] == similar, key
        assert found[key][1] == pytest.approx(similarity, abs=2e-9)


def test_hand_written(spark):
    found = result(cosine.cosine_top_k(frame(spark, [(1, 0), (0, 1), (1, 1), (-1, 0), (0, 0)]), 3))
    assert found[0, 1] == (2, pytest.approx(0.707106781))
    assert found[0, 2] == (1, 0.0)
    assert found[0, 3] == (3, -1.0)
    assert not any(4 in (key[0], value[0]) for key, value in found.items())  # a zero vector has no similarity


def test_nan_null_and_infinite_vectors_are_left_out(spark):
    rows = [(0, [1.0, 0.0]), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, [float("inf"), 1.0]), (4, [1.0, 1.0]), (5, None)]
    found = result(cosine.cosine_top_k(spark.createDataFrame(rows, "id long, vec array<double>"), 3))
    assert {key[0] for key in found} == {0, 4} and len(found) == 2


def test_huge_and_tiny_entries(spark):
    found = result(cosine.cosine_top_k(frame(spark, [(1e200, 1e200), (1e-200, 0), (1, 0)]), 1))
    assert found[1, 1] == (2, 1.0)
    assert found[0, 1] == (1, pytest.approx(0.707106781))


@pytest.mark.parametrize("blocks", [(10_000, 10_000), (40, 50), (7, 5)])
def test_equals_all_pairs(spark, blocks):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(240, 5)).round(3)
    found = cosine.cosine_top_k(frame(spark, vectors), 6, block_rows=blocks[0], split_rows=blocks[1], cell_rows=blocks[0])
    same(result(found), brute(vectors, 6))


def test_blocks_without_pivots(spark):
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(120, 4)).round(3)
    groups = [f"g{i % 3}" for i in range(120)]
    same(result(cosine.cosine_top_k(frame(spark, vectors), 4, block_rows=25, split_rows=30)), brute(vectors, 4))
    found = cosine.cosine_top_k(frame(spark, vectors, groups), 4, group="grp", block_rows=25, split_rows=30)
    same(result(found), brute(vectors, 4, groups))


def test_pruning_on_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 4)) * 5
    vectors = (centres[rng.integers(0, 8, 400)] + rng.normal(size=(400, 4)) * 0.05).round(4)
    same(result(cosine.cosine_top_k(frame(spark, vectors), 5, block_rows=20, split_rows=30, cell_rows=20)), brute(vectors, 5))


def test_few_pivots(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(200, 3)).round(3)
    same(result(cosine.cosine_top_k(frame(spark, vectors), 4, block_rows=10, cell_rows=10)), brute(vectors, 4))


def test_a_third_are_copies(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(300, 3)).round(2)
    vectors[rng.permutation(300)[:100]] = (0.5, -0.25, 1.0)
    for block_rows in (1000, 16):
        same(result(cosine.cosine_top_k(frame(spark, vectors), 5, block_rows=block_rows, split_rows=20, cell_rows=block_rows)), brute(vectors, 5))


def test_scaled_copies_tie_on_the_lower_id(spark):
    vectors = [(3, 4), (6, 8), (30, 40), (0.3, 0.4), (4, 3)]
    found = result(cosine.cosine_top_k(frame(spark, vectors), 2))
    assert [found[4, 1][0], found[4, 2][0]] == [0, 1]
    assert [found[1, 1][0], found[1, 2][0]] == [0, 2]


@pytest.mark.parametrize("block_rows", [1000, 12])
def test_groups_with_a_hot_one(spark, block_rows):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(260, 4)).round(3)
    groups = ["hot" if i % 3 else f"g{i % 40}" for i in range(260)]
    found = cosine.cosine_top_k(frame(spark, vectors, groups), 5, group="grp", block_rows=block_rows, split_rows=25, cell_rows=block_rows)
    same(result(found), brute(vectors, 5, groups))


def test_queries_outside_the_catalogue(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(150, 3)).round(3)
    catalogue, asked = frame(spark, vectors[:120]), frame(spark, vectors[120:], first=120)
    for block_rows in (1000, 15):
        found = result(cosine.cosine_top_k(catalogue, 4, queries=asked, block_rows=block_rows, cell_rows=block_rows))
        expected = {}
        for i in range(120, 150):
            alone = brute([*vectors[:120], vectors[i]], 4)
            expected |= {(i, rank): alone[120, rank] for rank in range(1, 5)}
        same(found, expected)


def test_fewer_than_k_in_own_cell(spark):
    # ten far-off singles make cells of their own, where no query finds k others
    rng = np.random.default_rng(7)
    vectors = np.concatenate([np.eye(12)[:10] * 9, rng.normal(size=(90, 12)) * 0.01 + 1]).round(4)
    same(result(cosine.cosine_top_k(frame(spark, vectors), 8, block_rows=3, cell_rows=3)), brute(vectors, 8))


def test_a_far_vector_changes_nothing(spark):
    rng = np.random.default_rng(8)
    vectors = np.abs(rng.normal(size=(50, 3))).round(3)
    before = result(cosine.cosine_top_k(frame(spark, vectors), 5))
    after = result(cosine.cosine_top_k(frame(spark, [*vectors, (-5, -5, -5)]), 5))
    assert {key: value for key, value in after.items() if key[0] < 50} == before


def test_mean_similarity_defaults_to_zero(spark):
    one = frame(spark, [(1, 2)])
    row = cosine.mean_similarity(one, cosine.cosine_top_k(one)).first()
    assert (row["similar_ids"], row["similarity"]) == ([], 0.0)
    three = frame(spark, [(1, 0), (1, 0), (0, 1)])
    means = {r["id"]: (r["similar_ids"], r["similarity"]) for r in cosine.mean_similarity(three, cosine.cosine_top_k(three)).collect()}
    assert means == {0: ([1, 2], 0.5), 1: ([0, 2], 0.5), 2: ([0, 1], 0.0)}


@pytest.mark.parametrize("block_rows", [1000, 2])
@pytest.mark.parametrize("group", [None, "grp"])
def test_no_cross_join_in_the_plan(spark, capsys, block_rows, group):
    df = frame(spark, np.eye(6) + 0.1, ["a", "b"] * 3)
    cosine.cosine_top_k(df, 2, group=group, block_rows=block_rows, cell_rows=block_rows).explain()
    plan = capsys.readouterr().out
    assert "CoGroup" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_higher_order_functions(spark):
    from nearhome.functions import cosine as cosine_of, l2_norm, unit

    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(cosine_of(F.col("a"), F.col("b")), l2_norm(F.col("b")), unit(F.col("b")), unit(F.col("a"))).collect()
    assert rows[0][0] == pytest.approx(0.5 ** 0.5) and rows[1][0] is None
    assert rows[0][1] == pytest.approx(2 ** 0.5)
    assert rows[0][2] == pytest.approx([0.5 ** 0.5] * 2) and rows[1][3] == [0.0, 0.0]


def test_real_prices_are_told_apart(spark):
    """20,000 listings from ten thousand up: most cosines are 1 to nine digits."""
    rng = np.random.default_rng(5)
    n = 20_000
    vectors = np.column_stack([rng.uniform(10_000, 300_000, n), rng.uniform(-90, 90, n), rng.uniform(-180, 180, n), rng.integers(0, 2, n)])
    asked = rng.choice(n, 300, replace=False)
    catalogue = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "id long, vec array<double>").cache()
    queries = catalogue.join(spark.createDataFrame([(int(i),) for i in asked], "id long"), "id")
    found = {(r["id"], r["rank"]): r["similar_id"] for r in cosine.cosine_top_k(catalogue, 10, queries=queries).collect()}
    unit = cosine._unit_rows(vectors)
    for i in asked.tolist():
        gaps = np.square(unit - unit[i]).sum(axis=1)
        gaps[i] = np.inf
        assert [found[i, rank] for rank in range(1, 11)] == np.lexsort((np.arange(n), gaps))[:10].tolist()


def test_vectors_of_different_lengths_are_refused(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0, 4.0, 5.0])]
    with pytest.raises(Exception, match="different lengths"):
        cosine.cosine_top_k(spark.createDataFrame(rows, "id long, vec array<double>"), 1).collect()


@pytest.mark.parametrize("cell_rows, groups", [(20, False), (20, True), (10_000, False), (10_000, True)])
def test_deltas_give_what_a_rebuild_gives(spark, monkeypatch, cell_rows, groups):
    """Clusters, copies and vectors beyond every radius come as deltas; after some of them the parts are written as one."""
    monkeypatch.setattr(cosine, "DELTAS", 2)
    rng = np.random.default_rng(7)
    vectors = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(60, 3)) * 0.01 + [5, 1, 0], np.tile([1.0, 2.0, 3.0], (40, 1)), -rng.random((50, 3))])
    order = rng.permutation(len(vectors))
    names = [["x", "y", None][i % 3] if i < 295 else "new" for i in range(len(vectors))] if groups else None
    part = lambda some: spark.createDataFrame(
        [(int(i), None if names is None else names[i], [float(x) for x in vectors[i]]) for i in some], "id long, grp string, vec array<double>")
    group = "grp" if groups else None
    index = cosine.build_index(part(order[:120]), 4, group, block_rows=16, cell_rows=cell_rows)
    for some in (order[120:125], order[125:200], order[200:260], order[260:]):
        index = index.added(part(some))
    found = result(index.search(part(range(len(vectors))), split_rows=32))
    kept = [i for i in range(len(vectors)) if names is None or names[i] is not None]
    expected = brute([vectors[i] for i in kept], 4, None if names is None else [names[i] for i in kept])
    same(found, {(kept[i], rank): (kept[j], s) for (i, rank), (j, s) in expected.items()})
    assert index.deltas <= 2


def test_an_index_asks_for_a_new_one_when_a_cell_is_overfull(spark):
    rng = np.random.default_rng(8)
    index = cosine.build_index(frame(spark, rng.normal(size=(100, 3))), 3, cell_rows=20)
    assert not index.outgrown()
    index = index.added(frame(spark, rng.normal(size=(30, 3)) * 0.01 + [9, 9, 9], first=100))
    assert not index.outgrown()
    index = index.added(frame(spark, rng.normal(size=(300, 3)) * 0.01 + [9, 9, 9], first=200))
    assert index.outgrown()


def test_the_catalogue_index_is_added_to_or_made_anew(spark, monkeypatch):
    from nearhome.plans import jobs

    built, real = [], cosine.build_index
    monkeypatch.setattr(cosine, "build_index", lambda *a, **b: built.append(1) or real(*a, **b))
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(60, 3))
    first, more = frame(spark, vectors[:50]), frame(spark, vectors)
    index = jobs.catalogue_index(first, None, None, 3)
    grown = jobs.catalogue_index(more, first, index, 3)
    assert len(built) == 1
    same(result(grown.search(more)), brute(vectors, 3))
    changed = frame(spark, [v * [1, 1, -1] if i == 4 else v for i, v in enumerate(vectors)])
    again = jobs.catalogue_index(changed, more, grown, 3)
    assert len(built) == 2
    same(result(again.search(changed)), brute([v * [1, 1, -1] if i == 4 else v for i, v in enumerate(vectors)], 3))
    jobs.catalogue_index(first, changed, again, 3)
    assert len(built) == 3  # some have left


def test_floats_travel_as_floats_and_visits_without_vectors(spark, monkeypatch):
    rng, kept = np.random.default_rng(9), {}
    vectors = rng.normal(size=(300, 5)).astype(np.float32)
    write = cosine.written
    monkeypatch.setattr(cosine, "written", lambda df, name: kept.update({name: dict(df.dtypes)}) or write(df, name))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, vec array<float>")
    found = result(cosine.cosine_top_k(rows, 5, block_rows=40, split_rows=50, cell_rows=40))
    same(found, brute(vectors.astype(float), 5))
    assert kept["cosine-cells"]["vec"] == "array<float>" and "vec" not in kept["cosine-visits"]
