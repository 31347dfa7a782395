import numpy as np
import pytest
from pyspark.sql import functions as F

from nearhome.operators import inner_product


def table(spark, key, ids, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], f"{key} long, vec array<double>")


def brute(user_ids, users, item_ids, items, n):
    rows = []
    for i, u in zip(user_ids, users):
        scores = np.zeros(len(items))
        for k in range(len(u)):
            scores += u[k] * items[:, k]
        for rank, at in enumerate(np.lexsort((item_ids, -scores))[:n], 1):
            rows.append((int(i), rank, int(item_ids[at]), float(scores[at])))
    return sorted(rows)


def check(spark, users, items, n, block):
    rng = np.random.default_rng(3)
    user_ids, item_ids = rng.permutation(10 * len(users))[: len(users)], rng.permutation(10 * len(items))[: len(items)]
    found = inner_product.top_lists(table(spark, "user_id", user_ids, users), table(spark, "item_id", item_ids, items), n, block).cache()
    rows = sorted((r["user_id"], k, i, s) for r in found.collect() for k, (i, s) in enumerate(zip(r["items"], r["scores"]), 1))
    assert rows == brute(user_ids, users, item_ids, items, n)
    return 1 - found.agg(F.sum("scored")).first()[0] / (len(users) * len(items))


def test_equals_all_pairs_and_skips_most(spark, monkeypatch):
    """Lengths as of popular and rare listings."""
    monkeypatch.setattr(inner_product, "SPLIT_ROWS", 40)
    rng = np.random.default_rng(1)
    items = rng.normal(size=(1500, 6)) * (1 / np.sqrt(np.arange(1, 1501)))[:, None]
    assert check(spark, rng.normal(size=(200, 6)) + 0.5, items, 5, 16) > 0.5


def test_ties_zeros_and_copies(spark):
    rng = np.random.default_rng(2)
    items = rng.integers(-2, 3, (300, 3)).astype(float)
    items[::3] = [1.0, 1.0, 1.0]
    users = np.concatenate([rng.integers(-2, 3, (40, 3)), np.zeros((3, 3)), -np.ones((3, 3))])
    check(spark, users, items, 7, 8)


def test_all_items_of_one_length_need_all_blocks(spark):
    rng = np.random.default_rng(4)
    items = rng.normal(size=(200, 4))
    items /= np.linalg.norm(items, axis=1, keepdims=True)
    check(spark, rng.normal(size=(30, 4)), items, 3, 10)


@pytest.mark.parametrize("n, block", [(1, 1), (50, 7), (1000, 16)])
def test_few_items_and_many_wanted(spark, n, block):
    rng = np.random.default_rng(5)
    check(spark, rng.normal(size=(20, 2)), rng.normal(size=(60, 2)), n, block)


def test_empty_and_unusable(spark):
    users, items = table(spark, "user_id", [1, 2], [[1.0], [float("nan")]]), table(spark, "item_id", [5, 6], [[2.0], [float("inf")]])
    assert [tuple(r) for r in inner_product.top_products(users, items, 3).collect()] == [(1, 1, 5, 2.0)]
    assert inner_product.top_products(users, items.limit(0), 3).count() == 0
    assert inner_product.top_products(users.limit(0), items, 3).count() == 0


@pytest.mark.parametrize("length", [1.0, 1e20, 1e-20])
def test_ranges_and_splits_of_any_layout(spark, monkeypatch, length):
    """Lengths alike, so that nothing is left out, in several ranges a round and slices a range; a row travels once a range."""
    for name, rows in (("RANGE_ROWS", 50), ("SPLIT_ROWS", 30), ("KERNEL_ROWS", 8), ("SLICE_ROWS", 16)):
        monkeypatch.setattr(inner_product, name, rows)
    rng = np.random.default_rng(6)
    items = rng.normal(size=(400, 4))
    items *= length / np.linalg.norm(items, axis=1, keepdims=True)
    check(spark, rng.normal(size=(70, 4)), items, 6, 10)


def test_a_split_of_users_reads_the_items_once(spark, monkeypatch):
    """Rows that travel, where no block can be left out: before, a user travelled once a block."""
    rng, sent = np.random.default_rng(7), []
    items = rng.normal(size=(640, 4))
    items /= np.linalg.norm(items, axis=1, keepdims=True)
    meet = inner_product._met_blocks
    monkeypatch.setattr(inner_product, "_met_blocks", lambda *args: sent.append(args[5] - args[4]) or meet(*args))
    check(spark, rng.normal(size=(20, 4)), items, 3, 10)
    assert sent == [63]


def test_all_scores(spark, monkeypatch):
    for name, rows in (("RANGE_ROWS", 50), ("SPLIT_ROWS", 20), ("KERNEL_ROWS", 8), ("SLICE_ROWS", 16)):
        monkeypatch.setattr(inner_product, name, rows)
    rng = np.random.default_rng(8)
    users, items = rng.normal(size=(45, 3)), rng.normal(size=(170, 3))
    best = -np.sort(-(users @ items.T), axis=1)[:, :5]
    floor = [None if i % 3 == 0 else float(best[i, 4]) if i % 3 == 1 else float(best[i, 2]) for i in range(45)]
    asked = spark.createDataFrame([(i, [float(x) for x in u], floor[i]) for i, u in enumerate(users)], "user_id long, vec array<double>, floor double")
    found = {r["user_id"]: r["best"] for r in inner_product.all_scores(asked, table(spark, "item_id", range(170), items), 5).collect()}
    for i in range(45):
        want = best[i] if i % 3 < 2 else best[i][:3]
        assert found[i] == pytest.approx(list(want)), i
