import math
import random
import struct
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearhome.functions import exact
from nearhome.operators import prepare, rating_store
from nearhome.session import scratch_path

SCHEMA = "user_id long, annonce_id long, interaction_score float"


def floats(seed, n, kind):
    pick = random.Random(seed)
    if kind == "any":
        values = [struct.unpack("<f", pick.randbytes(4))[0] for _ in range(n)]
        return [v for v in values if math.isfinite(v)]
    low, high = {"small": (-149, -100), "score": (-4, 6), "wide": (-140, 120)}[kind]
    return [float(np.float32(pick.choice([-1, 1]) * pick.random() * 2.0 ** pick.randint(low, high))) for _ in range(n)]


def sums(spark, groups):
    rows = [(g, float(v)) for g, values in enumerate(groups) for v in values]
    df = spark.createDataFrame(rows, "g int, v float").repartition(3)
    found = df.groupBy("g").agg(*exact.limb_sums(F.col("v"), "s"))
    return found.select("g", *exact.limb_names("s"), exact.total("s").alias("total")).orderBy("g").collect()


@pytest.mark.parametrize("kind", ["any", "small", "score", "wide"])
def test_limbs_hold_the_whole_sum(spark, kind):
    groups = [floats(seed, 50, kind) for seed in range(30)] + [[0.0, -0.0], [3.4028234663852886e38] * 3, [1.401298464324817e-45] * 3, [1e30, 1e-13, -1e30]]
    groups = [[float(np.float32(v)) for v in g] for g in groups]
    for row, values in zip(sums(spark, groups), groups):
        right = sum(map(Fraction, values), Fraction(0))
        found = sum(Fraction(row[f"s_{k}"]) * Fraction(2) ** (exact.LOWEST + exact.WIDTH * k) for k in range(exact.LIMBS))
        assert found == right
        assert abs(Fraction(row["total"]) - right) <= abs(right) * Fraction(1, 2**50)
        if Fraction(float(right)) == right and kind == "score":
            assert row["total"] == float(right)


def brute(rows):
    groups = {}
    for user, listing, score in rows:
        groups.setdefault((user, listing), []).append(score)
    out = {}
    for key, scores in groups.items():
        scores = [s for s in scores if s is not None]
        odd = any(not math.isfinite(s) for s in scores)
        out[key] = math.nan if odd else float(sum(map(Fraction, scores), Fraction(0)) / len(scores)) if scores else None
    return out


def same(found, right):
    got = {(r["user_id"], r["annonce_id"]): r["interaction_score"] for r in found.collect()}
    assert got.keys() == right.keys()
    for key, value in right.items():
        assert (got[key] is None and value is None) or (math.isnan(value) and math.isnan(got[key])) or got[key] == pytest.approx(value, rel=1e-14, abs=0)


def interactions():
    pick = random.Random(3)
    odd = [1e30, 1e-13, 3e-13, -1e30, 0.1, None, float("nan"), float("inf"), 5.0, 1e38, 1e-44]
    values = [v if v is None else float(np.float32(v)) for v in odd]
    rows = [(pick.randrange(20), pick.randrange(3), pick.choice(values)) for _ in range(400)]
    hot = [(99, 1, float(np.float32(0.1 * (i % 7)))) for i in range(300)]
    return rows + hot + [(1, 50, values[0]), (1, 51, values[1]), (1, 51, values[2]), (None, 1, 2.0), (1, None, 2.0), (2, 60, None)]


def test_means_of_huge_and_tiny_scores(spark):
    rows = interactions()
    same(prepare.rating_matrix(spark.createDataFrame(rows, SCHEMA)), brute(rows))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_division_into_batches_gives_the_same(spark, seed):
    rows, pick, root = interactions(), random.Random(seed), scratch_path(spark, "ratings")
    pick.shuffle(rows)
    assert rating_store.ratings(spark, root) is None
    cuts = sorted(pick.sample(range(len(rows)), 3))
    for batch, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        for _ in range(pick.randint(1, 2)):  # repeated batches count once
            rating_store.fold(spark.createDataFrame(rows[a:b], SCHEMA), root, batch)
        if pick.random() < 0.6:
            rating_store.compact(spark, root)
            if pick.random() < 0.5:
                rating_store.remove_folded(spark, root)
    whole = prepare.rating_matrix(spark.createDataFrame(rows, SCHEMA))
    key = lambda r: str((r["user_id"], r["annonce_id"]))
    assert sorted(map(str, rating_store.ratings(spark, root).collect())) == sorted(map(str, whole.collect()))
    same(rating_store.ratings(spark, root), brute(rows))
