import numpy as np
import pytest

from nearhome.operators import approx, cosine
from test_cosine import brute, frame, result


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dims))
    return centres[rng.integers(0, 30, n)] + rng.normal(size=(n, dims)) * 0.25


def test_most_neighbours_are_found_and_all_found_are_exact(spark):
    vectors = clustered(3000, 24, 1)
    vectors[::3] = vectors[0] + np.random.default_rng(2).normal(size=(1000, 24)) * 0.05  # a third in one bucket
    df = frame(spark, vectors)
    found = approx.approximate_top_k(df, 10, bucket_rows=200).cache()
    exact = cosine.cosine_top_k(df, 10).cache()
    assert approx.recall(found, exact) >= 0.9
    unit = cosine._unit_rows(vectors)
    for (i, rank), (j, similarity) in list(result(found).items())[:3000]:
        assert i != j and similarity == pytest.approx(1 - np.square(unit[i] - unit[j]).sum() / 2, abs=2e-9)


def test_fewer_tables_find_less(spark):
    df = frame(spark, clustered(1500, 24, 3))
    exact = cosine.cosine_top_k(df, 10).cache()
    share = lambda tables, probes: approx.recall(approx.approximate_top_k(df, 10, tables=tables, probes=probes, bucket_rows=100), exact)
    assert share(1, 0) < share(4, 1) < share(8, 3) + 0.02


def test_a_small_catalogue_is_searched_exactly(spark):
    vectors = clustered(50, 5, 4)
    assert result(approx.approximate_top_k(frame(spark, vectors), 3)).keys() == brute(vectors, 3).keys()
    assert approx.approximate_top_k(frame(spark, vectors).limit(0), 3).count() == 0
    assert [approx.planes_for(n, 100) for n in (0, 99, 199, 200, 399, 400, 102_400)] == [0, 0, 0, 1, 1, 2, 10]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_of_either_kind_go_through_the_buckets(spark, kind):
    vectors = clustered(400, 8, 5).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, f"id long, vec array<{kind}>")
    assert dict(approx.in_buckets(df, 8, 2, 1, 1).dtypes)["vec"] == f"array<{kind}>"
    found = approx.approximate_top_k(df, 5, bucket_rows=100)
    unit = cosine._unit_rows(vectors.astype(float))
    for (i, _), (j, similarity) in result(found).items():
        assert i != j and similarity == pytest.approx(1 - np.square(unit[i] - unit[j]).sum() / 2, abs=2e-9)
    assert approx.recall(found, cosine.cosine_top_k(df, 5)) >= 0.9
