import numpy as np
import pytest

from llm.conftest import ODD, frame, prose
from nearhome.llm import quality_model, queries

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=600):
    docs, labels = [], []
    for i in range(n):
        kind = i % 3
        words = prose(i, 40).split()
        if kind == 0:
            words[i % 40] = ["scoundrel", "rascal", "villain"][i // 3 % 3]
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "a"))
        labels.append((i, int(kind != 1), int(kind == 0)))
    return docs, labels


def test_slopes_are_those_of_the_loss():
    random = np.random.default_rng(1)
    grade, flat = np.array([0, 1, 2, 2, 1]), random.integers(0, 4, 12)
    rows, scale, point = np.sort(random.integers(0, 5, 12)), np.array([1.0, 2, 0.5, 1]), random.normal(size=6)
    loss = lambda p: quality_model.loss_and_slopes(grade, rows, flat, scale, p)
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        assert (loss(point + step)[0] - loss(point - step)[0]) / 2e-6 == pytest.approx(loss(point)[1 + k], rel=1e-4, abs=1e-6)


def test_held_out_grades(spark, folder):
    docs, labels = corpus(spark)
    half = [x for x in labels if x[0] % 2]
    path = folder(documents=frame(spark, docs + ODD), labels=spark.createDataFrame(half + half[:5] + [(None, 1, 0), (2, None, None)], LABELS))
    rows = queries.op2_quality_model(spark, path).collect()
    assert len(rows) == len(docs) + len(ODD)
    assert all(1 >= r["p_ge_1"] >= r["p_ge_2"] >= 0 and r["expected_grade"] == pytest.approx(r["p_ge_1"] + r["p_ge_2"], abs=1e-6) for r in rows)
    texts = dict((i, t) for i, t, _ in docs)
    found = {r["doc_id"]: r for r in rows if r["doc_id"] in texts and r["doc_id"] > 12}
    held_out = [x for x in labels if x[0] in found and not x[0] % 2]
    right = [found[i]["kept"] == (quality == 1 and toxic == 0) for i, quality, toxic in held_out]
    assert np.mean(right) > 0.97
    mean = lambda kind: np.mean([found[i]["expected_grade"] for i, *_ in held_out if i % 3 == kind])
    assert mean(0) < mean(1) < mean(2)


def test_lowest_rating_counts(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (3, None, 0), (None, 1, 0), (4, 1, 0)], LABELS)
    assert sorted(map(tuple, quality_model.grades(labels).collect())) == [(1, 1), (2, 0), (4, 2)]


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)]])
def test_without_two_grades_all_is_kept(spark, odd, folder, labels):
    path = folder(documents=odd, labels=spark.createDataFrame(labels, LABELS))
    rows = queries.op2_quality_model(spark, path).collect()
    assert len(rows) == len(ODD) and all(r["kept"] for r in rows)


def test_empty_documents(spark, none, folder):
    path = folder(documents=none, labels=spark.createDataFrame([(1, 1, 0)], LABELS))
    assert queries.op2_quality_model(spark, path).count() == 0


def test_bound_on_rated_rows(spark):
    docs, labels = corpus(spark, 60)
    rated = quality_model.rated_features(frame(spark, docs), spark.createDataFrame(labels, LABELS), rows=25)
    assert rated.count() == 25
