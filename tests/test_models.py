import re
import time

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from nearhome import schemas
from nearhome.operators import features, lifecycle, recommend, targeting
from nearhome.plans import hybrid
from nearhome.session import scratch_path, shuffles_removed, written

LISTING = "id long, prix double, type_bien string, lease_duration string, latitude double, longitude double"


def listings(spark, n=60):
    rows = [(i, 10.0 + i % 7, "ABC"[i % 3], "MD"[i % 2] if i else "M", float(i % 11), float(i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, LISTING)


@pytest.fixture(scope="module")
def pipeline(spark):
    return features.fit_features(listings(spark), clusters=4)


@pytest.fixture(scope="module")
def ratings(spark):
    rng = np.random.default_rng(1)
    rows = [(u, i, float(rng.integers(1, 50)) / 10) for u in range(30) for i in range(12) if rng.random() < 0.5]
    return spark.createDataFrame(rows, "user_id long, annonce_id long, interaction_score double")


@pytest.fixture(scope="module")
def als(spark, ratings):
    return recommend.fit_als(ratings)


def factors(als):
    """Factors by the ids themselves."""
    number = [{r[1]: r[0] for r in table.collect()} for table in (als.users, als.listings)]
    rows = (als.model.userFactors.collect(), als.model.itemFactors.collect())
    return [{n[r["id"]]: np.array(r["features"]) for r in found} for n, found in zip(number, rows)]


def test_the_last_half_step_is_solved(ratings, als):
    """For every user: sum of (prediction - rating) * listing factors + regularisation * ratings * user factors = 0."""
    user, item = factors(als)
    given = {}
    for u, i, score in ratings.collect():
        given.setdefault(u, []).append((item[i], float(np.float32(score))))
    for u, rows in given.items():
        slope = sum((user[u] @ y - score) * y for y, score in rows) + schemas.ALS_REG * len(rows) * user[u]
        assert np.abs(slope).max() < 1e-3
        assert len(user[u]) == schemas.ALS_RANK


def shuffles(spark):
    """The ids of the shuffles that have files."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    return set(map(int, re.findall(r"shuffle_(\d+)_", blocks)))


def settled(spark, before, most):
    """New shuffles with files, once they are at most ``most``; they are removed in the background."""
    for _ in range(50):
        if len(shuffles(spark) - before) <= most:
            break
        time.sleep(0.2)
    return len(shuffles(spark) - before)


def test_training_keeps_the_shuffles_of_few_iterations(spark, ratings, als):
    before = shuffles(spark)
    again = recommend.fit_als(ratings)
    assert settled(spark, before, 10) <= 10 < schemas.ALS_ITERATIONS
    for one, other in zip(factors(als), factors(again)):
        assert one.keys() == other.keys() and all(np.allclose(one[k], other[k], atol=1e-4) for k in one)


def test_factors_do_not_depend_on_the_checkpoints(ratings, als):
    for one, other in zip(factors(als), factors(recommend.fit_als(ratings, checkpoint_interval=10))):
        assert one.keys() == other.keys() and all(np.allclose(one[k], other[k], atol=1e-4) for k in one)


def test_shuffles_of_written_tables_are_removed(spark):
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffles(spark)
    told = spark.conf.get(key)
    with shuffles_removed(spark):
        counts = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
        assert spark.conf.get(key) == "true"
    assert settled(spark, before, 0) == 0 and spark.conf.get(key) == told
    assert sorted(r["count"] for r in counts.collect()) == [142] + [143] * 6


def test_ids_of_any_size(spark, ratings):
    wide = ratings.select((F.col("user_id") + 2**40).alias("user_id"), (F.col("annonce_id") - 2**50).alias("annonce_id"), "interaction_score")
    found = recommend.user_recommendations(recommend.fit_als(wide), 3).select(
        (F.col("user_id") - 2**40).alias("user_id"), (F.col("annonce_id") + 2**50).alias("annonce_id"), F.round("rating", 4).alias("rating"))
    plain = recommend.user_recommendations(recommend.fit_als(ratings), 3).select("user_id", "annonce_id", F.round("rating", 4).alias("rating"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_clusters_are_better_than_one(spark, pipeline):
    scored = features.scored_listings(pipeline, listings(spark)).select(vector_to_array("norm_features").alias("v"), "prediction").collect()
    m, place = np.array([r["v"] for r in scored]), np.array([r["prediction"] for r in scored])
    cost = sum(np.square(m[place == c] - m[place == c].mean(axis=0)).sum() for c in set(place.tolist()))
    assert len(set(place.tolist())) == 4 and cost < 0.5 * np.square(m - m.mean(axis=0)).sum()


def test_notification_rows_are_spread(spark):
    """A third of the listings share one list."""
    similar = spark.range(3000).select(
        F.col("id").alias("announce_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.col("id") % 40 + 3)).cast("array<long>").alias("similar_ids"))
    scores = spark.range(50).crossJoin(spark.range(50).select(F.col("id").alias("user_id"))).select(F.col("id").alias("annonce_id"), "user_id", (F.col("user_id") / 7).alias("score"))
    found = targeting.target_users(similar, targeting.distinct_lists(similar), scores, 20, out_rows=6000)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 * 20 and len(sizes) == 10 and max(sizes) < 2 * 6000


def test_unseen_category_is_scored_as_zeros(spark, pipeline):
    new = spark.createDataFrame([(1, 10.0, "NEW", "M", 1.0, 2.0), (2, 10.0, "C", "M", 1.0, 2.0)], LISTING)
    rows = {r["id"]: r for r in pipeline.transform(new).select("id", vector_to_array("features").alias("v"), "prediction").collect()}
    assert rows[1]["v"][3:5] == [0.0, 0.0]
    assert len(rows[1]["v"]) == 3 + 2 + 1 and 0 <= rows[1]["prediction"] < 4


def test_single_valued_category_is_left_out(spark):
    one = listings(spark).withColumn("type_bien", F.lit("HOUSE"))
    model = features.fit_features(one, clusters=None)
    row = model.transform(one).select(vector_to_array("features").alias("v")).first()
    assert len(row["v"]) == 3 + 1


def test_any_number_of_values_has_an_index(spark):
    df = spark.range(24_000).select((F.col("id") % 12_000).cast("string").alias("c")).unionByName(spark.createDataFrame([("7",), ("30",), ("30",)], "c string"))
    rows = features.category_index(df, "c").orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(12_000))
    assert [(r["value"], r["n"]) for r in rows[:4]] == [("30", 4), ("7", 3), ("0", 2), ("1", 2)]


def test_model_with_many_values_of_a_category(spark, tmp_path):
    """100,000 values, a third of the listings on one; the model holds a table of them, not their labels."""
    n = 200_000
    rows = spark.range(n).select(
        "id", (10.0 + F.col("id") % 7).alias("prix"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 100_000)).alias("type_bien"),
        F.lit("M").alias("lease_duration"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"),
    )
    model = features.fit_features(rows, clusters=None)
    model.write().overwrite().save(str(tmp_path / "m"))
    values = rows.select("type_bien").distinct().count()
    index = {r["value"]: r["idx"] for r in features.category_index(rows, "type_bien").collect()}
    assert index["hot"] == 0 and sorted(index.values()) == list(range(values))
    some = rows.filter("id % 5003 = 0 OR id = 199999").union(spark.createDataFrame([(-1, 1.0, "unseen", "M", 0.0, 0.0)], rows.schema))
    for known in (model, features.FeatureModel.load(str(tmp_path / "m"))):
        for r in known.transform(some).select("type_bien", "features").collect():
            hot = [i - 3 for i in r["features"].indices.tolist() if i >= 3]
            expected = index.get(r["type_bien"], values - 1)
            assert r["features"].size == 3 + values - 1 and hot == ([expected] if expected < values - 1 else [])
    assert all("labels" not in [p.name for p in stage.params] for stage in model.stages)


def test_older_column_order(spark):
    order = ["prix", "type_bien", "latitude", "longitude"]
    model = features.fit_features(listings(spark), categories=["type_bien"], clusters=None, order=order)
    row = model.transform(listings(spark).filter("id = 1")).select(vector_to_array("features").alias("v")).first()
    assert row["v"] == [11.0, 0.0, 1.0, 1.0, 1.0]


def test_everyone_is_at_the_nearest_centre(spark, pipeline):
    scored = features.scored_listings(pipeline, listings(spark))
    gaps = features.centre_distances(pipeline, scored)
    assert gaps.filter("own > nearest + 1e-9").count() == 0
    assert scored.select("prediction").distinct().count() <= 4


def test_model_versions(spark, monkeypatch):
    root, trained = scratch_path(spark, "models"), []

    def train(df):
        trained.append(df.count())
        return features.fit_features(df, clusters=2)

    def run(df, threshold=20):
        return lifecycle.load_or_train(spark, df, root, train, features.FeatureModel.load, threshold)[1]

    assert run(listings(spark, 40)) == 1
    assert run(listings(spark, 59)) == 1  # 19 new listings
    assert run(listings(spark, 60)) == 2  # 20 new listings
    assert run(listings(spark, 60)) == 2 and trained == [40, 60]
    rows = lifecycle.saved_versions(spark, root).orderBy("version").collect()
    assert [(r["version"], r["last_id"]) for r in rows] == [(1, 39), (2, 59)]

    def broken(path):
        raise OSError("damaged")

    assert lifecycle.load_or_train(spark, listings(spark, 60), root, train, broken, 20)[1] == 3


@pytest.mark.parametrize("new,retrain", [(99, False), (100, True)])
def test_retrain_threshold(spark, new, retrain):
    trained = lifecycle.last_id(spark.range(1, 11))
    row = lifecycle.retrain_check(spark.range(1, 11 + new), trained).first()
    assert (row["last_id"], row["new_listings"], row["retrain"]) == (10, new, retrain)


def test_everything_is_new_without_a_trained_id(spark):
    row = lifecycle.retrain_check(spark.range(5), lifecycle.last_id(spark.range(0)), 5).first()
    assert (row["last_id"], row["new_listings"], row["retrain"]) == (None, 5, True)


def test_prediction_is_the_product_of_the_factors(spark, ratings, als):
    scored = recommend.pair_scores(als, ratings.select("user_id", "annonce_id")).collect()
    user, item = factors(als)
    assert len(scored) == ratings.count()
    for r in scored:
        assert r["prediction"] == pytest.approx(user[r["user_id"]] @ item[r["annonce_id"]], abs=1e-4)


def test_unknown_users_and_listings_get_no_score(spark, als):
    pairs = spark.createDataFrame([(0, 0), (0, 999), (999, 0), (2 ** 40, 1)], "user_id long, annonce_id long")
    assert [(r["user_id"], r["annonce_id"]) for r in recommend.pair_scores(als, pairs).collect()] == [(0, 0)]


def test_cold_start_survives_saving(spark, als):
    path = scratch_path(spark, "als")
    als.write().overwrite().save(path)
    loaded = recommend.Recommender.load(spark, path)
    assert loaded.model.getColdStartStrategy() == "drop"
    pairs = spark.createDataFrame([(0, 0), (0, 999)], "user_id long, annonce_id long")
    assert recommend.pair_scores(loaded, pairs).count() == 1


def test_recommendations_are_ranked(spark, ratings, als):
    rows = recommend.user_recommendations(als, 5).orderBy("user_id", "rank").collect()
    assert len(rows) == 5 * ratings.select("user_id").distinct().count()
    for before, after in zip(rows, rows[1:]):
        assert before["user_id"] != after["user_id"] or before["rating"] >= after["rating"]
    unseen = recommend.unseen_only(recommend.user_recommendations(als, 12), ratings)
    assert unseen.join(ratings, ["user_id", "annonce_id"]).count() == 0


def test_targets_equal_the_cross_join_form(spark, als):
    """The best users of each list, by scoring every user with every similar listing."""
    similar = spark.createDataFrame([(1, [0, 1, 2]), (2, [2, 0, 1]), (3, [5]), (4, []), (5, [7, 999])], "announce_id long, similar_ids array<long>")
    user, item = factors(als)
    found = {}
    for r in hybrid.targets_by_model(similar, als, 4).orderBy("announce_id", "rank").collect():
        found.setdefault(r["announce_id"], []).append(r["user_id"])
    for announce, ids in ((1, [0, 1, 2]), (2, [0, 1, 2]), (3, [5]), (5, [7])):
        score = {u: max(float(f @ item[i]) for i in ids) for u, f in user.items()}
        assert found[announce] == sorted(score, key=lambda u: -score[u])[:4]
    assert 4 not in found


def test_observed_targets(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    made = spark.createDataFrame(
        [(1, 10, 0.2), (1, 11, 0.9), (2, 10, 0.5), (3, 10, 0.5), (3, 12, 99.0), (9, 10, 5.0), (2, 11, float("nan")), (1, 10, None)],
        "user_id long, annonce_id long, interaction_score double",
    )
    similar = spark.createDataFrame([(7, [10, 11]), (8, [11, 10]), (9, [12])], "announce_id long, similar_ids array<long>")
    rows = [(r["announce_id"], r["rank"], r["user_id"]) for r in hybrid.targets_by_observed(similar, made, users, 2).collect()]
    assert sorted(rows) == [(7, 1, 1), (7, 2, 2), (8, 1, 1), (8, 2, 2), (9, 1, 3)]


def test_observed_targets_equal_brute_force_with_a_hot_listing(spark):
    rng = np.random.default_rng(3)
    made = [(int(u), 0 if rng.random() < 0.35 else int(rng.integers(1, 15)), float(rng.integers(1, 9))) for u in rng.integers(0, 40, 600)]
    lists = {a: sorted({int(x) for x in rng.integers(0, 15, 4)}) if a % 3 else [0, 1] for a in range(30)}
    similar = spark.createDataFrame(list(lists.items()), "announce_id long, similar_ids array<long>")
    users = spark.range(35)
    got = {}
    frame = spark.createDataFrame(made, "user_id long, annonce_id long, interaction_score double")
    for r in hybrid.targets_by_observed(similar, frame, users, 6).orderBy("announce_id", "rank").collect():
        got.setdefault(r["announce_id"], []).append(r["user_id"])
    mean = {}
    for u, i, s in made:
        mean.setdefault((u, i), []).append(s)
    mean = {key: float(np.sum(v)) / len(v) for key, v in mean.items()}
    for announce, ids in lists.items():
        score = {u: max(mean[u, i] for i in ids if (u, i) in mean) for u in range(35) if any((u, i) in mean for i in ids)}
        assert got.get(announce, []) == sorted(score, key=lambda u: (-score[u], u))[:6]


def test_nobody_is_notified_twice(spark):
    schema = "announce_id long, user_id long"
    wanted = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], schema)
    sent = spark.createDataFrame([(1, 1), (1, 1), (3, 3)], schema)
    assert sorted(map(tuple, targeting.not_yet_sent(wanted, sent).collect())) == [(1, 2), (2, 1)]


def test_training_rows_are_spread_by_their_number(spark, monkeypatch):
    """One small file is one partition; K-Means would keep all its vectors in one task."""
    seen, fit = [], features.Pipeline.fit
    sizes = lambda rows: sorted(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())
    monkeypatch.setattr(features, "PART_ROWS", 10)
    monkeypatch.setattr(features.Pipeline, "fit", lambda self, rows: seen.append(sizes(rows)) or fit(self, rows))
    rows = listings(spark).coalesce(1)
    features.fit_features(rows)
    assert sum(seen[0]) == rows.count() and max(seen[0]) <= 20
