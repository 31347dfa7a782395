import pytest
from pyspark.sql import functions as F

from nearhome.functions.scores import interaction_weight
from nearhome.operators import numbering, prepare, quality


def listings(spark, rows):
    return spark.createDataFrame(rows, "id long, prix double, type_bien string, lease_duration string, latitude double, longitude double")


def test_incomplete_listings_are_dropped(spark):
    df = listings(spark, [
        (1, None, "A", "M", 1.0, 2.0),
        (2, 5.0, "A", "M", float("nan"), 2.0),
        (3, 5.0, "A", None, 1.0, 2.0),
        (4, 5.0, "A", "M", 1.0, 2.0),
    ])
    assert [r["id"] for r in prepare.complete_listings(df).collect()] == [4]
    older = prepare.complete_listings(df, ["prix", "type_bien", "latitude", "longitude"])
    assert sorted(r["id"] for r in older.collect()) == [3, 4]


def test_cardinality_of_categories(spark):
    df = listings(spark, [(1, 1.0, "HOUSE", "M", 0.0, 0.0), (2, 1.0, "HOUSE", "D", 0.0, 0.0), (3, 1.0, "HOUSE", None, 0.0, 0.0)])
    rows = {r["column_name"]: (r["n_values"], r["in_model"]) for r in prepare.category_cardinality(df, ["type_bien", "lease_duration"]).collect()}
    assert rows == {"type_bien": (1, False), "lease_duration": (2, True)}


def test_mean_of_repeated_interactions(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 1, 3.0), (1, 2, 0.5), (2, 1, None)], "user_id long, annonce_id long, interaction_score double")
    rows = {(r[0], r[1]): r[2] for r in prepare.rating_matrix(df).collect()}
    assert rows == {(1, 1): 2.0, (1, 2): 0.5, (2, 1): None}


def test_weights_by_type(spark):
    df = spark.createDataFrame([("VIEW",), ("favorite",), ("MESSAGE",), ("OTHER",), (None,)], "t string")
    assert [r[0] for r in df.select(interaction_weight(F.col("t"))).collect()] == [1.0, 3.0, 5.0, 0.0, 0.0]


def test_als_input_counts_what_does_not_fit(spark):
    wide = 2 ** 31
    df = spark.createDataFrame(
        [(1, 1, 1.0), (wide, 1, 1.0), (1, wide, 1.0), (1, 2, None), (2, 2, float("nan"))],
        "user_id long, annonce_id long, interaction_score double",
    )
    kept = prepare.usable_ratings(df)
    assert sorted((r["user_id"], r["annonce_id"]) for r in kept.collect()) == [(1, 1), (1, wide), (wide, 1)]
    assert prepare.als_rejects(df).first().asDict() == {
        "n_ratings": 5, "user_out_of_range": 1, "listing_out_of_range": 1, "no_score": 2,
    }


def test_audit_counts_each_kind(spark):
    users = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "bob"), (4, None)], "id long, username string")
    made = spark.createDataFrame(
        [(1, 1, "VIEW", 0.5), (2, 9, "VIEW", 0.5), (3, 9, "SAVE", 0.5), (4, 1, "BAD", 0.5), (5, 2, "SAVE", None), (6, None, None, 0.1)],
        "id long, user_id long, kind string, score double",
    )
    found = quality.audit(
        quality.row_rules(made, {
            "score missing": quality.missing("score"),
            "kind outside": quality.outside("kind", ["VIEW", "SAVE"]),
        }),
        quality.duplicate_keys(users, "username", "username duplicate"),
        quality.orphans(made, "user_id", users, "id", "user orphan"),
        quality.orphans(users, "id", users, "id", "no orphan"),
    )
    assert {r["rule"]: r["violations"] for r in found.collect()} == {
        "score missing": 1, "kind outside": 1, "username duplicate": 1, "user orphan": 2, "no orphan": 0,
    }


def test_rating_means_are_independent_of_order(spark):
    scores = [0.1, 0.2, 0.3, 1e-3, 7.25]
    schema = "user_id long, annonce_id long, interaction_score double"
    one = spark.createDataFrame([(1, 1, s) for s in scores], schema)
    other = spark.createDataFrame([(1, 1, s) for s in reversed(scores)], schema).repartition(3)
    assert prepare.rating_matrix(one).first()[2] == prepare.rating_matrix(other).first()[2] == pytest.approx(sum(scores) / 5, abs=1e-6)


def test_means_keep_what_rounding_would_cut(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.5000004), (2, 1, 0.5), (2, 1, 0.5), (3, 1, float("inf")), (4, 1, None)], "user_id long, annonce_id long, interaction_score double")
    found = {r[0]: r[2] for r in prepare.rating_matrix(df).collect()}
    assert found[1] > found[2] == 0.5 and found[3] != found[3] and found[4] is None


def test_declared_types_have_weights(spark):
    df = spark.createDataFrame([(1, "view", 0.3), (2, "SAVE", 0.3), (3, "CONTACT", 0.3), (4, "RATING", 0.25), (5, "FAVORITE", 0.3), (6, "MESSAGE", 0.3), (7, "other", 0.3)], "user_id long, interaction_type string, interaction_score double")
    found = prepare.weighted_rating_matrix(df.withColumn("annonce_id", F.lit(1)))
    assert {r[0]: r[2] for r in found.collect()} == {1: 1.0, 2: 3.0, 3: 5.0, 4: 0.25, 5: 3.0, 6: 5.0, 7: 0.0}


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_numbers_are_consecutive(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 1009).alias("x")).repartition(5)
    found = numbering.numbered(df, [F.col("x").desc()], "no").orderBy("no").collect()
    assert [r["no"] for r in found] == list(range(n)) and [r["x"] for r in found] == sorted((r["x"] for r in found), reverse=True)
