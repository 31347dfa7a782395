"""The three jobs a marketplace runs: similar listings on a stream, users to notify, recommendations for everyone.

``tables`` is a ``DatabaseTables`` or ``FolderTables``. Failures are raised, so a scheduler sees them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearhome.operators import cosine, features, lifecycle, neighbors, prepare, recommend, store, targeting
from nearhome.plans import hybrid
from nearhome.schemas import LISTINGS_PER_USER, NEIGHBOURS, RETRAIN_AFTER, USERS_PER_LISTING
from nearhome.session import scratch_kept, scratch_scope, written
from nearhome.sources import versioned
from nearhome.streaming import latest, similarity


def prepare_similarity(spark: SparkSession, tables, root: str, threshold: int = RETRAIN_AFTER, k: int = NEIGHBOURS) -> int:
    """Trains the cluster model where needed and publishes the cluster heads of the current catalogue."""
    catalogue = tables.read("annonce", key="id")
    listings = prepare.complete_listings(catalogue)
    model, version = lifecycle.load_or_train(
        spark, listings, f"{root}/clusters", features.fit_features, features.FeatureModel.load, threshold, catalogue=catalogue,
    )
    scored = features.scored_listings(model, listings)
    heads = neighbors.cluster_heads(scored, "prediction", k).withColumn("model_version", F.lit(version))
    return versioned.publish(heads, f"{root}/heads")


def similarity_stream(
    spark: SparkSession,
    tables,
    messages: DataFrame,
    sink: similarity.Sink,
    root: str,
    checkpoint: str,
    k: int = NEIGHBOURS,
    **options,
) -> StreamingQuery:
    """Answers new listing ids for as long as the query runs.

    Every batch uses the heads that ``prepare_similarity`` published last, and the model they were made with, so
    a new model or catalogue takes effect without a restart.
    """
    loaded: dict = {}

    def answer(ids: DataFrame) -> DataFrame:
        published = versioned.current(spark, f"{root}/heads")
        if loaded.get("published") != published:
            heads = spark.read.parquet(published[1])
            version = heads.agg(F.max("model_version")).first()[0]
            paths = lifecycle.saved_versions(spark, f"{root}/clusters").filter(F.col("version") == version)
            model = features.FeatureModel.load(paths.first()["path"])
            loaded.update(published=published, heads=heads.drop("model_version"), model=model)
        return similarity.model_answer(tables.read("annonce", key="id"), loaded["model"], loaded["heads"], k)(ids)

    return similarity.start_similarity(messages, answer, sink, checkpoint, **options)


def cosine_stream(
    spark: SparkSession, tables, messages: DataFrame, sink: similarity.Sink, root: str, checkpoint: str, k: int = NEIGHBOURS, **options,
) -> StreamingQuery:
    """Answers listing ids in the field ``id`` with the nearest listings by cosine and their mean similarity.

    When ``prepare_similarity`` has published a catalogue with the same model and only new listings, these are added to the index;
    otherwise features and index are made anew.
    """
    loaded: dict = {}

    def answer(ids: DataFrame) -> DataFrame:
        published = versioned.current(spark, f"{root}/heads")
        if loaded.get("published") != published:
            newest = lifecycle.saved_versions(spark, f"{root}/clusters").orderBy(F.col("version").desc()).first()
            with scratch_kept():
                listings = prepare.complete_listings(tables.read("annonce", key="id"))
                scored = features.scored_listings(features.FeatureModel.load(newest["path"]), listings)
                vectors = written(similarity.ordered_by_id(features.feature_arrays(scored)), "listing-vectors")
                before = loaded.get("vectors") if loaded.get("model") == newest["path"] else None
                index = catalogue_index(vectors, before, loaded.get("index"), k)
            loaded.update(published=published, model=newest["path"], vectors=vectors, index=index)
            loaded["answer"] = similarity.cosine_answer(vectors, k, index)
        return loaded["answer"](ids)

    return similarity.start_similarity(messages, answer, sink, checkpoint, field="id", **options)


def catalogue_index(vectors: DataFrame, before: DataFrame | None, index: cosine.CosineIndex | None, k: int) -> cosine.CosineIndex:
    """``index``, made of the vectors ``before``, with those that have come since; a new one where vectors have changed or left."""
    if before is not None and index is not None:
        known = before.join(vectors.select("id", F.col("vec").alias("now")), "id", "left")
        if known.filter(~F.coalesce(F.col("vec") == F.col("now"), F.lit(False))).isEmpty():
            grown = index.added(vectors.join(before.select("id"), "id", "left_anti"))
            if not grown.outgrown():
                return grown
    return cosine.build_index(vectors, k)


def train_recommender(spark: SparkSession, tables, root: str, by_type: bool = False) -> tuple[recommend.Recommender, int]:
    """Fits ALS on the ratings of known users and saves it as the next version; ``by_type`` scores by the type of interaction."""
    interactions = tables.read("user_interaction", key="id")
    matrix = prepare.weighted_rating_matrix(interactions) if by_type else prepare.rating_matrix(interactions)
    ratings = written(targeting.known_user_ratings(matrix, tables.read("user", key="id")), "ratings")
    model = recommend.fit_als(ratings)
    newest = ratings.agg(F.max("annonce_id")).first()[0]
    return model, lifecycle.save_model(spark, model, f"{root}/als", newest)


def recommend_all(spark: SparkSession, tables, root: str, n: int = LISTINGS_PER_USER, by_type: bool = False) -> int:
    """Trains and replaces ``user_recommendations``; the old rows stay until the new ones are computed."""
    model, version = train_recommender(spark, tables, root, by_type)
    best = written(recommend.user_recommendations(model, n).select("user_id", "annonce_id", "rating"), "recommendations")
    tables.replace(best, "user_recommendations")
    return version


QUEUE, DONE, SENT = "similar_announces", "processed_announces", "to_announce_notifications"


def pending_results(tables) -> DataFrame | None:
    """What ``notify`` would work on, or None before the first result."""
    if not tables.exists(QUEUE):
        return None
    done = tables.read(DONE, key="announceId") if tables.exists(DONE) else None
    return store.pending(tables.read(QUEUE, key="announceId"), done)


def notify(spark: SparkSession, tables, root: str, n: int = USERS_PER_LISTING) -> int:
    """Notifies the best users of every pending listing once; returns how many pairs.

    Nothing is replaced: pairs and processed listings are appended, so results that arrive meanwhile stay pending. A run
    that fails can be repeated: pairs already written are left out.
    """
    queue = pending_results(tables)
    if queue is None:
        return 0
    queue = written(queue, "queue")
    similar = store.from_csv_table(queue)
    newest = lifecycle.saved_versions(spark, f"{root}/als").orderBy(F.col("version").desc()).first()
    targets = targeting.notifications(hybrid.targets_by_model(similar, recommend.Recommender.load(spark, newest["path"]), n))
    if tables.exists(SENT):
        # only the part of the ledger that can matter is read
        ids = queue.select(F.col("announceId").alias("id"))
        ledger = tables.read(SENT, key="announce_id").withColumnRenamed("announce_id", "id")
        targets = targeting.not_yet_sent(targets, similarity.rows_of(ids, ledger).withColumnRenamed("id", "announce_id"))
    fresh = written(targets, "notifications")
    tables.append(fresh, SENT)
    tables.append(queue.select("announceId", "version"), DONE)
    return fresh.count()


def store_results(tables, results: DataFrame, version: int, repeated: bool = False) -> None:
    """Appends results of (id, similar_ids) to the queue; of several for a listing the highest version counts.

    With ``repeated`` the rows that an earlier attempt has appended under the same version are left out.
    """
    rows = store.queue_rows(results, version)
    if repeated and tables.exists(QUEUE):
        there = tables.read(QUEUE, key="announceId").filter(F.col("version") == version).select("announceId")
        rows = written(rows.join(there, "announceId", "left_anti"), "queue-rows")
    tables.append(rows, QUEUE)


EPOCHS = "result_epochs"


def checkpoint_epoch(spark: SparkSession, tables, checkpoint: str) -> int:
    """The epoch of a checkpoint: above all others when it is first used, and the same whenever its query starts again.

    A checkpoint is known by the id that Spark gives its query and keeps there, so one made anew under an old path is a new one.
    One writer at a time gives out epochs.
    """
    metadata = spark.read.text(f"{checkpoint}/metadata")
    query = metadata.select(F.get_json_object("value", "$.id")).first()[0]
    known = tables.read(EPOCHS, key="epoch") if tables.exists(EPOCHS) else None
    found = known.filter(F.col("query") == query).agg(F.max("epoch")).first()[0] if known is not None else None
    if found is None:
        found = store.next_epoch(known, tables.read(QUEUE, key="announceId") if tables.exists(QUEUE) else None)
        tables.append(spark.createDataFrame([(query, found)], "query string, epoch long").coalesce(1), EPOCHS)
    return found


def store_stream(tables, messages: DataFrame, checkpoint: str, **options) -> StreamingQuery:
    """Appends the results that arrive as messages to the queue, for as long as the query runs.

    Versions grow with the batches and, across checkpoints, with the epochs, so what a new checkpoint stores comes after all
    that older ones stored and becomes pending again. Only the first batch of a run can be a repeated one. Of several results
    for a listing in a batch the last one counts, by the message's timestamp and offset where the source has them.
    """
    order = [c for c in ("timestamp", "offset") if c in messages.columns]
    state: dict = {}

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        repeated = not state
        if repeated:
            state["epoch"] = checkpoint_epoch(spark, tables, checkpoint)
        results = store.one_per_listing(store.from_messages(batch, *order), order)
        with scratch_scope(spark):
            store_results(tables, results, store.version_of(state["epoch"], batch_id), repeated)

    return similarity.start_batches(messages.select("value", *order), process, checkpoint, **options)


def latest_stream(messages: DataFrame, sink: similarity.Sink, checkpoint: str, **options) -> StreamingQuery:
    """Hands on the result of a listing whenever it changes, for as long as the query runs; see ``latest.change_batches``."""
    return similarity.start_batches(messages, latest.change_batches(sink, f"{checkpoint}/results"), checkpoint, **options)
