"""The registered queries. Each one takes a session and a folder of the provided tables and reads them whole."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearhome.functions.codecs import ids_to_csv, json_field
from nearhome.functions.vectors import cosine as cosine_of
from nearhome.functions.vectors import l2_norm
from nearhome.operators import approx, cosine, decay, features, head_state, inner_product, lifecycle, neighbors, prepare, quality, rating_store, recommend, searches, store, synth, targeting
from nearhome.plans import hybrid, jobs
from nearhome.schemas import ALS_REG, FEATURE_COLUMNS_OLD, LISTINGS_PER_USER
from nearhome.session import scratch_kept, scratch_path, scratch_scope, ship_package, shuffles_removed, written
from nearhome.sources import fixtures, versioned
from nearhome.sources.tables import FolderTables
from nearhome.streaming import similarity

Query = Callable[[SparkSession, str], DataFrame]

EVENT_WEIGHTS = {"view": 1.0, "click": 3.0, "purchase": 5.0}
EVENT_TYPES = ["view", "click", "purchase", "signup", "error"]

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return run


# --- listings and ratings ---

@query
def listing_clean(spark, sf):
    clean = prepare.complete_listings(fixtures.listing_dirty(spark, sf))
    return clean.select("id", "prix", "type_bien", "lease_duration", "latitude", "longitude")


@query
def category_cardinality(spark, sf):
    return prepare.category_cardinality(fixtures.listing(spark, sf), ["type_bien", "lease_duration"])


@query
def rating_avg(spark, sf):
    return prepare.rating_matrix(fixtures.interaction(spark, sf))


@query
def rating_weighted(spark, sf):
    return prepare.weighted_rating_matrix(fixtures.interaction(spark, sf), EVENT_WEIGHTS)


@query
def rating_declared(spark, sf):
    """The events under the declared type names, scored by the default weights; ratings keep their own score."""
    return prepare.weighted_rating_matrix(fixtures.interaction_declared(spark, sf))


@query
def rating_purchases(spark, sf):
    return prepare.rating_matrix(fixtures.purchase(spark, sf))


@query
def rating_incremental(spark, sf):
    """The events arrive by type, as batches; two are merged into a base before the others come, and one comes twice."""
    root, events = scratch_path(spark, "rating-store"), fixtures.interaction(spark, sf)
    for batch, kind in enumerate(EVENT_TYPES):
        rating_store.fold(events.filter(F.col("interaction_type") == kind), root, batch)
        if batch == 1:
            rating_store.compact(spark, root)
    rating_store.fold(events.filter(F.col("interaction_type") == EVENT_TYPES[-1]), root, len(EVENT_TYPES) - 1)
    rating_store.fold(events.filter(F.coalesce(~F.col("interaction_type").isin(EVENT_TYPES), F.lit(True))), root, len(EVENT_TYPES))
    return rating_store.ratings(spark, root)


@query
def rating_decayed(spark, sf):
    """Scores at a fixed day, from one state a type of event."""
    events = fixtures.interaction(spark, sf)
    states = [decay.decay_state(events.filter(F.col("interaction_type") == kind)) for kind in EVENT_TYPES]
    states.append(decay.decay_state(events.filter(F.coalesce(~F.col("interaction_type").isin(EVENT_TYPES), F.lit(True)))))
    whole = states[0]
    for state in states[1:]:
        whole = whole.unionByName(state)
    scores = decay.decayed_scores(decay.merged_decay(whole), date(2024, 3, 1))
    return scores.select("user_id", "annonce_id", F.round("decayed", 10).alias("decayed"), F.round("interaction_score", 7).alias("interaction_score"))


@query
def message_ids(spark, sf):
    """The listing named in the JSON payload of every event."""
    return fixtures.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), json_field(F.col("props").cast("binary"), "k").try_cast("long").alias("annonce_id"),
    )


@query
def rating_rejects(spark, sf):
    return prepare.als_rejects(fixtures.interaction_dirty(spark, sf))


# --- features and clusters ---

@query
def category_index(spark, sf):
    indexed = features.category_indices(fixtures.listing(spark, sf), features.CATEGORIES)
    return indexed.select("column_name", "value", F.col("idx").cast("int").alias("idx"), "n")


@query
def feature_vectors(spark, sf):
    listings = fixtures.listing(spark, sf)
    model = features.fit_features(listings, clusters=None)
    vectors = features.feature_arrays(features.scored_listings(model, listings))
    return vectors.select("id", F.posexplode("vec").alias("pos", "value")).withColumn("value", F.round("value", 9))


@query
def kmeans_cluster_summary(spark, sf):
    listings = fixtures.listing(spark, sf)
    model = features.fit_features(listings)
    placed = features.centre_distances(model, features.scored_listings(model, listings))
    return placed.agg(
        F.count("*").alias("n_listings"),
        (F.count_distinct("prediction") <= 10).alias("clusters_ok"),
        F.count_if(F.col("own") > F.col("nearest") + 1e-9).alias("misplaced"),
    )


@query
def kmeans_neighbors_summary(spark, sf):
    listings = fixtures.listing(spark, sf)
    model = features.fit_features(listings)
    scored = written(features.scored_listings(model, listings).select("id", "prix", "prediction"), "scored")
    found = neighbors.price_neighbors(scored, "prediction")
    sizes = scored.groupBy("prediction").agg(F.count("*").alias("members"))
    lengths = found.join(sizes, found["cluster"] == sizes["prediction"]).select(
        (F.size("similar_ids") != F.least(F.lit(10), F.col("members") - 1)).alias("wrong_length"),
    )
    pairs = neighbors.neighbor_pairs(found).join(
        scored.select(F.col("id").alias("similar_id"), F.col("prediction").alias("similar_cluster"), "prix"), "similar_id",
    ).join(scored.select("id", "prediction"), "id")
    by_rank = Window.partitionBy("id").orderBy("rank")
    checked = pairs.withColumn("before", F.lag("prix").over(by_rank)).agg(
        F.count_if(F.col("similar_cluster") != F.col("prediction")).alias("other_cluster"),
        F.count_if(F.col("similar_id") == F.col("id")).alias("self_pairs"),
        F.count_if(F.col("before") > F.col("prix")).alias("out_of_order"),
    )
    total = lengths.agg(F.count("*").alias("n_listings"), F.count_if("wrong_length").alias("wrong_length"))
    return checked.select(
        total.select("n_listings").scalar().alias("n_listings"),
        total.select("wrong_length").scalar().alias("wrong_length"),
        "other_cluster", "self_pairs", "out_of_order",
    )


@query
def kmeans_cost(spark, sf):
    """The cost of a single cluster, and whether the trained clusters cost less than half of it."""
    listings = fixtures.listing(spark, sf)
    model = features.fit_features(listings)
    scored = written(features.scored_listings(model, listings), "scored")
    cost = features.centre_distances(model, scored).agg(F.sum("own")).scalar()
    sums = features.feature_arrays(scored).select(F.posexplode("vec").alias("pos", "value")).groupBy("pos").agg(
        F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.count("*").alias("n"))
    one = sums.agg(F.max("n").alias("n_listings"), F.sum(F.col("squares") - F.col("total") * F.col("total") / F.col("n")).alias("one"))
    return one.select("n_listings", F.round("one", 3).alias("one_cluster_cost"), (cost < F.col("one") / 2).alias("better"))


# --- neighbours ---

def _brand_neighbors(spark, sf):
    return neighbors.price_neighbors(fixtures.listing(spark, sf), "lease_duration")


@query
def cluster_neighbors_price(spark, sf):
    return neighbors.neighbor_pairs(_brand_neighbors(spark, sf))


@query
def heads_incremental(spark, sf):
    """The cheapest of every type, kept up to date: listings nobody interacted with are there first, the others come, and at last
    those leave of which somebody bought 49 or more at once."""
    listings = fixtures.listing(spark, sf).select("id", F.col("type_bien").alias("cluster"), "prix")
    known = fixtures.interaction(spark, sf).select(F.col("annonce_id").alias("id")).distinct()
    sold = fixtures.purchase(spark, sf).filter(F.col("interaction_score") >= 49).select(F.col("annonce_id").alias("id")).distinct()
    state = written(head_state.head_state(listings.join(known, "id", "left_anti"), "cluster"), "heads")
    state = written(head_state.updated(state, listings.join(known, "id", "left_semi")), "heads")
    state = written(head_state.updated(state, sold.select("id", F.lit(None).cast("string").alias("cluster"), F.lit(None).cast("double").alias("prix"))), "heads")
    left = listings.join(sold, "id", "left_anti")
    return head_state.heads(head_state.refilled(state, left, "cluster")).select("cluster", ids_to_csv(F.col("head")).alias("head"))


@query
def type_neighbors_price(spark, sf):
    return neighbors.neighbor_pairs(neighbors.price_neighbors(fixtures.listing(spark, sf), "type_bien"))


@query
def vector_functions(spark, sf):
    """Length of every vector, and its cosine with the vector that has the next id."""
    vectors = fixtures.vector(spark, sf)
    following = vectors.select((F.col("id") - 1).alias("id"), F.col("vec").alias("next_vec"))
    return vectors.join(following, "id", "left").select(
        "id", F.round(l2_norm(F.col("vec")), 9).alias("norm"), F.round(cosine_of(F.col("vec"), F.col("next_vec")), 9).alias("similarity"),
    )


@query
def cluster_neighbors_cosine(spark, sf):
    return cosine.cosine_top_k(fixtures.vector(spark, sf), group="cluster")


@query
def cosine_topk(spark, sf):
    return cosine.cosine_top_k(fixtures.vector(spark, sf).select("id", "vec"))


@query
def cosine_incremental(spark, sf):
    """The vectors come label by label, as deltas of an index over those of the first labels."""
    vectors = fixtures.vector(spark, sf)
    label = F.dense_rank().over(Window.orderBy("cluster"))
    labels = vectors.select("cluster").distinct().select("cluster", F.pmod(label, F.lit(4)).alias("turn"))
    dealt = written(vectors.join(labels, "cluster", "left").select("id", "vec", F.coalesce("turn", F.lit(0)).alias("turn")), "cosine-dealt")
    index = cosine.build_index(dealt.filter("turn = 0").select("id", "vec"))
    for turn in (1, 2, 3):
        index = index.added(dealt.filter(F.col("turn") == turn).select("id", "vec"))
    return index.search(dealt.select("id", "vec"))


@query
def cosine_approx(spark, sf):
    """Whether approximate neighbours hold nine tenths of the exact ones, and whether every similarity is right."""
    vectors = fixtures.vector(spark, sf).select("id", "vec")
    exact = written(cosine.cosine_top_k(vectors), "approx-exact")
    found = written(approx.approximate_top_k(vectors, bucket_rows=32), "approx-found")
    same = found.join(vectors, "id").join(vectors.select(F.col("id").alias("similar_id"), F.col("vec").alias("other")), "similar_id")
    wrong = same.agg(F.count_if(F.abs(F.col("similarity") - cosine_of(F.col("vec"), F.col("other"))) > 1e-8)).scalar()
    hit = exact.join(found.select("id", "similar_id"), ["id", "similar_id"], "left_semi").agg(F.count("*")).scalar()
    return exact.agg(F.count("*").alias("n_exact")).select("n_exact", (hit >= 0.9 * F.col("n_exact")).alias("recall_ok"), wrong.alias("wrong"))


@query
def cosine_topk_avg(spark, sf):
    vectors = fixtures.vector(spark, sf).select("id", "vec")
    means = cosine.mean_similarity(vectors, cosine.cosine_top_k(vectors))
    return means.select("id", F.size("similar_ids").alias("n_similar"), F.round("similarity", 10).alias("similarity"))


def _old_features(spark, sf):
    """The older feature set: price, type, latitude, longitude."""
    listings = prepare.complete_listings(fixtures.listing(spark, sf), FEATURE_COLUMNS_OLD)
    model = features.fit_features(listings, categories=["type_bien"], clusters=None, order=FEATURE_COLUMNS_OLD)
    return listings, features.feature_arrays(features.scored_listings(model, listings))


@query
def listing_cosine_topk(spark, sf):
    return cosine.cosine_top_k(_old_features(spark, sf)[1])


@query
def listing_cosine_real_prices(spark, sf):
    """Prices from ten thousand up, as a marketplace has them; the neighbours then differ in the last digits of the cosine."""
    real = (F.col("prix") - 900) * 260 + 10_000
    listings = prepare.complete_listings(fixtures.listing(spark, sf).withColumn("prix", real), FEATURE_COLUMNS_OLD)
    model = features.fit_features(listings, categories=["type_bien"], clusters=None, order=FEATURE_COLUMNS_OLD)
    return cosine.cosine_top_k(features.feature_arrays(features.scored_listings(model, listings)))


@query
def listing_cluster_cosine(spark, sf):
    listings, vectors = _old_features(spark, sf)
    grouped = vectors.join(listings.select("id", F.col("lease_duration").alias("cluster")), "id")
    return cosine.cosine_top_k(grouped, group="cluster")


# --- result store ---

@query
def similar_messages(spark, sf):
    return store.to_messages(_brand_neighbors(spark, sf)).select("value")


@query
def similar_json_roundtrip(spark, sf):
    found = store.from_messages(store.to_messages(_brand_neighbors(spark, sf)))
    return found.select("id", "cluster", F.posexplode("similar_ids").alias("pos", "similar_id"))


@query
def similar_csv(spark, sf):
    return store.to_csv_table(_brand_neighbors(spark, sf))


@query
def similar_pairs(spark, sf):
    parsed = store.from_csv_table(store.to_csv_table(_brand_neighbors(spark, sf)))
    return parsed.select("announce_id", F.explode("similar_ids").alias("similar_id"))


@query
def similar_latest(spark, sf):
    """Results computed twice, by type and then by brand: the later ones stay, published as the current version."""
    listings = fixtures.listing(spark, sf)
    first = neighbors.price_neighbors(listings, "type_bien").withColumn("version", F.lit(1))
    second = neighbors.price_neighbors(listings, "lease_duration").withColumn("version", F.lit(2))
    root = scratch_path(spark, "similar-store")
    versioned.publish(first, root)
    merged = store.latest_results(versioned.read_current(spark, root).unionByName(second), "version")
    versioned.publish(merged, root)
    return versioned.read_current(spark, root).select("id", "cluster", "version", ids_to_csv(F.col("similar_ids")).alias("similar_ids"))


@query
def queue_drain(spark, sf):
    queue = store.from_csv_table(store.to_csv_table(_brand_neighbors(spark, sf)))
    processed = fixtures.interaction(spark, sf).select(F.col("annonce_id").alias("announce_id"))
    return store.drain(queue, processed).select("announce_id", ids_to_csv(F.col("similar_ids")).alias("similar_ids"))


@query
def queue_concurrent(spark, sf):
    """Results stored after the queue was read and before its rows count as processed: they stay pending."""
    tables = FolderTables(spark, scratch_path(spark, "queue-tables"))
    jobs.store_results(tables, _brand_neighbors(spark, sf), 1)
    read = written(jobs.pending_results(tables), "queue-read")
    wanted = fixtures.interaction(spark, sf).select(F.col("annonce_id").alias("id")).distinct()
    jobs.store_results(tables, neighbors.price_neighbors(fixtures.listing(spark, sf), "type_bien", queries=fixtures.listing(spark, sf).join(wanted, "id", "left_semi")), 2)
    tables.append(read.select("announceId", "version"), jobs.DONE)
    return jobs.pending_results(tables).select(F.col("announceId").alias("announce_id"), F.col("similarsIds").alias("similar_ids"), "version")


@query
def queue_restart(spark, sf):
    """All listings are answered by brand and processed; a new checkpoint answers those of the events again, by type."""
    tables = FolderTables(spark, scratch_path(spark, "restart-tables"))

    def stored(results):
        path = scratch_path(spark, "restart-in")
        store.to_messages(results).select("value").write.text(path)
        jobs.store_stream(tables, spark.readStream.text(path), scratch_path(spark, "restart-checkpoint"), run_once=True).awaitTermination()

    stored(_brand_neighbors(spark, sf))
    tables.append(written(jobs.pending_results(tables), "restart-done").select("announceId", "version"), jobs.DONE)
    wanted = fixtures.interaction(spark, sf).select(F.col("annonce_id").alias("id")).distinct()
    listings = fixtures.listing(spark, sf)
    stored(neighbors.price_neighbors(listings, "type_bien", queries=listings.join(wanted, "id", "left_semi")))
    epoch = F.floor(F.col("version") / store.EPOCH)
    return jobs.pending_results(tables).select(F.col("announceId").alias("announce_id"), F.col("similarsIds").alias("similar_ids"), epoch.alias("epoch"))


# --- streaming ---

def _run_stream(spark, messages, answer, field):
    """Runs the stream over all waiting messages; the latest result per listing."""
    out = scratch_path(spark, "stream-out")
    stream = similarity.start_similarity(
        messages, answer, similarity.parquet_sink(out), scratch_path(spark, "stream-checkpoint"), field=field, run_once=True,
    )
    stream.awaitTermination()
    return store.latest_results(spark.read.parquet(out), "batch_id")


def _positions(results):
    return results.select("id", F.col("cluster").alias("cluster_id"), F.posexplode("similar_ids").alias("pos", "similar_id"))


def _inbox(spark, sf, ids, field):
    """The ids as JSON messages in text files, with an unknown id and a broken line per supplier."""
    suppliers = fixtures.table(spark, sf, "supplier").select("s_suppkey")
    unknown = suppliers.select((-1 - F.col("s_suppkey")).alias("id"))
    good = ids.unionByName(unknown).select(F.to_json(F.struct(F.col("id").alias(field))).alias("value"))
    broken = suppliers.select(F.concat(F.lit(f'{{"{field}": '), F.col("s_suppkey").cast("string")).alias("value"))
    path = scratch_path(spark, "stream-in")
    good.unionByName(broken).write.text(path)
    return spark.readStream.text(path)


@query
def stream_similar(spark, sf):
    """Every listing as a message, and once more for every order line that names it."""
    again = fixtures.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"))
    messages = _inbox(spark, sf, fixtures.listing(spark, sf).select("id").unionByName(again), "announceId")
    stored = written(similarity.ordered_by_id(_brand_neighbors(spark, sf)), "neighbors")
    return _positions(_run_stream(spark, messages, similarity.stored_answer(stored), "announceId"))


@query
def stream_similar_events(spark, sf):
    """The JSON payload of every event as a message that names a listing in the field ``k``."""
    schema = fixtures.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    stored = written(similarity.ordered_by_id(neighbors.price_neighbors(fixtures.listing(spark, sf), "type_bien")), "neighbors")
    return _positions(_run_stream(spark, events.select(F.col("props").alias("value")), similarity.stored_answer(stored), "k"))


@query
def stream_kmeans_summary(spark, sf):
    """Every listing as a message, placed by the trained pipeline; incomplete listings get no result."""
    listings = fixtures.listing_dirty(spark, sf)
    clean = prepare.complete_listings(listings)
    model = features.fit_features(clean)
    scored = written(features.scored_listings(model, clean).select("id", "prix", "prediction"), "scored")
    heads = written(neighbors.cluster_heads(scored, "prediction"), "cluster-heads")
    answer = similarity.model_answer(listings, model, heads)
    results = _run_stream(spark, _inbox(spark, sf, listings.select("id"), "announceId"), answer, "announceId")
    sizes = scored.groupBy(F.col("prediction").alias("cluster")).agg(F.count("*").alias("members"))
    same = results.join(scored, "id").join(sizes, "cluster")
    return same.agg(
        F.count("*").alias("n_results"),
        F.count_if(F.col("cluster") != F.col("prediction")).alias("other_cluster"),
        F.count_if(F.size("similar_ids") != F.least(F.lit(10), F.col("members") - 1)).alias("wrong_length"),
        F.count_if(F.array_contains("similar_ids", F.col("id"))).alias("self_pairs"),
    )


@query
def stream_cosine(spark, sf):
    """Every vector id as a message of the older kind; the answers travel as JSON messages."""
    vectors = fixtures.vector(spark, sf).select("id", "vec")
    results = _run_stream(spark, _inbox(spark, sf, vectors.select("id"), "id"), similarity.cosine_answer(vectors), "id")
    received = store.from_cosine_messages(store.to_cosine_messages(results))
    return received.select("id", ids_to_csv(F.col("similar_ids")).alias("similar_ids"), F.round("similarity", 10).alias("similarity"))


@query
def stream_latest(spark, sf):
    """Results by type (version 1) and by brand (version 2) as messages, in batches that repeat, replay and mix up the versions.

    What comes last out of the stream for a listing is what the store holds in the end; only changes come out.
    """
    listings = fixtures.listing(spark, sf)
    versions = {1: neighbors.price_neighbors(listings, "type_bien"), 2: neighbors.price_neighbors(listings, "lease_duration")}
    messages = {v: written(store.to_messages(r).select("value", F.lit(v).cast("long").alias("version")), "latest-messages") for v, r in versions.items()}
    odd = F.crc32("value") % 2 == 1
    batches = [
        messages[1].filter(odd), messages[2].filter(odd), messages[1].unionByName(messages[2].filter(odd)),
        messages[2].filter(~odd).unionByName(messages[1]), messages[1], messages[2],
    ]
    inbox, out, checkpoint = (scratch_path(spark, f"latest-{name}") for name in ("in", "out", "checkpoint"))
    for number, batch in enumerate(batches):  # read one after another, each by a run of the same stream
        batch.write.parquet(f"{inbox}/{number}")
        stream = spark.readStream.schema("value string, version long").option("recursiveFileLookup", True).parquet(inbox)
        jobs.latest_stream(stream, similarity.parquet_sink(out), checkpoint, run_once=True).awaitTermination()
    changes = spark.read.parquet(out)
    last = changes.groupBy("id").agg(F.max(F.struct("version", "cluster", "similars_ids")).alias("last"), F.count("*").alias("n"))
    return last.select("id", "last.cluster", F.col("last.similars_ids").alias("similar_ids"), (F.col("n") <= 2).alias("changes_only"))


# --- saved searches ---

@query
def search_matches(spark, sf):
    """How many listings match every saved search, the nearest and the farthest of them."""
    found = searches.search_totals(fixtures.listing(spark, sf), fixtures.saved_search(spark, sf))
    return found.select("search_id", "n_listings", "listings", F.round("nearest", 6).alias("nearest"), F.round("farthest", 6).alias("farthest"))


# --- users to notify ---

def _targets(spark, sf, interactions, cluster, n=1000):
    similar = hybrid.similar_lists(prepare.complete_listings(fixtures.listing(spark, sf)), cluster)
    return hybrid.targets_by_observed(similar, interactions, fixtures.user(spark, sf), n)


@query
def target_users_observed(spark, sf):
    return _targets(spark, sf, fixtures.interaction(spark, sf), "type_bien")


@query
def target_users_top10(spark, sf):
    return _targets(spark, sf, fixtures.interaction(spark, sf), "type_bien", n=10)


@query
def target_users_purchases(spark, sf):
    return _targets(spark, sf, fixtures.purchase(spark, sf), "lease_duration")


@query
def hybrid_notify(spark, sf):
    return hybrid.hybrid_notify(
        fixtures.listing_dirty(spark, sf), fixtures.purchase(spark, sf), fixtures.user(spark, sf), "lease_duration", exclude_seen=True,
    )


@query
def notify_unsent(spark, sf):
    candidates = targeting.notifications(_targets(spark, sf, fixtures.interaction(spark, sf), "type_bien"))
    sent = fixtures.interaction(spark, sf).select(F.col("annonce_id").alias("announce_id"), "user_id")
    return targeting.not_yet_sent(candidates, sent)


# --- collaborative filtering ---

_als_models: dict[tuple, object] = {}


def _als(spark, sf):
    """ALS on the ratings of known users, fitted once per application and folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _als_models:
        ratings = prepare.rating_matrix(fixtures.interaction(spark, sf))
        _als_models[key] = recommend.fit_als(targeting.known_user_ratings(ratings, fixtures.user(spark, sf)))
    return _als_models[key]


def forget_models() -> None:
    """Drops the fitted models, so that the next query trains again."""
    _als_models.clear()


WIDE = 2**40


def _als_wide(spark, sf):
    """The same model for ids beyond 32 bits."""
    key = (spark.sparkContext.applicationId, sf, "wide")
    if key not in _als_models:
        wide = fixtures.interaction(spark, sf).withColumns({c: F.col(c) + WIDE for c in ("user_id", "annonce_id")})
        users = fixtures.user(spark, sf).withColumn("id", F.col("id") + WIDE)
        _als_models[key] = recommend.fit_als(targeting.known_user_ratings(prepare.rating_matrix(wide), users))
    return _als_models[key]


@query
def als_solution(spark, sf):
    """Per user: the ratings, whether the factors solve the last half step, and predictions unlike the product of the factors.

    The half step asks that sum((prediction - rating) * listing factors) + regularisation * ratings * user factors is zero.
    """
    found = _als(spark, sf)
    ratings = prepare.usable_ratings(targeting.known_user_ratings(prepare.rating_matrix(fixtures.interaction(spark, sf)), fixtures.user(spark, sf)))
    users = found.model.userFactors.join(found.users, F.col("id") == F.col("user_no")).select("user_id", F.col("features").alias("x"))
    listings = found.model.itemFactors.join(found.listings, F.col("id") == F.col("listing_no")).select("annonce_id", F.col("features").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda total, v: total + v)
    rows = ratings.join(users, "user_id").join(listings, "annonce_id").withColumn("dot", dot)
    told = recommend.pair_scores(found, ratings.select("user_id", "annonce_id"))
    rows = rows.join(told, ["user_id", "annonce_id"], "left").withColumn("off", ~F.coalesce(F.abs(F.col("prediction") - F.col("dot")) < 1e-3, F.lit(False)))
    slope = F.zip_with("x", "y", lambda a, b: (F.col("dot") - F.col("interaction_score")) * b + ALS_REG * a)
    slopes = rows.select("user_id", "annonce_id", "off", F.posexplode(slope).alias("place", "slope"))
    sums = slopes.groupBy("user_id", "place").agg(F.sum("slope").alias("slope"), F.count("*").alias("n"), F.count_if("off").alias("n_off"))
    return sums.groupBy("user_id").agg(
        F.max("n").alias("n_ratings"), F.count("*").alias("rank"), (F.max(F.abs("slope") / F.col("n")) < 1e-3).alias("solved"), F.max("n_off").alias("n_off"),
    )


@query
def als_user_recs(spark, sf):
    return recommend.user_recommendations(_als(spark, sf))


def _als_purchases(spark, sf):
    """ALS on the purchases, which name every listing."""
    key = (spark.sparkContext.applicationId, sf, "purchases")
    if key not in _als_models:
        ratings = prepare.rating_matrix(fixtures.purchase(spark, sf))
        _als_models[key] = recommend.fit_als(targeting.known_user_ratings(ratings, fixtures.user(spark, sf)))
    return _als_models[key]


@query
def als_topn_exact(spark, sf):
    """Per user: how many listings are recommended, and at how many ranks the rating is not that of the best listings by comparing all."""
    found = _als_purchases(spark, sf)
    with scratch_scope(spark), shuffles_removed(spark):
        lists = recommend.user_lists(found)
        with scratch_kept():
            ours = written(lists, "als-lists")
    users, listings = recommend.factors(found)
    floor = F.when(F.size("ratings") == LISTINGS_PER_USER, F.array_min("ratings"))
    best = inner_product.all_scores(users.join(ours.select("user_id", floor.alias("floor")), "user_id", "left"), listings, LISTINGS_PER_USER)
    near = lambda x: F.abs(x["ratings"] - x["best"]) <= 1e-5 * F.greatest(F.lit(1.0), F.abs(x["best"]))
    off = F.filter(F.arrays_zip("ratings", "best"), lambda x: ~F.coalesce(near(x), F.lit(False)))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>")).alias(c)
    both = ours.join(best, "user_id", "full").select("user_id", none("listings", "long"), none("ratings", "float"), none("best", "double"))
    return both.select(
        "user_id", F.size("listings").cast("long").alias("n_recs"), F.size(F.array_distinct("listings")).cast("long").alias("n_listings"), F.size(off).cast("long").alias("n_off"),
    )


@query
def als_user_recs_summary(spark, sf):
    return _recs_summary(recommend.user_recommendations(_als(spark, sf)))


@query
def als_wide_user_recs_summary(spark, sf):
    recs = recommend.user_recommendations(_als_wide(spark, sf))
    return _recs_summary(recs).withColumn("user_id", F.col("user_id") - WIDE)


def _recs_summary(recs):
    before = F.lag("rating").over(Window.partitionBy("user_id").orderBy("rank"))
    return recs.withColumn("before", before).groupBy(F.col("user_id").cast("long").alias("user_id")).agg(
        F.count("*").alias("n_recs"),
        F.min("rank").alias("first_rank"),
        F.max("rank").alias("last_rank"),
        F.count_distinct("annonce_id").alias("n_listings"),
        F.count_if(F.col("before") < F.col("rating")).alias("out_of_order"),
    )


@query
def als_unseen_summary(spark, sf):
    """Recommendations left for every user without the listings they already know."""
    recs = recommend.user_recommendations(_als(spark, sf))
    unseen = recommend.unseen_only(recs, fixtures.interaction(spark, sf))
    return unseen.groupBy(F.col("user_id").cast("long").alias("user_id")).agg(F.count("*").alias("n_recs"))


@query
def als_pair_summary(spark, sf):
    """Purchased (user, listing) pairs scored by the model; pairs it does not know drop out."""
    return _pair_summary(recommend.pair_scores(_als(spark, sf), fixtures.purchase(spark, sf).select("user_id", "annonce_id").distinct()))


@query
def als_wide_pair_summary(spark, sf):
    pairs = fixtures.purchase(spark, sf).select((F.col("user_id") + WIDE).alias("user_id"), (F.col("annonce_id") + WIDE).alias("annonce_id"))
    return _pair_summary(recommend.pair_scores(_als_wide(spark, sf), pairs.distinct())).withColumn("annonce_id", F.col("annonce_id") - WIDE)


def _pair_summary(scored):
    return scored.groupBy(F.col("annonce_id").cast("long").alias("annonce_id")).agg(
        F.count("*").alias("n_pairs"), F.count_if(F.isnan("prediction")).alias("n_nan"),
    )


@query
def target_users_als_summary(spark, sf):
    similar = hybrid.similar_lists(fixtures.listing(spark, sf), "type_bien")
    targets = hybrid.targets_by_model(similar, _als(spark, sf))
    before = F.lag("score").over(Window.partitionBy("announce_id").orderBy("rank"))
    return targets.withColumn("before", before).groupBy("announce_id").agg(
        F.count("*").alias("n_users"),
        F.max("rank").alias("last_rank"),
        F.count_if(F.col("before") < F.col("score")).alias("out_of_order"),
    )


# --- models, audit, test tables ---

@query
def retrain_check(spark, sf):
    """Trained up to the last listing anybody interacted with."""
    trained = fixtures.interaction(spark, sf).select(F.col("annonce_id").alias("id"))
    return lifecycle.retrain_check(fixtures.listing(spark, sf), lifecycle.last_id(trained))


@query
def model_lifecycle(spark, sf):
    """The model is trained on the complete listings, then loaded again as it is still fresh, and scores the catalogue."""
    root = scratch_path(spark, "models")
    clean = prepare.complete_listings(fixtures.listing_dirty(spark, sf))
    lifecycle.load_or_train(spark, clean, root, features.fit_features, features.FeatureModel.load)
    model, version = lifecycle.load_or_train(spark, clean, root, features.fit_features, features.FeatureModel.load)
    scored = features.scored_listings(model, clean).agg(F.count("prediction").alias("n_scored"))
    versions = lifecycle.saved_versions(spark, root)
    return versions.filter(F.col("version") == version).select("version", "last_id", scored.scalar().alias("n_scored"))


@query
def constraint_audit(spark, sf):
    interactions, listings = fixtures.interaction_dirty(spark, sf), fixtures.listing_dirty(spark, sf)
    users = fixtures.user(spark, sf)
    return quality.audit(
        quality.row_rules(interactions, {
            "interaction.user_id missing": quality.missing("user_id"),
            "interaction.annonce_id missing": quality.missing("annonce_id"),
            "interaction.interaction_score missing": quality.missing("interaction_score"),
            "interaction.interaction_type outside": quality.outside("interaction_type", EVENT_TYPES),
        }),
        quality.row_rules(listings, {
            "listing.prix missing": quality.missing("prix"),
            "listing.type_bien missing": quality.missing("type_bien"),
        }),
        quality.duplicate_keys(users, "id", "user.id duplicate"),
        quality.duplicate_keys(users, "username", "user.username duplicate"),
        quality.duplicate_keys(listings, "prix", "listing.prix duplicate"),
        quality.orphans(interactions, "user_id", users, "id", "interaction.user_id orphan"),
        quality.orphans(interactions, "annonce_id", listings, "id", "interaction.annonce_id orphan"),
    )


@query
def synthetic_listings(spark, sf):
    return synth.listings(fixtures.user(spark, sf))


@query
def synthetic_listings_old(spark, sf):
    return synth.listings_old(fixtures.listing(spark, sf).select("id")).withColumn("price", F.col("price").cast("double"))


@query
def synthetic_attachments(spark, sf):
    return synth.attachments(synth.listings(fixtures.user(spark, sf)))


@query
def synthetic_user_roles(spark, sf):
    return synth.user_roles(fixtures.user(spark, sf))


@query
def synthetic_interactions(spark, sf):
    return synth.interactions(fixtures.user(spark, sf))
