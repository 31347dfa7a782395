import json
import os

import pytest
from pyspark.sql import functions as F

from nearhome import __main__ as command
from nearhome.operators import lifecycle, store, synth
from nearhome.plans import jobs
from nearhome.session import scratch_path, scratch_scope, shared_dir
from nearhome.sources import jdbc, kafka, versioned
from nearhome.sources.tables import FolderTables
from nearhome.streaming import similarity


@pytest.fixture(scope="module")
def market(spark):
    """A folder of tables, with the models trained."""
    root = scratch_path(spark, "market")
    tables = FolderTables(spark, root)
    users = spark.range(40).withColumn("username", F.concat(F.lit("user"), F.col("id")))
    tables.append(users, "user")
    tables.append(synth.listings(users), "annonce")
    tables.append(synth.interactions(users, n=12), "user_interaction")
    models = scratch_path(spark, "market-models")
    jobs.prepare_similarity(spark, tables, models)
    return tables, models


def test_stream_to_notifications(spark, market):
    tables, models = market
    listings = tables.read("annonce")
    inbox, out, chk = (scratch_path(spark, n) for n in ("in", "out", "chk"))
    asked = [r["id"] for r in listings.orderBy("id").limit(6).collect()]
    lines = [(json.dumps({"announceId": i}),) for i in [*asked, 10 ** 9]]
    spark.createDataFrame(lines, "value string").write.text(inbox)
    jobs.similarity_stream(spark, tables, spark.readStream.text(inbox), similarity.parquet_sink(out), models, chk, run_once=True).awaitTermination()
    results = spark.read.parquet(out)
    assert sorted(r["id"] for r in results.collect()) == asked
    # the results travel as messages and are stored by the stream
    topic = scratch_path(spark, "topic")
    store.to_messages(results).select("value").write.text(topic)
    run = lambda: jobs.store_stream(tables, spark.readStream.text(topic), scratch_path(spark, "store-chk"), run_once=True).awaitTermination()
    run()
    run()  # the same results once more, from a new checkpoint
    assert jobs.pending_results(tables).count() == 6

    assert jobs.recommend_all(spark, tables, models, 7) == 1
    per_user = tables.read("user_recommendations").groupBy("user_id").count()
    assert per_user.filter("count <> 7").count() == 0

    n = jobs.notify(spark, tables, models, 5)
    sent = tables.read("to_announce_notifications")
    assert 0 < n == sent.count() == sent.distinct().count()
    assert sent.groupBy("announce_id").count().filter("count > 5").count() == 0
    assert jobs.pending_results(tables).count() == 0
    assert jobs.notify(spark, tables, models, 5) == 0
    jobs.store_results(tables, results.filter(F.col("id") == asked[0]), store.version_of(9, 0))  # as if the run had failed before it said what is done
    assert [r["announceId"] for r in jobs.pending_results(tables).collect()] == [asked[0]]
    assert jobs.notify(spark, tables, models, 5) == 0
    assert tables.read("to_announce_notifications").count() == n


def test_cosine_job(spark, market):
    tables, models = market
    inbox, out = scratch_path(spark, "in"), scratch_path(spark, "out")
    spark.createDataFrame([('{"id": 3}',), ('{"id": 99999}',)], "value string").write.text(inbox)
    jobs.cosine_stream(spark, tables, spark.readStream.text(inbox), similarity.parquet_sink(out), models, scratch_path(spark, "chk"), run_once=True).awaitTermination()
    found = store.from_cosine_messages(store.to_cosine_messages(spark.read.parquet(out))).collect()
    assert [r["id"] for r in found] == [3] and len(found[0]["similar_ids"]) == 10 and -1 <= found[0]["similarity"] <= 1


def test_results_stored_while_others_are_processed_stay(spark):
    tables = FolderTables(spark, scratch_path(spark, "concurrent"))
    assert jobs.pending_results(tables) is None
    row = lambda i, similar, version: jobs.store_results(tables, spark.createDataFrame([(i, similar)], "id long, similar_ids array<long>"), version)
    row(1, [5], 1)
    row(2, [6], 1)
    read = jobs.pending_results(tables).collect()
    row(1, [7, 8], 2)
    tables.append(spark.createDataFrame(read).select("announceId", "version"), jobs.DONE)
    assert [tuple(r) for r in jobs.pending_results(tables).collect()] == [(1, "7,8", 2)]


def test_rows_appended_after_a_replacement_are_seen(spark):
    tables = FolderTables(spark, scratch_path(spark, "appended"))
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert not tables.exists("t")
    tables.append(rows(1), "t")
    tables.replace(rows(2, 3), "t")
    tables.append(rows(4, 5), "t")
    tables.append(rows(6), "t")
    assert sorted(r["id"] for r in tables.read("t").collect()) == [2, 3, 4, 5, 6] and tables.exists("t")
    for i in range(3):
        tables.replace(rows(i), "t")
    versioned.remove_old(spark, f"{tables.root}/t", keep=1)
    assert [r["id"] for r in tables.read("t").collect()] == [2]
    assert sorted(f for f in os.listdir(f"{tables.root}/t") if f.startswith("version")) == ["version-5"]


def test_scratch_is_removed(spark):
    with scratch_scope(spark):
        path = scratch_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert os.path.isdir(path)
    assert not os.path.exists(path)


class Told:
    """Tables that only note how they are read."""

    def __init__(self, tables):
        self.tables, self.keys = tables, {}

    def read(self, name, key=None):
        self.keys[name] = key
        return self.tables.read(name)

    def __getattr__(self, name):
        return getattr(self.tables, name)


def test_every_read_of_the_jobs_is_split_by_a_key(spark, market):
    tables, models = market
    told = Told(tables)
    jobs.store_results(tables, spark.createDataFrame([(1, [3])], "id long, similar_ids array<long>"), store.version_of(99, 0))
    jobs.prepare_similarity(spark, told, models)
    jobs.recommend_all(spark, told, models, 2, by_type=True)
    jobs.notify(spark, told, models, 2)
    inbox = scratch_path(spark, "in")
    spark.createDataFrame([('{"announceId": 3}',)], "value string").write.text(inbox)
    jobs.similarity_stream(spark, told, spark.readStream.text(inbox), similarity.parquet_sink(scratch_path(spark, "out")), models, scratch_path(spark, "chk"), run_once=True).awaitTermination()
    assert {"annonce", "user", "user_interaction", "similar_announces"} <= set(told.keys)
    assert all(told.keys.values()), told.keys


def test_recommendations_are_replaced(spark, market):
    tables, models = market
    first = jobs.recommend_all(spark, tables, models, 3)
    rows = tables.read("user_recommendations").count()
    assert jobs.recommend_all(spark, tables, models, 3) == first + 1
    assert tables.read("user_recommendations").count() == rows
    assert lifecycle.saved_versions(spark, f"{models}/als").count() >= 2


def test_generated_tables_link(spark):
    users = spark.range(50)
    listings, made = synth.listings(users).cache(), synth.interactions(users).cache()
    assert listings.select("id").distinct().count() == listings.count()
    counts = listings.groupBy("user_id").count()
    assert counts.count() == 50 and counts.filter("count not between 1 and 3").count() == 0
    assert made.count() == 250
    assert made.join(listings, made["annonce_id"] == listings["id"], "left_anti").count() == 0
    assert made.filter("interaction_score not between 0.1 and 1.0").count() == 0
    assert listings.filter("prix not between 10000 and 300000 or latitude not between -90 and 90").count() == 0
    files = synth.attachments(listings).groupBy("annonce_id").count()
    assert files.count() == listings.count() and files.filter("count not between 1 and 3").count() == 0
    roles = synth.user_roles(users)
    assert roles.select("user_id").distinct().count() == 50 and roles.distinct().count() == roles.count()
    older = synth.listings_old(users)
    assert dict(older.dtypes)["price"] == "decimal(10,2)" and older.filter("price not between 100000 and 500000").count() == 0
    assert synth.listings(users).exceptAll(listings).count() == 0


class Recorder:
    """Stands in for a reader or writer and keeps what it was told."""

    def __init__(self):
        self.told = {}

    def format(self, name):
        self.told["format"] = name
        return self

    def options(self, **options):
        self.told |= options
        return self

    def mode(self, name):
        self.told["mode"] = name
        return self

    def load(self):
        return self

    def save(self):
        self.told["saved"] = True

    def first(self):
        return (3, 90)

    def collect(self):
        return [(low,) for low in self.lows]

    def jdbc(self, url, table, **told):
        self.told |= {"url": url, "dbtable": table, **told}
        return self

    lows = [3, 500, 501, 10**9]


class Recorded:
    def __init__(self):
        self.write = Recorder()
        self.made = []

    @property
    def read(self):
        self.made.append(Recorder())
        return self.made[-1]


def test_jdbc_scan_is_split_by_the_key(spark):
    session = Recorded()
    jdbc.read_table(session, "jdbc:x", "annonce", {"user": "u"}, key="id", partitions=4, even=True)
    bounds, scan = (r.told for r in session.made)
    assert bounds["dbtable"].startswith("(SELECT MIN(id)")
    assert {k: scan[k] for k in ("dbtable", "user", "partitionColumn", "lowerBound", "upperBound", "numPartitions")} == {
        "dbtable": "annonce", "user": "u", "partitionColumn": "id", "lowerBound": "3", "upperBound": "90", "numPartitions": "4",
    }
    plain = Recorded()
    jdbc.read_table(plain, "jdbc:x", "annonce", {})
    assert len(plain.made) == 1 and "partitionColumn" not in plain.made[0].told
    with pytest.raises(ValueError):
        jdbc.split_options("id", 5, 1, 2)


def test_jdbc_scan_of_a_sparse_key_has_equally_large_parts(spark):
    session = Recorded()
    jdbc.read_table(session, "jdbc:x", "annonce", {"user": "u"}, key="id", partitions=4)
    bounds, scan = (r.told for r in session.made)
    assert "NTILE(4) OVER (ORDER BY id)" in bounds["dbtable"] and bounds["url"] == "jdbc:x"
    assert scan["predicates"] == ["id IS NULL OR id < 500", "id >= 500 AND id < 501", "id >= 501 AND id < 1000000000", "id >= 1000000000"]
    assert scan["dbtable"] == "annonce" and scan["properties"] == {"user": "u", "fetchsize": "10000"}


def test_parts_of_a_skewed_key_by_the_queries_themselves():
    """The bounds and conditions, run by another engine: nearly all keys in one small span, some missing and repeated."""
    import duckdb

    connection = duckdb.connect()
    connection.execute("CREATE TABLE t AS SELECT CASE WHEN i % 50 = 0 THEN i * 1000000 WHEN i % 97 = 0 THEN NULL ELSE i // 2 END AS id FROM range(10000) r(i)")
    lows = [r[0] for r in connection.sql(f"SELECT * FROM {jdbc.depth_query('t', 'id', 8)}").fetchall()]
    sizes = [connection.sql(f"SELECT count(*) FROM t WHERE {p}").fetchall()[0][0] for p in jdbc.depth_predicates("id", lows)]
    assert sum(sizes) == 10_000 and len(sizes) == 8 and max(sizes) < 1.2 * 10_000 / 8
    for few in ([], [5], [5, 5]):
        assert connection.sql(f"SELECT count(*) FROM t WHERE {jdbc.depth_predicates('id', few)[0]}").fetchall()[0][0] == 10_000


def test_jdbc_writes(spark):
    added, replaced = Recorded(), Recorded()
    jdbc.append(added, "jdbc:x", "t", {"password": "p"})
    jdbc.replace(replaced, "jdbc:x", "t", {})
    assert added.write.told["mode"] == "append" and added.write.told["password"] == "p" and added.write.told["saved"]
    assert replaced.write.told["mode"] == "overwrite" and replaced.write.told["truncate"] == "true"


def test_kafka_options():
    assert kafka.source_options("h:1") == {"kafka.bootstrap.servers": "h:1", "subscribe": "new_announce_topic", "startingOffsets": "earliest"}
    assert kafka.source_options("h:1", "t", "latest", 50) == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "latest", "maxOffsetsPerTrigger": "50",
    }
    assert kafka.sink_options("h:1") == {"kafka.bootstrap.servers": "h:1", "topic": "similar_calc_announces_topic"}
    with pytest.raises(ValueError):
        kafka.source_options("h:1", starting="middle")


def test_command_line(tmp_path):
    args = command.parser().parse_args(["stream", "--folder", "/d", "--models", "/m", "--servers", "h:1", "--checkpoint", "/c", "--starting", "latest"])
    assert (args.command, args.folder, args.starting) == ("stream", "/d", "latest")
    with pytest.raises(SystemExit):
        command.parser().parse_args(["notify", "--models", "/m"])
    (tmp_path / "p").write_text("# db\nuser = ann\npassword=a=b\n\n")
    assert command.read_properties(str(tmp_path / "p")) == {"user": "ann", "password": "a=b"}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

