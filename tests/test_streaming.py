import json
import os
import re

import pytest
from pyspark.sql import functions as F

from nearhome.operators import neighbors, store
from nearhome.plans import jobs
from nearhome.session import scratch_path
from nearhome.sources.tables import FolderTables
from nearhome.streaming import similarity


@pytest.fixture
def answers(spark):
    rows = [(i, "a" if i < 7 else "b", float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, cluster string, prix double")
    return neighbors.price_neighbors(df, "cluster", 3).cache()


def put(spark, inbox, lines):
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("append").text(inbox)


def run(spark, inbox, answer, out, checkpoint, field="announceId", files=None):
    reader = spark.readStream.option("maxFilesPerTrigger", files) if files else spark.readStream
    query = similarity.start_similarity(reader.text(inbox), answer, similarity.parquet_sink(out), checkpoint, field, run_once=True)
    query.awaitTermination()
    return query


def found(spark, out):
    return {r["id"]: r["similar_ids"] for r in store.latest_results(spark.read.parquet(out), "batch_id").collect()}


def test_message_fields(spark):
    df = spark.createDataFrame([('{"announceId":123}',), ('{"announceId":"7"}',), ("junk",), ("{}",), ('{"announceId":"x"}',), (None,)], "value string")
    assert [r["id"] for r in similarity.parse_ids(df).collect()] == [123, 7]
    binary = df.select(F.col("value").cast("binary").alias("value"))
    assert [r["id"] for r in similarity.parse_ids(binary).collect()] == [123, 7]
    older = spark.createDataFrame([('{"id": 5}',)], "value string")
    assert [r["id"] for r in similarity.parse_ids(older, "id").collect()] == [5]


def test_batch_of_duplicates_unknown_and_broken(spark, answers):
    inbox, out, chk = (scratch_path(spark, n) for n in ("in", "out", "chk"))
    put(spark, inbox, ['{"announceId":5}', '{"announceId":"5"}', '{"announceId":6}', '{"announceId":999}', "junk", "{}"])
    run(spark, inbox, similarity.stored_answer(answers), out, chk)
    rows = spark.read.parquet(out).collect()
    assert sorted((r["id"], tuple(r["similar_ids"])) for r in rows) == [(5, (0, 1, 2)), (6, (0, 1, 2))]


def test_restart_emits_nothing_twice_and_batches_do_not_matter(spark, answers):
    inbox, one, many, chk1, chk2 = (scratch_path(spark, n) for n in ("in", "one", "many", "chk1", "chk2"))
    for i in range(4):
        put(spark, inbox, [json.dumps({"announceId": i * 3 + j}) for j in range(3)])
    answer = similarity.stored_answer(answers)
    run(spark, inbox, answer, one, chk1)
    run(spark, inbox, answer, many, chk2, files=1)
    assert found(spark, one) == found(spark, many) and len(found(spark, one)) == 12
    assert spark.read.parquet(many).select("batch_id").distinct().count() == 4
    run(spark, inbox, answer, one, chk1)  # nothing new
    assert spark.read.parquet(one).count() == 12
    put(spark, inbox, ['{"announceId":3}'])
    run(spark, inbox, answer, one, chk1)
    assert spark.read.parquet(one).count() == 13 and len(found(spark, one)) == 12


def test_a_batch_of_junk_calls_nobody(spark):
    inbox, out, chk = (scratch_path(spark, n) for n in ("in", "out", "chk"))
    put(spark, inbox, ["junk", "{}"])
    calls = []
    run(spark, inbox, lambda ids: calls.append(ids), out, chk)
    assert not calls


def test_lookup_pushes_the_range_of_the_batch(spark, capsys):
    path = scratch_path(spark, "table")
    similarity.ordered_by_id(spark.range(1000).withColumn("x", F.col("id") * 2)).write.parquet(path)
    rows = similarity.rows_of(spark.createDataFrame([(7,), (9,), (5000,)], "id long"), spark.read.parquet(path))
    rows.explain()
    plan = capsys.readouterr().out
    scan = plan[plan.index("FileScan"):]
    assert re.search(r"DataFilters: \[.*>= 7.*<= 9.*5000", scan) and "Or(And(" in scan[scan.index("PushedFilters"):]
    assert sorted(r["x"] for r in rows.collect()) == [14, 18]


def test_cosine_answers(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "id long, vec array<double>")
    answer = similarity.cosine_answer(vectors, 2)
    rows = answer(spark.createDataFrame([(1,), (99,)], "id long"))
    sent = store.from_cosine_messages(store.to_cosine_messages(rows)).collect()
    assert [(r["id"], r["similar_ids"], r["similarity"]) for r in sent] == [(1, [2, 3], 0.5)]


def test_stateless_form(spark, answers):
    inbox, out, chk = (scratch_path(spark, n) for n in ("in", "out", "chk"))
    put(spark, inbox, ['{"announceId":5}', "junk", '{"announceId":999}'])
    results = similarity.similar_stream(spark.readStream.text(inbox), answers)
    query = results.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["id"] for r in spark.read.parquet(out).collect()] == [5]


def test_cosine_batches_share_one_index(spark):
    """The second batch writes nothing of the catalogue's size and leaves no scratch behind."""
    vectors = spark.range(3000).select("id", F.array(F.cos(F.col("id") * 1.0), F.sin(F.col("id") * 1.0), F.col("id") / 1000).alias("vec"))
    answer, place = similarity.cosine_answer(vectors, 2), os.path.dirname(scratch_path(spark, "x"))
    written_rows = []

    def sink(result, batch_id):
        result.collect()
        for folder in set(os.listdir(place)) - before:
            written_rows.append(spark.read.parquet(f"{place}/{folder}").count())

    inbox, chk = scratch_path(spark, "in"), scratch_path(spark, "chk")
    for i in (5, 6):
        spark.createDataFrame([(json.dumps({"id": i}),)], "value string").write.mode("append").text(inbox)
        before = set(os.listdir(place)) | {os.path.basename(chk)}
        similarity.start_similarity(spark.readStream.text(inbox), answer, sink, chk, "id", run_once=True).awaitTermination()
        assert set(os.listdir(place)) | {os.path.basename(chk)} == before
    assert len(written_rows) >= 4 and max(written_rows) <= 4


def test_two_far_ids_are_two_ranges(spark, tmp_path):
    ids = spark.createDataFrame([(1,), (10**9,)], "id long")
    assert similarity.id_ranges(ids) == [(1, 1), (10**9, 10**9)]
    assert similarity.id_ranges(spark.createDataFrame([(-2**63,), (2**63 - 1,), (5,)], "id long")) == [(-2**63, -2**63), (5, 5), (2**63 - 1, 2**63 - 1)]
    assert similarity.id_ranges(spark.createDataFrame([], "id long")) == []
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 2), (500, 3), (10**9, 4)], "id long, x long").write.parquet(path)
    rows = similarity.rows_of(ids, spark.read.parquet(path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "1000000000" in plan and "Or(" in plan
    assert sorted(r["x"] for r in rows.collect()) == [2, 4]


def latest_changes(spark, batches):
    """What comes out for batches of (version, id, similar ids), read one after another, by batch."""
    inbox, out = scratch_path(spark, "latest-in"), scratch_path(spark, "latest-out")
    for number, rows in enumerate(batches):
        lines = [(r[1] if isinstance(r[1], str) else json.dumps({"announceId": r[1], "similarIds": r[2], "clusterId": "c"}), r[0]) for r in rows]
        spark.createDataFrame(lines, "value string, version long").coalesce(1).write.mode("append").parquet(f"{inbox}/{number}")
    stream = spark.readStream.schema("value string, version long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(inbox)
    jobs.latest_stream(stream, similarity.parquet_sink(out), scratch_path(spark, "latest-chk"), run_once=True).awaitTermination()
    rows = spark.read.schema("id long, version long, cluster string, similars_ids string, batch_id int").parquet(out).collect()
    return sorted((r["batch_id"], r["id"], r["version"], r["similars_ids"]) for r in rows)


def test_only_changes_of_the_latest_result_come_out(spark):
    found = latest_changes(spark, [
        [(3, 1, [5, 6]), (2, 1, [7]), (1, 2, [9]), (None, 4, [1]), (8, "junk", None), (8, "{}", None)],
        [(3, 1, [5, 6]), (2, 1, [8]), (1, 2, [10]), (5, 3, [])],  # repeated, late, replayed under the same version
        [(4, 1, [5, 6]), (2, 2, [9, 1]), (3, 2, [9, 2]), (3, 2, [9, 3])],  # a new version without a change; several at once
        [(4, 1, [1]), (5, 1, [1])],
    ])
    assert found == [(0, 1, 3, "5,6"), (0, 2, 1, "9"), (1, 3, 5, ""), (2, 2, 3, "9,3"), (3, 1, 5, "1")]


def test_a_repeated_batch_of_changes_gives_out_the_same(spark):
    """Every batch works without a Python process a listing: it is repeated from the state that the batch before it has left."""
    from nearhome.streaming import latest

    out, root = {}, scratch_path(spark, "latest-state")
    sink = lambda rows, number: out.setdefault(number, []).append(sorted(tuple(r) for r in rows.collect()))
    process = latest.change_batches(sink, root)
    message = lambda i, ids, cluster="c": json.dumps({"announceId": i, "similarIds": ids, "clusterId": cluster})
    batch = lambda *rows: spark.createDataFrame(rows, "value string, version long")
    first, second = batch((message(1, [5]), 1), (message(2, [6]), 1)), batch((message(1, [7]), 2), (message(2, [6], "d"), 2), (message(2, [9]), 1))
    for number, rows in ((0, first), (0, first), (1, second), (1, second), (3, first), (4, batch())):
        process(rows, number)
    assert out[0] == [[(1, 1, "c", "5"), (2, 1, "c", "6")]] * 2
    assert out[1] == [[(1, 2, "c", "7"), (2, 2, "d", "6")]] * 2
    assert out[3] == [[]] and out[4] == [[]]
    assert len(latest._states(spark, root)) == 2  # the last one, and that which it was made of


def test_a_hot_listing_keeps_one_state(spark):
    rows = [(v, 1, [v]) for v in range(1, 400)] + [(v, 2 + v, [1]) for v in range(1, 800)]
    found = latest_changes(spark, [rows, rows[::-1]])
    assert found[0] == (0, 1, 399, "399") and len(found) == 800


def test_versions_grow_across_checkpoints(spark):
    """A checkpoint made anew under the same path, and one that goes on."""
    tables = FolderTables(spark, scratch_path(spark, "versions"))
    inbox, first, second = (scratch_path(spark, n) for n in ("in", "chk1", "chk2"))

    def store_all(checkpoint):
        jobs.store_stream(tables, spark.readStream.text(inbox), checkpoint, run_once=True).awaitTermination()
        return sorted((r["announceId"], r["similarsIds"], divmod(r["version"], store.EPOCH)) for r in jobs.pending_results(tables).collect())

    message = lambda i, ids: json.dumps({"announceId": i, "similarIds": ids, "clusterId": "c"})
    put(spark, inbox, [message(1, [5]), message(2, [6])])
    assert store_all(first) == [(1, "5", (1, 0)), (2, "6", (1, 0))]
    tables.append(jobs.pending_results(tables).select("announceId", "version"), jobs.DONE)
    put(spark, inbox, [message(1, [7])])
    assert store_all(first) == [(1, "7", (1, 1))]
    tables.append(jobs.pending_results(tables).select("announceId", "version"), jobs.DONE)
    assert store_all(first) == []
    found = store_all(second)  # reads everything again; in its only batch one result a listing counts
    assert [(r[0], r[2]) for r in found] == [(1, (2, 0)), (2, (2, 0))]
    put(spark, inbox, [message(2, [3])])
    assert store_all(first)[0][2] == (2, 0)  # an older checkpoint does not win against a newer one
    assert tables.read(jobs.EPOCHS).count() == 2


def test_a_repeated_batch_adds_nothing(spark):
    tables = FolderTables(spark, scratch_path(spark, "repeated"))
    results = spark.createDataFrame([(1, [5]), (2, [6])], "id long, similar_ids array<long>")
    jobs.store_results(tables, results.limit(1), 7)
    jobs.store_results(tables, results, 7, repeated=True)
    jobs.store_results(tables, results, 7, repeated=True)
    assert sorted(r["announceId"] for r in tables.read(jobs.QUEUE).collect()) == [1, 2]


def test_the_last_message_of_a_batch_counts(spark):
    rows = spark.createDataFrame([(1, [9], 5, 1), (1, [2], 5, 2), (1, [8], 4, 9)], "id long, similar_ids array<long>, timestamp int, offset long")
    assert [tuple(r) for r in store.one_per_listing(rows, ["timestamp", "offset"]).collect()] == [(1, [2])]
