import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.conftest import ODD, frame
from nearhome.llm import exact_dedup, fuse, queries
from nearhome.session import scratch_path


def brute(rows):
    """{normalised text: (best points, smallest id, size)}"""
    groups = defaultdict(list)
    for i, text, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0, i))
    return {norm: (min(g)[3], len(g)) for norm, g in groups.items()}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_filter_loses_no_key(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    built = fuse.build(keys)
    assert fuse.contains(keys, *built).all()
    others = np.random.default_rng(n + 1).integers(0, 2**62, 100_000, dtype=np.uint64) * np.uint64(2)
    assert fuse.contains(others, *built).mean() < 0.01
    if n >= 1000:
        assert len(built[3]) < 1.5 * n + 300


def check(spark, found, rows):
    groups = brute(rows)
    sha = {norm: hashlib.sha256(norm.encode()).hexdigest() for norm in groups}
    expected = sorted(
        (str(i), str(groups[norm][0]), groups[norm][1], sha[norm])
        for i, text, _ in rows for norm in [re.sub(r"[\x20\x09-\x0D]", "", text or "")]
    )
    got = found.collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == expected
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted(sha.values())  # exactly one row of each group, also among repeated rows
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_query_on_odd_documents(spark, odd, none, folder):
    check(spark, queries.op6_exact_dedup(spark, folder(documents=odd)), ODD)
    assert queries.op6_exact_dedup(spark, folder(documents=none)).count() == 0


def test_a_third_of_the_rows_in_one_group(spark, folder):
    rows = [(i, ("hot text" + " " * (i % 5)) if i % 3 == 0 else f"text {i // 2}", "a") for i in range(3000)]
    check(spark, queries.op6_exact_dedup(spark, folder(documents=frame(spark, rows))), rows)


def test_several_filters(spark, monkeypatch, folder):
    monkeypatch.setattr(exact_dedup, "KEYS_PER_FILTER", 40)
    rows = [(i, f"text {i % 400}", "a") for i in range(1000)]
    check(spark, queries.op6_exact_dedup(spark, folder(documents=frame(spark, rows))), rows)


def decided(snapshot_rows, batch_rows):
    snapshot = exact_dedup.build_snapshot(snapshot_rows, scratch_path(snapshot_rows.sparkSession, "snapshot"))
    of_batch, of_snapshot = exact_dedup.dedup_batch(snapshot, exact_dedup.digested(batch_rows))
    return of_batch.unionByName(of_snapshot).collect()


@pytest.mark.parametrize("new", ["true", "false", "doc_id > 5"])
def test_any_division_gives_the_same_groups(odd, new):
    incoming = F.coalesce(F.expr(new), F.lit(False))
    rows = decided(odd.filter(~incoming), odd.filter(incoming))
    assert len(rows) == len(ODD)
    assert sorted((r["digest"], r["group_size"]) for r in rows if r["kept"]) == sorted(
        (hashlib.sha256(norm.encode()).hexdigest(), size) for norm, (_, size) in brute(ODD).items())


def test_a_stored_snapshot_serves_several_batches(spark):
    path = scratch_path(spark, "kept")
    exact_dedup.build_snapshot(frame(spark, [(i, f"old text {i}", "a") for i in range(300)]), path)
    for start in (0, 250, 1000):
        rows = [(5000 + i, f"old  text {i}", "b") for i in range(start, start + 100)] + [(9000, "old text 7", "b")]
        of_batch, of_snapshot = exact_dedup.dedup_batch(exact_dedup.open_snapshot(spark, path), exact_dedup.digested(frame(spark, rows)))
        found = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in of_batch.collect()}
        known = lambda i: 3 if i == 7 and start == 0 else 2 if i < 300 else 1
        # the batch's text has one more blank, so it stays
        assert found == {**{5000 + i: (5000 + i, known(i)) for i in range(start, start + 100)}, 9000: (5007, 3) if start == 0 else (7, 2)}
        assert of_snapshot.filter("NOT kept").count() == sum(i < 300 for i in range(start, start + 100))
        assert of_snapshot.count() == 300


def test_the_filters_decide(spark, folder, monkeypatch):
    """With filters that accept nothing, groups across the two halves fall apart; with any other answer the result is the same."""
    rows = [(i, f"text {i // 4}", "a") for i in range(400)]
    docs = folder(documents=frame(spark, rows))
    key = lambda r: (r["doc_id"], r["keep_id"], r["group_size"])
    right = sorted(map(key, queries.op6_exact_dedup(spark, docs).collect()))
    screen = exact_dedup.screened
    monkeypatch.setattr(exact_dedup, "screened", lambda new, filters, buckets: new.select("digest"))
    assert sorted(map(key, queries.op6_exact_dedup(spark, docs).collect())) == right
    monkeypatch.setattr(exact_dedup, "screened", lambda new, filters, buckets: screen(new, filters, buckets).filter("false"))
    wrong = sorted(map(key, queries.op6_exact_dedup(spark, docs).collect()))
    assert wrong != right and sum(size < 4 for _, _, size in wrong) > 200


def test_only_positives_reach_the_exact_join(spark, monkeypatch):
    reached, real = [], exact_dedup.same_bytes
    monkeypatch.setattr(exact_dedup, "same_bytes", lambda s, b, pairs: reached.append(pairs.count()) or real(s, b, pairs))
    asked, screen = [], exact_dedup.screened
    monkeypatch.setattr(exact_dedup, "screened", lambda *a: asked.append(screen(*a).count()) or screen(*a))
    held, new = [(i, f"t {i}", "a") for i in range(3000)], [(i, f"t {i}", "a") for i in range(2900, 6000)]
    decided(frame(spark, held), frame(spark, new))
    assert reached == [100] and 100 <= asked[0] < 150


def test_a_batch_much_larger_than_the_snapshot(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "KEYS_PER_FILTER", 50)
    rows = decided(frame(spark, [(1, "t 1", "a")]), frame(spark, [(i, f"t {i % 700}", "a") for i in range(2, 1000)]))
    assert sum(r["kept"] for r in rows) == 700 and [r["group_size"] for r in rows if r["doc_id"] == 1] == [2]


def test_screen_passes_what_the_snapshot_holds_and_little_else(spark):
    groups = lambda names: spark.createDataFrame([(n,) for n in names], "digest string")
    held, new = groups([f"h{i}" for i in range(500)]), groups([f"h{i}" for i in range(0, 1000, 2)])
    positives = {r["digest"] for r in exact_dedup.screened(new, exact_dedup.snapshot_filters(held, 4), 4).collect()}
    assert {f"h{i}" for i in range(0, 500, 2)} <= positives
    assert len(positives) < 250 + 20


def test_equal_digests_over_different_bytes_are_not_merged(spark, odd, monkeypatch):
    real = exact_dedup.digested
    forged = F.when(F.col("doc.doc_id").isin(8, 9), F.lit("forged")).otherwise(F.col("digest"))
    monkeypatch.setattr(exact_dedup, "digested", lambda docs: real(docs).withColumn("digest", forged))
    nine = F.coalesce(F.col("doc_id") == 9, F.lit(False))
    assert [r["group_size"] for r in decided(odd.filter(~nine), odd.filter(nine)) if r["digest"] == "forged"] == [1, 1]


def test_stage_keeps_columns_and_one_row_a_group(odd, none):
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in kept.collect()]
    assert sorted(texts) == sorted(brute(ODD))
    assert exact_dedup.exact_dedup(none).count() == 0
