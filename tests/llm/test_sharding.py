import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from llm.conftest import EXTRA, ODD, frame
from llm.test_sql import compare
from nearhome.llm import queries, sharding


def jump(key, shards):
    """The algorithm as published."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def hashed(key):
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:16], 16)


@pytest.mark.parametrize("shards", [1, 2, 24, 64, 65, 1000])
def test_shards_as_published(spark, shards):
    rows = spark.range(400).selectExpr("if(id = 0, null, id * 7919 - 5) AS doc_id")
    found = sharding.with_shards(rows, F.col("doc_id"), [shards, shards + 3], ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in found] == [(jump(hashed(r["doc_id"]), shards), jump(hashed(r["doc_id"]), shards + 3)) for r in found]


def test_all_steps_are_taken_when_the_first_do_not_suffice(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_STEPS", 1)
    found = sharding.with_shards(spark.range(300), F.col("id"), [50], ["shard"]).collect()
    assert [r["shard"] for r in found] == [jump(hashed(r["id"]), 50) for r in found]


def check(found, rows):
    got = found.collect()
    sizes = lambda t: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    expected = sorted((str(i), *sizes(t), jump(hashed(i), 24), jump(hashed(i), 25)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == expected
    assert {r["law"] for r in got} <= {"key"}
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_on_odd_documents(spark, odd, none, folder):
    check(queries.op13_sharding(spark, folder(documents=odd)), ODD)
    assert queries.op13_sharding(spark, folder(documents=none)).count() == 0


def test_odd_documents_by_sql(spark, odd, folder):
    compare(spark, "op13_sharding", folder(documents=odd))


def test_a_third_of_the_rows_on_one_key(spark, folder):
    rows = [(None if i % 3 == 0 else i, f"text {i % 7}", "a") for i in range(3000)]
    check(queries.op13_sharding(spark, folder(documents=frame(spark, rows))), rows)


def test_appended_shards_take_rows_only_into_themselves(spark):
    rows = frame(spark, [(i, "x" * (i % 50), "a") for i in range(5000)])
    placed = sharding.sharded(rows, 24, added=2)
    gone = sharding.moved(placed).collect()
    assert all(r["grown_shard"] in (24, 25) and r["shard"] < 24 for r in gone)
    assert sum(r["n_rows"] for r in gone) == pytest.approx(5000 * 2 / 26, rel=0.2)
    counts = Counter(r["shard"] for r in placed.select("shard").collect())
    assert len(counts) == 24 and max(counts.values()) < 1.4 * 5000 / 24


def test_written_shards_hold_every_row_once(spark, odd, none, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_FILE", 2)
    sharding.write_shards(odd, str(tmp_path / "s"), 5)
    rows = sharding.read_shards(spark, str(tmp_path / "s")).collect()
    assert Counter(str((r["doc"]["doc_id"], r["doc"]["text"])) for r in rows) == Counter(str((i, t)) for i, t, _ in ODD)
    assert all(r["shard"] == jump(hashed(r["doc"]["doc_id"]), 5) and r["doc"]["row"] == EXTRA[0] for r in rows)
    some = sharding.read_shards(spark, str(tmp_path / "s"), [1, 3])
    assert {r["shard"] for r in some.collect()} <= {1, 3}
    sharding.write_shards(none, str(tmp_path / "n"), 5)


def test_numbers_of_shards_are_checked(spark):
    for counts in ([], [0], [3, 2]):
        with pytest.raises(ValueError):
            sharding.with_shards(spark.range(1), F.col("id"), counts, ["a", "b"])
