import glob
import gzip
import hashlib
import os
import random

import pytest

from nearhome.llm import queries, warc

SCHEMA = "page_id long, url string, html string, digest string, `payload` string, refers_to string"
LONG = "<p>" + "long enough to be shared " * 8


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h in rows], SCHEMA)


ODD = [
    (5, "http://a/", LONG), (3, None, LONG), (9, "http://b/\r\nWARC-Type: evil", LONG), (3, None, LONG), (None, "http://n/", LONG), (1, "http://s/", "short"), (2, "http://s/", "short"),
    (4, "http://e/", ""), (6, "http://e/", None), (7, "http://w/", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5), (8, "http://u/", "é\U0001f600\x00\x1f\x8b\x08" * 50),
    (None, None, "only null ids" * 20), (None, None, "only null ids" * 20), (10, "http://v/", "v" * 3_000_000), (-1, "", "x" * 100), (11, "", "x" * 100), (12, "", "x" * 99), (13, "", "x" * 99),
]


def brute(rows):
    first = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        other = first.get(html) if len(data) >= 100 and first.get(html) != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if other is None else "revisit", other))
    return out


def test_query_on_odd_pages(spark, folder):
    found = queries.op10_warc(spark, folder(pages=pages(spark, ODD))).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute(ODD)))
    assert queries.op10_warc(spark, folder(pages=pages(spark, []))).count() == 0


def test_a_third_of_the_pages_equal(spark, folder):
    rows = [(i, f"http://h/{i}", LONG if i % 3 == 0 else LONG + str(i // 2)) for i in range(2000)]
    found = queries.op10_warc(spark, folder(pages=pages(spark, rows))).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute(rows)))


def test_archives_are_read_by_any_gzip_reader(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(warc.page_records(pages(spark, ODD)).coalesce(1), path, records_per_file=5)
    files = glob.glob(path + "/part-*")
    assert len(files) == 4
    text = b"".join(gzip.open(f).read() for f in files)
    assert text.count(b"WARC-Record-ID: ") == len(ODD) and text.startswith(b"WARC/1.1\r\n")


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    path, pick = str(tmp_path / "warc"), random.Random(1)
    rows = [(i, f"http://h/{i}", pick.randbytes(30_000 if i == 20 else 5_000).hex()) for i in range(40)]
    warc.write_archives(warc.page_records(pages(spark, rows)).coalesce(1), path, file_bytes=20_000)
    files = {f: warc.salvage(open(f, "rb").read()) for f in glob.glob(path + "/part-*")}
    found = {f: [(h["warc-record-id"], len(p)) for *_, h, p in units] for f, units in files.items()}
    assert all(os.path.getsize(f) <= 20_000 or len(held) == 1 for f, held in found.items())
    assert max(map(len, found.values())) > 1
    assert sorted(x for held in found.values() for x in held) == sorted((f"<urn:page:{i}>", len(html)) for i, _, html in rows)


def records(n, seed=1):
    pick = random.Random(seed)
    payloads = [pick.randbytes(pick.randint(0, 400)) for _ in range(n)]
    return [warc.record_bytes(str(k), f"http://h/{k}", p, hashlib.sha256(p).hexdigest(), None) for k, p in enumerate(payloads)]


def seen(data):
    """(ids of the records, gaps); everything must be accounted for, in order."""
    ids, gaps, at = [], [], 0
    for start, end, gap, headers, _ in warc.salvage(data):
        if start > at:  # an empty member lies between
            assert gzip.decompress(data[at:start]) == b""
        else:
            assert start == at or start < at == end  # several records of one member share its place
        at = end
        if gap:
            gaps.append((start, end))
        else:
            ids.append(headers["warc-record-id"][len("<urn:page:") : -1])
    assert at == len(data)
    return [int(i) for i in ids if i.isdigit()], gaps  # without compression nothing guards the id itself


@pytest.mark.parametrize("packed", [False, True])
def test_undamaged(packed):
    parts = [gzip.compress(r) for r in records(20)] if packed else records(20)
    assert seen(b"".join(parts)) == (list(range(20)), [])


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("seed", range(12))
def test_damage_costs_the_damaged_records_only(packed, seed):
    parts = [gzip.compress(r) for r in records(20, seed)] if packed else records(20, seed)
    data = bytearray(b"".join(parts))
    starts = [sum(map(len, parts[:k])) for k in range(21)]
    pick = random.Random(seed)
    at, how = pick.randrange(len(data)), seed % 3
    hit = next(k for k in range(20) if at < starts[k + 1])
    if how == 0:
        data[at] ^= 0x55
    elif how == 1:
        data[at : at + 30] = b""
    else:
        data[at:at] = b"garbage WARC/1.1 \x1f\x8b\x08 more"
    last = next(k for k in range(20) if at + 29 < starts[k + 1] or k == 19) if how == 1 else hit
    ids, gaps = seen(bytes(data))
    lost = set(range(20)) - set(ids)
    assert ids == sorted(ids) and lost <= set(range(hit, last + 1)) | ({hit - 1} if at == starts[hit] else set())
    assert sum(b - a for a, b in gaps) <= sum(len(parts[k]) for k in range(max(0, hit - 1), last + 1)) + 60
    assert gaps or not lost or not packed


@pytest.mark.parametrize("packed", [False, True])
def test_cut_off_and_leading_garbage(packed):
    parts = [gzip.compress(r) for r in records(10)] if packed else records(10)
    ids, gaps = seen(b"".join(parts)[:-7])
    assert ids == list(range(9)) and len(gaps) == 1
    ids, gaps = seen(b"\x00\x01garbage" + b"".join(parts))
    assert ids == list(range(10)) and gaps == [(0, 9)]


def test_nothing_to_salvage():
    assert seen(b"") == ([], [])
    assert seen(b"no archive at all") == ([], [(0, 17)])


def test_several_records_in_a_member():
    data = gzip.compress(b"".join(records(3))) + gzip.compress(b"") + gzip.compress(records(4)[3])
    assert seen(data)[0] == [0, 1, 2, 3]


def test_gaps_of_damaged_archives_are_rows(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(warc.page_records(pages(spark, ODD)).coalesce(1), path)
    (file,) = glob.glob(path + "/part-*")
    data = bytearray(open(file, "rb").read())
    middle = [start for start, *_ in warc.salvage(bytes(data))][len(ODD) // 2]
    data[middle + 12] ^= 0xFF
    copy = tmp_path / "damaged"
    copy.mkdir()
    (copy / "a.warc.gz").write_bytes(bytes(data))
    rows = warc.read_archives(spark, str(copy)).collect()
    gaps = [r for r in rows if r["gap"]]
    assert len(gaps) == 1 and gaps[0]["start"] == middle and gaps[0]["payload"] is None
    assert len(rows) - 1 == len(ODD) - 1
