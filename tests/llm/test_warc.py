import gzip
import hashlib

import pytest

from millrace.llm import warc


@pytest.fixture
def pages(spark):
    big, other = "é" * 700, "x" * 1000
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, big), (4, "http://c/", "small"), (5, "http://d/", "small"), (6, "http://e/", None), (7, "http://f/\r\nX: y", ""), (8, "http://g/", other), (9, "h", "x" * 999), (10, "i", "x" * 999), (2**60 + 1, "j", "\r\n\r\nWARC/1.1\x00 \ud7ff")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "'x' AS digest", "2 AS file"), rows


def test_roundtrip(pages):
    df, rows = pages
    got = {r.id: r for r in warc.archive(df).collect()}
    payload = {i: (h or "").encode() for i, _, h in rows}
    assert set(got) == set(payload)
    for i, r in got.items():
        assert (r.payload_bytes, r.payload_digest) == (len(payload[i]), hashlib.sha1(payload[i]).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {1: 3, 2: 3}


def test_ranges_and_payloads(pages, monkeypatch):
    df, rows = pages
    monkeypatch.setattr(warc, "STRETCH", 700)
    index = warc.write(df)
    some = index.where("id IN (4, 8, 6)")
    got = {r.id: bytes(r.payload) for r in warc.read_records(some, with_payload=True).collect()}
    assert got == {4: b"small", 8: b"x" * 1000, 6: b""}


def test_files_are_warc(pages):
    df, rows = pages
    files = {}
    for r in warc.write(df.coalesce(1)).collect():
        files.setdefault(r.file, []).append(r)
    for name, index in files.items():
        whole = open(name, "rb").read()
        assert sum(r.length for r in index) == len(whole)
        assert gzip.decompress(whole).count(b"WARC-Record-ID") == len(index)
        for r in index:
            raw = gzip.decompress(whole[r.offset : r.offset + r.length])
            head, payload = warc.parse(raw)
            assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and head["WARC-Type"] == r.record_type
            assert "X" not in head


def test_nothing(pages):
    assert warc.archive(pages[0].limit(0)).count() == 0
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200\r\n\r\nx")


def test_null_and_repeated_ids(spark):
    import hashlib
    from collections import Counter

    big, other = "x" * 1500, "y" * 1500
    rows = [(1, big), (2, big), (2, big), (None, big), (3, other), (3, big + "z"), (4, big + "z"), (None, None), (None, "w" * 1200), (5, ""), (5, ""), (2**60 + 1, other), (6, "é" * 600)]
    df = spark.createDataFrame([(i, f"http://a/{k}", t) for k, (i, t) in enumerate(rows)], "page_id long, url string, html string")
    want = Counter()
    for i, t in rows:
        data = (t or "").encode()
        ids = [j for j, u in rows if u == t and j is not None]
        to = max(ids) if len(data) >= 1000 and ids and sum(u == t for _, u in rows) > 1 and i != max(ids) else None
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if to else "response", to] += 1
    got = Counter(tuple(r) for r in warc.archive(df).select("id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == want


def test_long_payloads_and_reading_tasks(spark, tmp_path):
    import random

    rng = random.Random(1)
    df = spark.createDataFrame([(k, "http://a", rng.randbytes(3_000_000 if k < 2 else 20_000).hex()) for k in range(12)], "page_id long, url string, html string")
    index = warc.write(df, f"file://{tmp_path}/w")
    got = warc.read_records(index, f"file://{tmp_path}/w", with_payload=True)
    assert {r.id: bytes(r.payload).decode() for r in got.collect()} == {r.page_id: r.html for r in df.collect()}
    assert got.rdd.getNumPartitions() > 1 or index.agg({"length": "sum"}).first()[0] < warc.STRETCH
