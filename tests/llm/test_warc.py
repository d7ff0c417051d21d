import base64
import hashlib

import pyarrow as pa
import pytest

from caseloom.llm import warc
from caseloom.session import new_folder

ROWS = [
    (1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, "same"), (4, "http://c/", None), (5, "u\r\nv", ""),
    (6, "http://d/", "other é\r\n\r\nWARC/1.1"), (None, "http://e/", "same"), (None, "http://f/", "lone"),
    (7, "http://g/", "twice"), (7, "http://g/", "twice"),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id bigint, url string, html string").selectExpr("*", "1 AS sha", "2 AS last")


def brute(rows):
    last = {}
    for page, _, html in rows:
        known = last.setdefault(html or "", page)
        last[html or ""] = page if known is None or (page is not None and page > known) else known
    for page, _, html in rows:
        payload = (html or "").encode()
        best = last[html or ""]
        kind = "response" if page == best else "revisit"
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield page, len(payload), digest, kind, None if kind == "response" else best


def test_round_trip_equals_brute_force(pages):
    found = [tuple(r) for r in warc.archive(pages).collect()]
    assert sorted(found, key=str) == sorted(brute(ROWS), key=str)


def test_small_payloads_stay_responses(pages):
    found = {r.page_id: r.record_type for r in warc.archive(pages, least_bytes=5).where("page_id < 4").collect()}
    assert set(found.values()) == {"response"}


def test_records_are_fetched_by_frame_and_offset(spark, pages):
    folder = new_folder(spark, "warc")
    records = warc.write_bundles(pages.repartition(2), folder, frame_bytes=300, bundle_bytes=900)
    assert records.select("frame").distinct().count() > 1
    assert records.select("bundle").distinct().count() > 1
    ids = spark.createDataFrame([(6,), (1,), (99,), (6,)], "page_id bigint")
    found = {r.page_id: r for r in warc.fetch(records, ids, folder).collect()}
    assert set(found) == {1, 6}
    assert found[6].payload == "other é\r\n\r\nWARC/1.1".encode()
    assert found[1].payload is None and found[1].refers_to == 3 and found[1].url == "http://a/"


def test_damage_is_noticed():
    out = pa.BufferOutputStream()
    writer = warc.BundleWriter(out, 100)
    for i in range(5):
        writer.add(warc.record(i, "u", b"payload" * 20, False, None))
    writer.finish()
    raw = bytearray(out.getvalue().to_pybytes())
    assert len(warc.BundleReader(pa.BufferReader(bytes(raw))).frames) == 5
    raw[20] ^= 0xFF
    with pytest.raises(Exception):
        warc.BundleReader(pa.BufferReader(bytes(raw))).frame(0)


def test_empty_table(spark):
    assert warc.archive(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
