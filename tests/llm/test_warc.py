import base64
import datetime
import decimal
import hashlib
from collections import defaultdict

import pytest

from streamspec.llm import warc
from streamspec.llm.common import scratch

TRAP = "<p>x</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:streamspec:page:666:0>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: 9"


def check(rows, pages, min_bytes=0):
    first = defaultdict(list)
    for i, h in pages:
        first[h or ""].append(i)
    assert sorted(str(r.page_id) for r in rows) == sorted(str(i) for i, _ in pages)
    html = defaultdict(list)
    for i, h in pages:
        html[i].append((h or "").encode())
    for r in rows:
        payloads = {base64.b32encode(hashlib.sha1(p).digest()).decode(): p for p in html[r.page_id]}
        own = payloads[r.payload_digest]
        assert r.digest_ok and r.payload_bytes == len(own)
        if len(own) < min_bytes:
            assert r.record_type == "response" and r.refers_to is None
    for h, ids in first.items():
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        own = [r for r in rows if r.payload_digest == digest]
        if len(h.encode()) >= min_bytes:
            assert [r.page_id for r in own if r.record_type == "response"] == [min(ids, key=lambda i: (i is None, i or 0))]
            assert all(r.refers_to == min((i for i in ids if i is not None), default=None) for r in own if r.record_type == "revisit")


ROWS = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "u", ""), (5, "u", TRAP), (6, "u", "é漢\r\n\r\n\r\n"), (6, "u", "é漢\r\n\r\n\r\n"), (None, "u", "nameless"), (7, "u", "x" * 300_000), (8, "u", "WARC/1.1\r\n\r\n"), (9, "u", TRAP)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(2)


def test_round_trip(pages):
    rows = warc.round_trip(pages).collect()
    check(rows, [(i, h) for i, _, h in ROWS])


def test_smaller_payloads_are_responses(pages):
    check(warc.round_trip(pages, min_bytes=5).collect(), [(i, h) for i, _, h in ROWS], 5)


@pytest.mark.parametrize("size", [64, 300, 1000, 70_000])
def test_ranges_of_any_size(spark, pages, size):
    """Records that span many ranges, ranges without a record, magic that straddles them."""
    path = scratch(spark, "warc-test")
    warc.write(pages.where("page_id <> 7 OR page_id IS NULL") if size < 1000 else pages, path)
    got = warc.read(spark, path, size, with_payload=True).collect()
    want = [(i, h) for i, _, h in ROWS if size >= 1000 or i != 7]
    assert len(got) == len(want) and all(r.digest_ok for r in got)
    assert sorted(bytes(r.payload).decode() for r in got if r.record_type == "response") == sorted({h or "" for _, h in want})


def test_generated(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    check(warc.round_trip(frame).collect(), [(r.page_id, r.html) for r in frame.collect()])


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("tail", ["cut", "WARC/1.1\r\nWARC-Type: response\r\nContent-Le"])
def test_a_cut_off_archive_is_an_error(spark, tmp_path, tail):
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:streamspec:page:{}:0>\r\nContent-Length: {}\r\n\r\n"
    whole = head.format(1, 5) + "hello\r\n\r\n" + (head.format(2, 50) if tail == "cut" else "") + tail
    (tmp_path / "a.warc").write_bytes(whole.encode())
    for size in (40, 1000):
        with pytest.raises(Exception, match="cuts off the record"):
            warc.read(spark, str(tmp_path), size).collect()


def test_jumps_over_many_ranges(spark):
    """Every table takes the way over candidates and jumps, here with dozens of ranges a file."""
    frame = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    path = scratch(spark, "warc-test")
    warc.write(frame, path)
    _, _, most = warc.ranges(spark, path, warc.RANGE)
    assert most > 4
    rows = warc.round_trip(frame).collect()
    check(rows, [(r.page_id, r.html) for r in frame.collect()])


@pytest.mark.parametrize(
    "kind,ids",
    [
        ("string", ["a:b", "", "é >\r\nx", None, "1", "01"]),
        ("date", [datetime.date(2024, 1, 2), None, datetime.date(1, 1, 1)]),
        ("binary", [b"", b"\x00:", b"\xff", None]),
        ("decimal(20,3)", [decimal.Decimal("12.500"), decimal.Decimal("-1.000"), None]),
    ],
)
def test_identifiers_keep_their_type(spark, kind, ids):
    rows = [(i, "u", f"page {k % 2}", "a", "b", 1, "c") for k, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, f"page_id {kind}, url string, html string, digest string, first string, bytes int, at string")
    got = warc.round_trip(frame)
    assert got.schema["page_id"].dataType == frame.schema["page_id"].dataType == got.schema["refers_to"].dataType
    value = lambda x: bytes(x) if isinstance(x, bytearray) else x
    assert sorted(map(repr, (value(r.page_id) for r in got.collect()))) == sorted(map(repr, ids))
    named = sorted(i for k, i in enumerate(ids) if i is not None and k % 2 == 0)
    assert all(value(r.refers_to) in (named[0], min((i for k, i in enumerate(ids) if i is not None and k % 2), default=None)) for r in got.collect() if r.record_type == "revisit")


def test_headers_of_any_length(spark):
    """Addresses over any step that a header is read in: no page is lost, nor any that follows."""
    rows = [(i, "http://h/" + "u" * n, f"page {i}") for i, n in enumerate((5, 3_000_000, 7, 70_000, 1 << 20, 9))]
    path = scratch(spark, "warc-test")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    for size in (100_000, warc.RANGE):
        got = warc.read(spark, path, size, with_payload=True).collect()
        assert sorted((r.target_uri, bytes(r.payload).decode(), r.digest_ok) for r in got) == sorted((u, h, True) for _, u, h in rows)


@pytest.mark.parametrize("between", ["junk\r\n\r\n", "WARC/1.1\r\nContent-Length: many\r\n\r\n"])
def test_a_chain_that_breaks_within_a_file_is_an_error(spark, tmp_path, between):
    one = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((one + between + one).encode())
    for size in (30, 1000):
        with pytest.raises(Exception, match="no record at offset"):
            warc.read(spark, str(tmp_path), size).collect()
