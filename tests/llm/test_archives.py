"""Operator 1: both ARC versions, records as declared, revisits, damage."""

import base64
import collections
import hashlib

import pytest

from sealtable.llm import archives, common
from sealtable.session import work_path

PAGES = [
    (1, "http://a.example/x y", "<p>one</p>"), (2, "http://a.example/2", "<p>one</p>"), (3, None, None),
    (4, "https://b.example/ä", ""), (5, "http://c.example/", "line\r\n\r\nWARC/1.1\r\nfiledesc: 1 2 3\n\n"),
    (6, "dns:c.example", "<p>one</p>"), (7, "http://d.example/\n", "x" * 200_000), (8, "http://e.example/", "漢字\x00\x01"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(pages, min_bytes=0):
    groups = collections.defaultdict(list)
    for page, _, html in pages:
        groups[html or ""].append(page)
    for page, _, html in pages:
        raw = (html or "").encode()
        top = max(groups[html or ""])
        again = page != top and len(raw) >= min_bytes
        yield page, len(raw), digest(html), "revisit" if again else "response", top if again else None


def converted(spark, pages, version=1, min_bytes=0):
    arc, warc = work_path(spark, "arc"), work_path(spark, "warc")
    archives._lines(archives.arc_records(pages, version), arc)
    archives.convert(spark, arc, warc, min_bytes)
    return archives.resolved(archives.read_warc(spark, warc))


@pytest.mark.parametrize("version, min_bytes", [(1, 0), (2, 0), (1, 11)])
def test_pages_come_back(spark, version, min_bytes):
    rows = [p for p in PAGES if p[0] != 6]
    pages = spark.createDataFrame([(*p, "x", 7) for p in rows], "page_id long, url string, html string, body string, part int")
    got = converted(spark, pages.repartition(3), version, min_bytes).collect()
    assert sorted(r[:5] for r in got) == sorted(expected(rows, min_bytes))
    assert {r.url for r in got if r.page_id in (1, 3, 4, 7)} == {
        "http://a.example/x%20y", "unknown:", "https://b.example/%C3%A4", "http://d.example/%0A"
    }


def test_other_schemes_are_resources(spark):
    pages = spark.createDataFrame(PAGES[5:6], "page_id long, url string, html string")
    (row,) = converted(spark, pages).collect()
    assert row.record_type == "resource" and row.page_id is None


def test_edge_rows(spark):
    pages = spark.createDataFrame(
        [(None, "http://a/", "same"), (2, "http://a/", "same"), (2, "http://a/", "same")], "page_id long, url string, html string"
    )
    got = converted(spark, pages).collect()
    assert collections.Counter(r.record_type for r in got) == {"response": 1, "revisit": 2}
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {2}
    assert converted(spark, pages.limit(0)).count() == 0


def test_hot_payload(spark):
    pages = spark.range(3000).selectExpr("id page_id", "'http://a/' url", "if(id % 3 = 0, 'hot', string(id)) html")
    got = converted(spark, pages.repartition(4)).collect()
    hot = [r for r in got if r.page_id % 3 == 0]
    assert {r.refers_to for r in hot if r.record_type == "revisit"} == {2997} and len(hot) == 1000
    assert sum(r.record_type == "response" for r in got) == 2001


def test_arc_header_lines():
    one = b"filedesc://f 0.0.0.0 20010203040506 text/plain %d\n" % (len(archives.ARC_FIELDS[1]) + 7)
    one += b"1 0 me\n" + archives.ARC_FIELDS[1].encode() + b"\n"
    rest = b"http://a/ 1.2.3.4 20010203 text/html 3\nabc\n"
    records = list(archives.parse_arc(one + rest))
    assert [r["content"] for r in records][1:] == [b"abc"] and records[1]["version"] == 1
    for bad in (one + rest[:-3], one + b"http://a/ text/html 3\nabc\n", rest, one + b"no line"):
        with pytest.raises(ValueError):
            list(archives.parse_arc(bad))
    assert archives.iso_date("20010203") == "2001-02-03T00:00:00Z"
    assert archives.iso_date("200102030405") == "2001-02-03T04:05:00Z"
    assert archives.iso_date("2001") == "2001-01-01T00:00:00Z"


def test_long_members_end_with_zero(monkeypatch):
    monkeypatch.setattr(archives, "_MEMBER_LIMIT", 100)
    for raw in (b"a" * 99, b"a" * 100, b"b" * 5000):
        packed = archives.member(raw)
        assert packed[-1] == 0 and list(archives.members(packed * 2)) == [raw, raw]
    with pytest.raises(ValueError):
        list(archives.members(packed[:-3]))


def test_given_pages(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(p.page_id, p.url, p.html) for p in common.table(spark, sf_dir, "pages").collect()]
    assert sorted(map(tuple, archives.op1_warc(spark, sf_dir).collect())) == sorted(expected(rows))


def test_query_returns_pages_of_any_url(spark):
    rows = [*PAGES, (9, "ftp://f/x", "<p>one</p>"), (10, "/x", "relative"), (11, "example.com/x", None), (12, "filedesc://x", "twelve")]
    sf_dir = work_path(spark, "tables")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{sf_dir}/pages.parquet")
    assert sorted(map(tuple, archives.op1_warc(spark, sf_dir).collect())) == sorted(expected(rows))
