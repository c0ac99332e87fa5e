import base64
import hashlib
from collections import defaultdict

import pytest

from sitescope.llm import warc

from ..conftest import DATA


def expected(pages):
    groups = defaultdict(list)
    for i, html in pages:
        groups[html or ""].append(i)
    out = []
    for i, html in pages:
        data, top = (html or "").encode(), max((x for x in groups[html or ""] if x is not None), default=None)
        own = i == top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else top))
    return sorted(out, key=str)


def test_pages(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet")
    got = sorted((tuple(r) for r in warc.archive_report(rows).collect()), key=str)
    assert got == expected([(r["page_id"], r["html"]) for r in rows.collect()])


def test_odd_pages(spark):
    rows = [(1, "http://A.com/x", "<p>"), (2, "http://a.com/x", "<p>"), (3, None, None), (4, "http://b.com:8080/ü\tq?\n", ""), (5, "bad url [", "x" * 100_000), (5, "bad url [", "x" * 100_000), (None, "http://n", "<p>"), (-7, "", "neg")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    got = sorted((tuple(r) for r in warc.archive_report(df).collect()), key=str)
    assert got == expected([(i, h) for i, _, h in rows])
    assert warc.archive_report(df.limit(0)).count() == 0


def test_small_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "v", "ab"), (3, "w", "abc"), (4, "x", "abc")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.archive_report(df, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_many_equal_pairs(spark):
    df = spark.range(2800).selectExpr("id AS page_id", "concat('https://h/', id) AS url", "concat('<p>', id % 1400) AS html")
    got = {r["page_id"]: r["refers_to"] for r in warc.decide(df).collect()}
    assert got == {i: i + 1400 if i < 1400 else None for i in range(2800)}


def test_index_finds_captures_by_key(spark):
    df = spark.range(3000).selectExpr("id AS page_id", "concat('https://h', id % 7, '.example.org/p', id) AS url", "concat('<p>', id) AS html")
    folder = warc.scratch_path(spark, "t")
    captures = warc.write_archives(df, folder)
    index = warc.build_index(captures, folder, block_lines=16, shards=3)
    wanted = spark.createDataFrame([(warc.url_key("https://h5.example.org/p1237"), 1237), ("nothing)/", 1), (warc.url_key("https://h0.example.org/p0"), 0)], "key string, page_id long")
    found = warc.fetch(warc.lookup(index, folder, wanted), folder, payloads=True)
    assert sorted((r["page_id"], bytes(r["payload"])) for r in found.collect()) == [(0, b"<p>0"), (1237, b"<p>1237")]


def test_records_round_trip():
    data = warc.record(7, "https://example.org/", b"<p>\r\n\r\n</p>")
    back = warc.parse(data)
    assert back["payload"] == b"<p>\r\n\r\n</p>" and back["kind"] == "response"
    with pytest.raises(ValueError):
        warc.parse(data.replace(b"<p>", b"<q>"))
    assert warc.url_key("https://WWW.Example.org:443/A?b=1#c") == "org,example,www)/a?b=1"
