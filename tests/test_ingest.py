"""The ingest stream against its batch, with a restart and a repeated batch."""

import os

from pyspark.sql import functions as F

from sitescope.queries import ingest as log
from sitescope.sources import ingest

from .conftest import DATA


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).drop("batch_id").collect()))


def test_stream_restart_and_repeated_batch(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    fetches = log.fetch_log(spark, DATA)
    before = log.before(spark, DATA)
    half = F.col("url").rlike("[02468]$")

    def run():
        stream = spark.readStream.schema(fetches.schema).parquet(src)
        ingest.ingest(stream, out, cp, before).start().awaitTermination(120)

    fetches.where(half).coalesce(1).write.mode("append").parquet(src)
    run()
    fetches.where(~half).coalesce(1).write.mode("append").parquet(src)
    run()
    pages, links = ingest.ingested(spark, out)
    want = ingest.first_fetched(ingest.pages_of(fetches, before))
    first, first_links = rows(pages), rows(links)
    assert first == rows(want.drop("links")) and first_links == rows(ingest.links_of(want)) and first_links
    assert {r["batch_id"] for r in pages.select("batch_id").distinct().collect()} == {0, 1}

    # The last batch is not known as finished: it is run again, and replaces what it wrote.
    for f in ("1", ".1.crc"):
        os.unlink(f"{cp}/commits/{f}")
    run()
    again, links_again = ingest.ingested(spark, out)
    assert rows(again) == first and rows(links_again) == first_links
    assert spark.read.parquet(f"{out}/pages").count() == ingest.pages_of(fetches, before).count()


def test_odd_fetches(spark):
    """Nulls, an unknown outcome, a missing type, an empty page, a chain without an end."""
    hop = [("https://e.org/a", 301, 4)]
    cases = [
        ("a", "ok", 200, "text/html", "<title>T</title>", None, []),
        ("b", "ok", 200, None, "x", None, []),
        ("c", "ok", None, None, None, None, None),
        ("d", "not_modified", 304, None, None, None, []),
        ("e", "ok", 200, "TEXT/HTML ; x", None, None, []),
        ("f", "ok", 301, "text/html", None, None, hop),
        ("g", "ok", 200, "text/html", "<a href='/x'>X</a><a href='//o.org/'></a>", "https://e.org/g2", hop),
        ("h", "too_large", None, None, None, None, hop),
        (None, None, None, None, None, None, None),
    ]
    made = [("c", u and f"https://e.org/{u}", 0, "link", o, s, t, {}, body, 1, None, end, chain, None, ["e.org"]) for u, o, s, t, body, end, chain in cases]
    found = ingest.pages_of(spark.createDataFrame(made, ingest.FETCH), None)
    got = sorted((r["url"] or "", r["fetch_status"], r["status_code"], r["title"], r["internal_links_count"], r["external_links_count"]) for r in found.collect())
    e = "https://e.org/"
    assert got == [
        ("", "fetched", None, None, 0, 0),
        (e + "a", "fetched", 200, "T", 0, 0),
        (e + "b", "skipped_content_type", 200, None, 0, 0),
        (e + "c", "fetched", None, None, 0, 0),
        (e + "d", "fetched", 304, None, 0, 0),
        (e + "e", "fetched", 200, None, 0, 0),
        (e + "f", "fetched", 301, None, 0, 0),
        (e + "g", "fetched", 301, None, 0, 0),
        (e + "g2", "fetched", 200, None, 1, 1),
        (e + "h", "too_large", None, None, 0, 0),
    ]
    assert ingest.counts(found).first()["failed"] == 1
