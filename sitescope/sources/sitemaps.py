"""Sitemap files: addresses of urlset and sitemapindex documents, plain or gzipped."""

from __future__ import annotations

import gzip
import io

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host
from ..plans.batches import map_rows
from ..plans.scratch import table

# Most addresses and bytes of a file, most files of a site.
MAX_URLS, MAX_BYTES, MAX_FILES = 50_000, 50 * 1024 * 1024, 20


def parse(data: bytes) -> tuple[str, list[str]]:
    """(kind, addresses) of one file; ValueError says what is wrong with it."""
    from xml.etree import ElementTree

    if data[:2] == b"\x1f\x8b":
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            data = f.read(MAX_BYTES + 1)
    if len(data) > MAX_BYTES:
        raise ValueError("larger than 50 MB")
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise ValueError(f"not valid XML: {e}") from None
    name = root.tag.rpartition("}")[2].lower()
    if name not in ("urlset", "sitemapindex"):
        raise ValueError(f"unexpected root element <{name}>")
    found = [x.text.strip() for x in root.iter() if isinstance(x.tag, str) and x.tag.rpartition("}")[2].lower() == "loc" and (x.text or "").strip()]
    return name, found[:MAX_URLS]


def parse_files(files: DataFrame) -> DataFrame:
    """(url, status, kind, error, urls) of rows (url, content binary); null content: not_found."""

    def each(row: dict) -> list[dict]:
        out = {"url": row["url"], "status": "not_found", "kind": None, "error": None, "urls": []}
        if row["content"] is None:
            return [out]
        try:
            kind, found = parse(row["content"])
        except (ValueError, OSError, EOFError) as e:
            return [out | {"status": "error", "error": str(e)}]
        return [out | {"status": "ok", "kind": kind, "urls": found}]

    return map_rows(files.select("url", "content"), each, "url string, status string, kind string, error string, urls array<string>")


def expand_sites(files: DataFrame, starts: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log, urls) of all sites at once: follows sitemap indexes from ``starts`` (site, url) through the landed ``files``.

    Every level of all sites is one step over tables; there are at most MAX_FILES levels, as each site has at most so many
    files, taken in the order in which they are named. The log has a row per file (site, url, status, url_count, error, kind);
    files beyond the limit are skipped. ``urls`` (site, url) are the addresses of page lists on the site's ``hosts`` (site, host).
    """
    found = table(parse_files(files), "sitemaps")
    facts = found.select("url", "status", "kind", "error", F.size("urls").alias("url_count"))
    first = starts.groupBy("site", "url").agg(F.min(F.array(F.lit(0))).alias("at"))
    queue, seen, logs = table(first, "sitemap-queue"), None, []
    while queue.head(1):
        # places below a site's limit, less what it has taken already
        place = F.row_number().over(Window.partitionBy("site").orderBy("at", "url"))
        if seen is not None:
            queue = queue.join(seen.groupBy("site").agg(F.count("*").alias("before")), "site", "left")
            place = place + F.coalesce("before", F.lit(0))
        queue = table(queue.withColumn("taken", place <= MAX_FILES), "sitemap-places")
        now = queue.where("taken").select("site", "url", "at")
        rows = now.join(facts, "url", "left").withColumn("status", F.coalesce("status", F.lit("not_found"))).fillna({"url_count": 0})
        skipped = queue.where("NOT taken").select("site", "url", F.lit("skipped").alias("status"), F.lit(0).alias("url_count"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("kind"))
        logs.append(rows.select("site", "url", "status", "url_count", "error", "kind").unionByName(skipped))
        seen = table(now.select("site", "url") if seen is None else seen.unionByName(now.select("site", "url")), "sitemap-seen")
        named = now.join(found.where("kind = 'sitemapindex'"), "url").select("site", "at", F.posexplode("urls").alias("n", "url"))
        named = named.groupBy("site", "url").agg(F.min(F.concat("at", F.array("n"))).alias("at"))
        queue = table(named.join(seen, ["site", "url"], "left_anti"), "sitemap-queue")
    if not logs:
        empty = "site string, url string, status string, url_count int, error string, kind string"
        return starts.sparkSession.createDataFrame([], empty), starts.select("site", "url").limit(0)
    log = logs[0]
    for more in logs[1:]:
        log = log.unionByName(more)
    pages = seen.join(found.where("kind = 'urlset'"), "url").select("site", F.explode("urls").alias("url"))
    inside = pages.withColumn("host", host(F.col("url"))).join(hosts, ["site", "host"], "left_semi")
    return log, inside.select("site", "url").distinct()


def expand(files: DataFrame, start: list[str], allowed_hosts: list[str]) -> tuple[DataFrame, DataFrame]:
    """``expand_sites`` for one site: (log, urls) without the site."""
    spark = files.sparkSession
    starts = spark.createDataFrame([("", u) for u in start], "site string, url string")
    log, urls = expand_sites(files, starts, spark.createDataFrame([("", h) for h in allowed_hosts], "site string, host string"))
    return log.drop("site"), urls.drop("site")
