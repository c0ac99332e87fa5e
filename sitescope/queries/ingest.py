"""Queries from a log of fetches to pages, links and counts. The log is made of ``pages``: every twelfth has the same fate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ingest
from .base import read
from .scans import _PLAIN

OWN = "concat('https://example.org/p/', page_id)"
#: The log, by fate: 0 blocked, 1 error, 2 moved, 3 moved away, 4 unchanged, 5 unchanged but unknown, 6 PDF, 7 not found, 8 moved to
#: the next page's address, others pages.
LOG = f"""SELECT 'c' || CAST(page_id % 36 DIV 12 AS STRING) AS crawl_id, {OWN} AS url, CAST(page_id % 5 AS INT) AS depth, 'link' AS via,
CASE fate WHEN 0 THEN 'blocked_by_robots' WHEN 1 THEN 'error' WHEN 3 THEN 'redirect_out_of_scope' WHEN 4 THEN 'not_modified' WHEN 5 THEN 'not_modified' ELSE 'ok' END AS outcome,
CAST(CASE WHEN fate IN (0, 1) THEN NULL WHEN fate = 3 THEN 302 WHEN fate IN (4, 5) THEN 304 WHEN fate = 7 THEN 404 ELSE 200 END AS INT) AS status_code,
CASE WHEN fate = 6 THEN 'application/pdf' WHEN fate > 1 THEN 'Text/HTML; charset=utf-8' END AS content_type,
map('x-robots-tag', CASE WHEN fate = 10 THEN 'bot: NOINDEX' ELSE '' END, 'content-length', '77', 'etag', concat('"', page_id, '"')) AS headers,
CASE WHEN fate IN (2, 7, 8) OR fate > 8 THEN html END AS body, CAST(100 + page_id % 7 AS INT) AS elapsed_ms, CASE WHEN fate = 1 THEN 'timed out' END AS error,
CASE WHEN fate = 2 THEN concat('https://example.org/m/', page_id) WHEN fate = 3 THEN 'https://away.example.net/' WHEN fate = 8 THEN concat('https://example.org/p/', page_id + 1) WHEN fate > 1 THEN {OWN} END AS final_url,
CASE WHEN fate IN (2, 3, 8) THEN array(named_struct('url', {OWN}, 'status_code', 301, 'elapsed_ms', 5)) ELSE array() END AS redirect_chain,
timestamp_seconds(1767225600 + page_id) AS fetched_at, array('example.org') AS allowed_hosts FROM (SELECT *, page_id % 12 AS fate FROM {{pages}})"""


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOG.format(pages="{pages}"), pages=read(spark, sf_dir, "pages"))


def before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl before: every page that answers 304 now, under the fate 4, with two links."""
    rows = read(spark, sf_dir, "pages").where("page_id % 12 = 4")
    empty = ingest.pages_of(fetch_log(spark, sf_dir)).schema
    made = {"status_code": "200", "content_type": "'text/html'", "title": "concat('Old ', page_id)", "word_count": "CAST(page_id % 100 AS INT)", "is_noindex": "page_id % 24 = 4", "internal_links_count": "1", "external_links_count": "1"}
    pages = rows.selectExpr("'c' || CAST(page_id % 36 DIV 12 AS STRING) AS crawl_id", f"{OWN} AS url", "CAST(page_id AS STRING) AS id", *[f"CAST({made.get(c, 'NULL')} AS {empty[c].dataType.simpleString()}) AS {c}" for c in ingest.COPIED])
    link = "inline(array(named_struct('target_url', 'https://example.org/a', 'anchor_text', 'A', 'nofollow', false), named_struct('target_url', 'https://away.example.net/', 'anchor_text', '', 'nofollow', true)))"
    return ingest.previous_crawl(pages, rows.selectExpr("CAST(page_id AS STRING) AS source_id", link))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.first_fetched(ingest.pages_of(fetch_log(spark, sf_dir), before(spark, sf_dir)))


def ingest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir)
    return rows.select("crawl_id", "url", "fetch_status", "status_code", "response_time_ms", "content_type", "title", "word_count", "is_noindex", "internal_links_count", "external_links_count", F.size("redirect_chain").alias("hops"), "etag", "x_robots_tag")


def ingest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    rows = ingest.links_of(pages).join(pages.select(F.col("id").alias("source_id"), F.col("url").alias("source_url")), "source_id")
    return rows.select("crawl_id", "source_url", "target_url", "is_internal", "nofollow", "anchor_text")


def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.counts(_pages(spark, sf_dir))


PAGES_CTE = rf"""f AS (SELECT page_id, page_id % 12 AS fate, 'c' || (page_id % 36 // 12) AS crawl_id, 'https://example.org/p/' || page_id AS own, regexp_replace(html, '<[a-zA-Z/!][^>]*$', '') AS html FROM pages),
g AS (SELECT *, trim(regexp_replace({_PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\s+', ' ', 'g')) AS t,
    len(regexp_extract_all({_PLAIN.format("regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<[a-zA-Z/!][^>]*>', ' ', 'g')")}, '[\p{{L}}\p{{N}}_]+'))::INT AS words, list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM f),
asked AS (SELECT page_id, crawl_id, own AS url, CASE fate WHEN 0 THEN 'blocked_by_robots' WHEN 1 THEN 'error' WHEN 3 THEN 'redirect_out_of_scope' WHEN 4 THEN 'not_modified' WHEN 6 THEN 'skipped_content_type' ELSE 'fetched' END AS fetch_status,
    CASE WHEN fate IN (0, 1) THEN NULL WHEN fate IN (2, 3, 8) THEN 301 WHEN fate = 5 THEN 304 WHEN fate = 7 THEN 404 ELSE 200 END AS status_code, CASE WHEN fate IN (2, 3, 8) THEN 5 ELSE (100 + page_id % 7)::INT END AS response_time_ms,
    CASE WHEN fate = 4 THEN 'text/html' WHEN fate = 6 THEN 'application/pdf' WHEN fate IN (0, 1, 2, 3, 8) THEN NULL ELSE 'Text/HTML; charset=utf-8' END AS content_type, CASE WHEN fate = 4 THEN 'Old ' || page_id WHEN fate > 8 THEN t END AS title,
    CASE WHEN fate = 4 THEN (page_id % 100)::INT WHEN fate > 8 THEN words ELSE 0 END AS word_count, CASE WHEN fate = 4 THEN page_id % 24 = 4 ELSE fate = 10 END AS is_noindex,
    CASE WHEN fate = 4 THEN 1 WHEN fate > 8 THEN len(h) ELSE 0 END::INT AS internal_links_count, CASE WHEN fate = 4 THEN 1 ELSE 0 END::INT AS external_links_count, CASE WHEN fate IN (2, 3, 8) THEN 1 ELSE 0 END::INT AS hops, CASE WHEN fate > 8 THEN h END AS h, fate = 4 AS old, CASE WHEN fate = 10 THEN 'bot: NOINDEX' END AS x_robots_tag FROM g),
ended AS (SELECT page_id, crawl_id, CASE fate WHEN 2 THEN 'https://example.org/m/' || page_id ELSE 'https://example.org/p/' || (page_id + 1) END AS url, 'fetched', 200, (100 + page_id % 7)::INT, 'Text/HTML; charset=utf-8', t, words, false, len(h)::INT, 0, 0, h, false, NULL FROM g WHERE fate IN (2, 8)),
every AS (SELECT * FROM asked UNION ALL SELECT * FROM ended),
pg AS MATERIALIZED (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY crawl_id, url ORDER BY page_id) = 1)"""
SQL = {
    "ingest_pages": f"WITH {PAGES_CTE} SELECT crawl_id, url, fetch_status, status_code::INT AS status_code, response_time_ms, content_type, title, word_count, is_noindex, internal_links_count, external_links_count, hops, CASE WHEN true THEN '\"' || page_id || '\"' END AS etag, CASE WHEN NOT old THEN x_robots_tag END AS x_robots_tag FROM pg",
    "ingest_links": f"""WITH {PAGES_CTE} SELECT crawl_id, url AS source_url, 'https://example.org' || x AS target_url, true AS is_internal, false AS nofollow, regexp_extract(x, '/(.*)', 1) AS anchor_text FROM (SELECT crawl_id, url, unnest(h) AS x FROM pg)
UNION ALL SELECT crawl_id, url, 'https://example.org/a', true, false, 'A' FROM pg WHERE old UNION ALL SELECT crawl_id, url, 'https://away.example.net/', false, true, NULL FROM pg WHERE old""",
    "ingest_counts": f"WITH {PAGES_CTE} SELECT crawl_id, count(*) FILTER (fetch_status NOT IN ('error', 'blocked_by_robots')) AS crawled, count(*) FILTER (fetch_status = 'blocked_by_robots') AS blocked, count(*) FILTER (fetch_status = 'error') AS failed FROM pg GROUP BY crawl_id",
}
QUERIES = {"ingest_pages": ingest_pages, "ingest_links": ingest_links, "ingest_counts": ingest_counts}
