"""Queries that follow sitemaps and links of many sites at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import context
from ..sources import sitemaps
from .base import read

HOST = "concat('https://h', s, '.example.org/')"


def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of supplier s: an index of s % 25 lists, each with three addresses; every fifth list is broken, every seventh missing."""
    sites = read(spark, sf_dir, "supplier").selectExpr("s_suppkey AS s", "s_suppkey % 25 AS n")
    loc = f"transform(sequence(0, 30), j -> concat('<sitemap><loc> ', {HOST}, j, '.xml</loc></sitemap>'))"
    index = sites.selectExpr(f"concat({HOST}, 'i.xml') AS url", f"concat('<sitemapindex>', array_join(slice({loc}, 1, CAST(n AS INT)), ''), '<sitemap><loc>', {HOST}, '0.xml</loc></sitemap></sitemapindex>') AS x")
    lists = sites.select("s", "n", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("j")).where("j < n AND (s + j) % 7 <> 0")
    entry = f"concat('<url><loc>', {HOST}, 'p', j % 4, '</loc></url><url><loc>', {HOST}, j, '</loc></url><url><loc>https://away.example.net/', j, '</loc></url>')"
    lists = lists.selectExpr(f"concat({HOST}, j, '.xml') AS url", f"CASE WHEN (s + j) % 5 = 0 THEN '<feed/>' ELSE concat('<urlset>', {entry}, '</urlset>') END AS x")
    return index.unionByName(lists).select("url", F.encode("x", "UTF-8").alias("content"))


def _expanded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sites = read(spark, sf_dir, "supplier").selectExpr("CAST(s_suppkey AS STRING) AS site", "s_suppkey AS s")
    starts = sites.selectExpr("site", f"concat({HOST}, 'i.xml') AS url")
    return sitemaps.expand_sites(sitemap_files(spark, sf_dir), starts, sites.selectExpr("site", "concat('h', s, '.example.org') AS host"))


def sitemap_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir)[0].select("site", "url", "status", "url_count", "kind")


def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir)[1]


def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of suppliers: parts that are ordered together link to each other, the first part of a site is its root."""
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 20 AS site", "CAST(l_partkey % 97 AS STRING) AS source", "CAST(l_orderkey % 101 AS STRING) AS target").where("source % 3 = 0")
    roots = rows.groupBy("site").agg(F.min("source").alias("url"))
    listed = read(spark, sf_dir, "supplier").selectExpr("s_suppkey % 20 AS site", "concat('s', s_suppkey % 41) AS url")
    return context.frontier(rows, roots, listed, 2, 60)


SITEMAP_CTE = """f AS (SELECT s_suppkey AS s, unnest(range(0, s_suppkey % 25)) AS j, 'https://h' || s_suppkey || '.example.org/' AS h FROM supplier),
one AS (SELECT s_suppkey AS s, 0 AS j, 'https://h' || s_suppkey || '.example.org/' AS h FROM supplier WHERE s_suppkey % 25 = 0),
g AS (SELECT *, CASE WHEN j >= 19 THEN 'skipped' WHEN (s + j) % 7 = 0 OR s % 25 = 0 THEN 'not_found' WHEN (s + j) % 5 = 0 THEN 'error' ELSE 'ok' END AS status FROM (SELECT * FROM f UNION ALL SELECT * FROM one))"""
SQL = {
    "sitemap_log": f"""WITH {SITEMAP_CTE} SELECT s::VARCHAR AS site, h || j || '.xml' AS url, status, CASE status WHEN 'ok' THEN 3 ELSE 0 END AS url_count, CASE status WHEN 'ok' THEN 'urlset' END AS kind FROM g
UNION ALL SELECT s_suppkey::VARCHAR, 'https://h' || s_suppkey || '.example.org/i.xml', 'ok', (s_suppkey % 25 + 1)::INT, 'sitemapindex' FROM supplier""",
    "sitemap_urls": f"WITH {SITEMAP_CTE} SELECT DISTINCT s::VARCHAR AS site, h || x AS url FROM (SELECT s, h, unnest(['p' || j % 4, j::VARCHAR]) AS x FROM g WHERE status = 'ok')",
    "crawl_frontier": """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_suppkey % 20 AS site, (l_partkey % 97)::VARCHAR AS source, (l_orderkey % 101)::VARCHAR AS target FROM lineitem WHERE l_partkey % 97 % 3 = 0),
w(site, url, depth) AS (SELECT site, min(source), 0 FROM e GROUP BY site UNION SELECT w.site, e.target, w.depth + 1 FROM w JOIN e ON w.site = e.site AND w.url = e.source WHERE w.depth < 2),
d AS (SELECT site, url, min(depth)::INT AS depth FROM w GROUP BY site, url), s AS (SELECT DISTINCT s_suppkey % 20 AS site, 's' || s_suppkey % 41 AS url FROM supplier),
a AS (SELECT * FROM d UNION ALL SELECT site, url, NULL FROM s WHERE (site, url) NOT IN (SELECT site, url FROM d)),
p AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth NULLS LAST, url)::INT AS place FROM a)
SELECT site, url, depth, CASE WHEN depth = 0 THEN 'root' WHEN depth > 0 THEN 'link' ELSE 'sitemap' END AS via, place, place <= 60 AS crawled FROM p""",
}
QUERIES = {"sitemap_log": sitemap_log, "sitemap_urls": sitemap_urls, "crawl_frontier": crawl_frontier}
