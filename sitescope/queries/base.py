"""Inputs of the queries: crawl relations made from the test tables by plain expressions that both engines read."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.context import Context
from ..plans.settings import Settings


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A crawl of ``pages`` with simulated answers: (column, expression).
PAGES = (
    ("id", "concat('p', CAST(page_id AS STRING))"),
    ("crawl_job_id", "'c1'"),
    ("page_id", "page_id"),
    ("url", "url"),
    ("status_code", "CAST(CASE page_id % 20 WHEN 3 THEN 404 WHEN 7 THEN 500 WHEN 11 THEN 301 WHEN 13 THEN NULL ELSE 200 END AS INT)"),
    ("fetch_status", "CASE WHEN page_id % 20 = 13 THEN 'error' WHEN page_id % 25 = 4 THEN 'blocked_by_robots' ELSE 'fetched' END"),
    ("content_type", "CASE WHEN page_id % 30 = 9 THEN 'application/pdf' ELSE 'text/html' END"),
    ("response_time_ms", "CAST(50 + (page_id * 37) % 4000 AS INT)"),
    ("depth", "CAST(CASE WHEN page_id % 17 = 0 THEN NULL ELSE page_id % 6 END AS INT)"),
    ("in_sitemap", "page_id % 3 <> 0"),
    ("is_noindex", "page_id % 11 = 5"),
    ("is_orphan", "page_id % 13 = 6"),
    ("important", "page_id % 23 = 0"),
    ("inlinks_count", "CAST(page_id % 5 AS INT)"),
    ("internal_links_count", "CAST(page_id % 4 AS INT)"),
    ("external_links_count", "CAST((page_id * 7) % 200 AS INT)"),
    ("canonical_count", "CAST(CASE page_id % 9 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS INT)"),
    ("canonical_url", "CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 13 = 2 THEN 'https://elsewhere.example.org/' WHEN page_id % 13 = 3 THEN lead(url) OVER (PARTITION BY page_id % 7 ORDER BY page_id) ELSE url END"),
    ("title", "CASE WHEN page_id % 21 = 8 THEN '' WHEN page_id % 10 = 2 THEN concat('Course  Overview ', CAST(page_id % 7 AS STRING)) ELSE trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) END"),
    ("title_count", "CAST(CASE WHEN page_id % 19 = 6 THEN 2 ELSE 1 END AS INT)"),
    ("meta_description", "CASE page_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'Too short' WHEN 2 THEN repeat('A long description of the page. ', 8) ELSE concat('Description of page group ', CAST(page_id % 40 AS STRING), ' with enough words to be a useful description for searchers') END"),
    ("meta_description_count", "CAST(CASE page_id % 8 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS INT)"),
    ("h1_count", "CAST(CASE page_id % 14 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS INT)"),
    ("skips_level", "page_id % 6 = 1"),
    ("lang", "CASE WHEN page_id % 16 = 4 THEN '' ELSE regexp_extract(html, '(?i)<html[^>]*lang=\"([^\"]*)\"', 1) END"),
    ("word_count", "CAST((page_id * 13) % 700 AS INT)"),
    ("content_hash", "CASE WHEN page_id % 12 < 4 THEN concat('h', CAST(page_id % 60 AS STRING)) ELSE md5(url) END"),
    ("images_missing_alt", "CAST(page_id % 7 AS INT)"),
    ("redirects", "CAST(CASE WHEN page_id % 20 = 11 THEN page_id % 4 ELSE 0 END AS INT)"),
)
SIM_PAGES = "sim AS MATERIALIZED (SELECT " + ", ".join(f"{e} AS {n}" for n, e in PAGES) + " FROM pages)"
#: With the derived columns of the rules.
SIM_CTX = (
    SIM_PAGES
    + """,
ana AS MATERIALIZED (SELECT *, coalesce(fetch_status IN ('fetched', 'not_modified') AND status_code BETWEEN 200 AND 299 AND content_type IN ('text/html', 'application/xhtml+xml'), false) AS analysable,
    coalesce(canonical_url <> '' AND canonical_url <> url, false) AS elsewhere, coalesce(status_code BETWEEN 300 AND 399, false) AS redirected FROM sim),
ctx AS MATERIALIZED (SELECT *, analysable AND NOT is_noindex AND NOT elsewhere AS indexable FROM ana)"""
)
ROOT = "https://example.org/"


def sim_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").selectExpr(*[f"{e} AS {n}" for n, e in PAGES])
    hop = F.struct(F.col("url").alias("url"), F.lit(301).alias("status_code"), F.lit(5).alias("elapsed_ms"))
    head = lambda n: F.struct(F.lit(n).alias("level"), F.concat(F.lit("Heading "), F.lit(str(n))).alias("text"))
    image = F.struct(F.lit("/a.png").alias("src"), F.lit(None).cast("string").alias("alt"), F.lit(False).alias("has_alt"))
    return rows.withColumns({"redirect_chain": F.array_repeat(hop, F.col("redirects")), "headings": F.when(F.col("skips_level"), F.array(head(1), head(3))).otherwise(F.array(head(1), head(2), head(3))), "images": F.array_repeat(image, F.col("images_missing_alt"))})


def job(spark: SparkSession, warnings: tuple[str, ...] = (), robots: str = "not_found") -> DataFrame:
    row = ("c1", datetime.datetime(2026, 9, 1), list(warnings), robots, [("https://example.org/sitemap.xml", "ok"), ("https://example.org/old.xml", "error")], 0)
    return spark.createDataFrame([row], "id string, finished_at timestamp, warnings array<string>, robots_status string, sitemaps array<struct<url: string, status: string>>, sitemap_url_count int")


def sim_context(spark: SparkSession, sf_dir: str, settings: Settings | None = None) -> Context:
    pages = sim_pages(spark, sf_dir)
    ctx = Context.of(pages, sim_links(spark, sf_dir), job(spark), settings or Settings(root_url=ROOT, allowed_hosts=("example.org",)))
    ctx.pages = ctx.pages.withColumn("important", F.col("page_id") % 23 == 0)
    return ctx


#: Links between the pages: lineitem as edges from a page to another.
LINKS = "links AS MATERIALIZED (SELECT concat('p', CAST(l_suppkey % n AS STRING)) AS source_id, concat('p', CAST(l_partkey % n AS STRING)) AS target_id, l_returnflag <> 'R' AS is_internal, l_linestatus = 'F' AND l_linenumber = 1 AS nofollow, concat('https://example.org/', CAST(l_partkey % 50 AS STRING)) AS target_url FROM lineitem CROSS JOIN (SELECT count(*) AS n FROM pages))"


def sim_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "pages").agg(F.count("*").alias("n"))
    name = lambda c: F.concat(F.lit("p"), (F.col(c) % F.col("n")).cast("string"))
    rows = read(spark, sf_dir, "lineitem").join(F.broadcast(n), F.lit(True))  # one row
    return rows.select(name("l_suppkey").alias("source_id"), name("l_partkey").alias("target_id"), (F.col("l_returnflag") != "R").alias("is_internal"), ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1)).alias("nofollow"), F.concat(F.lit("https://example.org/"), (F.col("l_partkey") % 50).cast("string")).alias("target_url"))


#: Issues: orders as the state of issues of projects.
ISSUES = """issues AS MATERIALIZED (SELECT concat('i', CAST(o_orderkey AS STRING)) AS issue_key, o_custkey AS project_id,
    CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'ignored' END AS status,
    CASE o_orderkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'informational' END AS severity,
    CASE o_orderkey % 7 WHEN 0 THEN 'technical' WHEN 1 THEN 'on_page' WHEN 2 THEN 'on_page' WHEN 3 THEN 'content' WHEN 4 THEN 'internal_linking' ELSE 'structured_data' END AS category,
    CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS effort,
    CASE o_orderkey % 4 WHEN 0 THEN 'onpage.title_length' WHEN 1 THEN 'tech.redirect_chain' WHEN 2 THEN 'content.thin' ELSE 'onpage.meta_description_missing' END AS rule_id,
    CASE WHEN o_orderkey % 10 = 0 THEN 'site' ELSE 'page' END AS scope, o_totalprice / 10000.0 AS priority, CAST(o_orderkey % 30 + 1 AS INT) AS affected_page_count,
    o_orderkey % 40 AS page_no, o_orderdate AS detected_at, o_orderpriority AS title, concat('https://example.org/', CAST(o_orderkey % 40 AS STRING)) AS primary_url,
    CASE WHEN o_orderkey % 6 = 0 THEN 'c9' ELSE 'c1' END AS first_crawl, CASE WHEN o_orderkey % 8 = 1 THEN 'c9' END AS resolved_in FROM orders)"""


def sim_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = ISSUES.split("(SELECT ", 1)[1].rsplit(" FROM orders)", 1)[0]
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders_of_issues")
    rows = spark.sql(f"SELECT {body} FROM orders_of_issues")
    return rows.withColumn("affected_urls", F.array("primary_url"))


#: Days of search figures: events by their day and page.
DAYS = """days AS MATERIALIZED (SELECT json_extract_string(props, '$.k') AS page, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click')::BIGINT AS clicks, count(*)::BIGINT AS impressions, floor(avg(value) / 10.0 * 100 + 0.5) / 100 AS position FROM events GROUP BY 1, 2)"""


def sim_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("page"), F.to_date("ts").alias("day"), "event_type", "value")
    return rows.groupBy("page", "day").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count("*").alias("impressions"), (F.floor(F.avg("value") / 10.0 * 100 + 0.5) / 100).alias("position"))
