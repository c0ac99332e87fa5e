"""Queries on crawl settings and landed errors. Customers are projects with settings of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import crawling
from ..sources import landing
from .base import read

#: Projects, in SQL of both engines.
PROJECTS = """SELECT c_custkey AS project_id, CASE c_custkey % 5 WHEN 0 THEN 'https://www.Site' || CAST(c_custkey AS STRING) || '.org/' WHEN 1 THEN 'https://site' || CAST(c_custkey AS STRING) || '.org:8443/x' WHEN 2 THEN 'http://10.0.0.' || CAST(c_custkey % 250 AS STRING) || '/'
WHEN 3 THEN 'http://localhost:80/' ELSE 'https://site' || CAST(c_custkey AS STRING) || '.org/' END AS root_url, CAST(c_custkey % 900 AS INT) AS max_pages, CAST(c_custkey % 14 AS INT) AS max_depth, CAST(c_custkey % 9 AS INT) AS concurrency,
CAST(CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 700 END AS INT) AS org_max_pages, CAST(CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 12 END AS INT) AS org_max_depth, CAST(NULL AS INT) AS org_concurrency, CAST(CASE WHEN c_custkey % 6 > 0 THEN c_custkey % 7 * 60 END AS INT) AS plan_pages FROM customer"""


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(PROJECTS.replace("FROM customer", "FROM {customer}"), customer=read(spark, sf_dir, "customer"))
    return rows.withColumn("extra_hosts", F.when(F.col("project_id") % 2 == 0, F.array(F.lit("apply.example.org"), F.lit("www.example.org"))))


def crawl_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawling.crawl_config(projects(spark, sf_dir))
    joined = lambda c: F.array_join(c, ",")
    return rows.select("project_id", joined("hosts").alias("hosts"), joined("extra_ports").alias("extra_ports"), "max_pages", "max_depth", "concurrency", joined(crawling.search_hosts(F.col("root_url"))).alias("search_hosts"))


def cap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawling.over_caps(projects(spark, sf_dir), "project_id")


#: Raw errors of fetches and what is said of them.
ERRORS = (
    ("SSL: CERTIFICATE_VERIFY_FAILED", "TLS certificate problem"),
    ("[Errno -2] Name or service not known", "host name could not be resolved"),
    ("Connection REFUSED by peer", "connection refused"),
    ("read: connection reset", "connection was reset"),
    ("The read operation timed out", "timed out"),
    ("something else", "request failed"),
)


def fetch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by class and month, and the days a search import of an order's date would cover."""
    raw = F.get(F.array(*[F.lit(e) for e, _ in ERRORS]), F.col("o_orderkey") % (len(ERRORS) + 1))
    first, last = landing.sync_period(F.to_date("o_orderdate"))
    rows = read(spark, sf_dir, "orders").select(landing.error_message(raw).alias("error"), first.alias("first_day"), last.alias("last_day"))
    return rows.groupBy("error", F.date_trunc("month", "last_day").cast("date").alias("month")).agg(F.count("*").alias("n"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


QUERIES = {"crawl_configs": crawl_configs, "cap_violations": cap_violations, "fetch_errors": fetch_errors}
_P = f"p AS (SELECT *, CASE project_id % 5 WHEN 0 THEN 'www.site' || project_id || '.org' WHEN 2 THEN '10.0.0.' || project_id % 250 WHEN 3 THEN 'localhost' ELSE 'site' || project_id || '.org' END AS h FROM ({PROJECTS}))"
SQL = {
    "crawl_configs": f"""WITH {_P} SELECT project_id, array_to_string(list_sort(list_distinct(list_concat([h], CASE project_id % 5 WHEN 0 THEN [substr(h, 5)] WHEN 1 THEN ['www.' || h] WHEN 4 THEN ['www.' || h] ELSE [] END, CASE WHEN project_id % 2 = 0 THEN ['apply.example.org', 'www.example.org'] ELSE [] END))), ',') AS hosts,
CASE WHEN project_id % 5 = 1 THEN '8443' ELSE '' END AS extra_ports, least(max_pages, coalesce(org_max_pages, 500), CASE WHEN plan_pages > 0 THEN plan_pages ELSE coalesce(org_max_pages, 500) END)::INT AS max_pages, least(max_depth, coalesce(org_max_depth, 10))::INT AS max_depth, least(concurrency, 5)::INT AS concurrency,
CASE WHEN project_id % 5 = 0 THEN substr(h, 5) || ',' || h ELSE array_to_string(list_sort([h, 'www.' || h]), ',') END AS search_hosts FROM p""",
    "cap_violations": f"""WITH {_P} SELECT project_id, 'max_pages' AS setting, max_pages AS value, coalesce(org_max_pages, 500)::INT AS "limit" FROM p WHERE max_pages > coalesce(org_max_pages, 500)
UNION ALL SELECT project_id, 'max_depth', max_depth, coalesce(org_max_depth, 10)::INT FROM p WHERE max_depth > coalesce(org_max_depth, 10) UNION ALL SELECT project_id, 'concurrency', concurrency, 5 FROM p WHERE concurrency > 5""",
    "fetch_errors": f"""WITH e AS (SELECT CASE o_orderkey % {len(ERRORS) + 1} {' '.join(f"WHEN {k} THEN '{said}'" for k, (_, said) in enumerate(ERRORS))} END AS error, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT error, CAST(date_trunc('month', d - 1) AS DATE) AS month, count(*) AS n, min(d) - 90 AS first_day, max(d) - 1 AS last_day FROM e GROUP BY 1, 2""",
}
