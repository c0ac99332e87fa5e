"""Queries on stored reports: orders as crawls with scores, analyses and recommendations of projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import report_data
from ..plans.settings import CATEGORIES, SEVERITIES
from .base import ISSUES, read, sim_issues

#: Columns of each table, in both engines; a crawl has the number of its order.
OWNER = "o_custkey % 5 AS organisation_id, o_custkey AS project_id"
TABLES = {
    "reports": f"SELECT o_orderkey AS report_id, {OWNER}, CASE WHEN o_orderkey % 9 = 4 THEN o_orderkey + 1 ELSE o_orderkey END AS crawl_job_id, o_orderkey % 4 <> 1 AS include_ai FROM orders WHERE o_orderkey % 3 = 0",
    "crawls": f"SELECT {OWNER}, o_orderkey AS id, o_orderdate AS created_at FROM orders",
    "scores": f"SELECT {OWNER}, o_orderkey AS crawl_job_id, o_orderdate AS created_at, CASE WHEN o_orderkey % 8 = 3 THEN NULL ELSE CAST(o_orderkey * 7 % 1000 AS DOUBLE) / 10 END AS overall FROM orders WHERE o_orderkey % 5 <> 2",
    "analyses": f"SELECT {OWNER}, l_orderkey AS crawl_job_id, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 3 = 0 THEN 'issue_explanation' ELSE 'management_summary' END AS kind, CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'failed' END AS status, CASE WHEN l_quantity < 40 THEN concat(l_returnflag, l_partkey) END AS output, l_returnflag AS model, l_shipdate AS finished_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "recommendations": f"SELECT {OWNER}, o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN 'dismissed' ELSE 'accepted' END AS status, o_orderdate AS created_at, o_orderpriority AS title, o_orderstatus AS body, array(o_orderpriority) AS steps, 'https://example.org/' AS page_url FROM orders",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read(spark, sf_dir, "orders").createOrReplaceTempView("orders_of_reports")
    read(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem_of_reports")
    return spark.sql(TABLES[name].replace("FROM orders", "FROM orders_of_reports").replace("JOIN orders", "JOIN orders_of_reports").replace("FROM lineitem", "FROM lineitem_of_reports"))


def _with(*names: str) -> str:
    return ", ".join(f"{n} AS MATERIALIZED ({TABLES[n].replace('array(o_orderpriority)', '[o_orderpriority]')})" for n in names)


def report_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_data.health(*[_table(spark, sf_dir, n) for n in ("reports", "scores", "crawls")])


HEALTH = f"""WITH {_with("reports", "scores", "crawls")}, r AS (SELECT r.report_id, r.organisation_id, r.project_id, s.overall, coalesce(s.created_at, c.created_at) AS t FROM reports r JOIN crawls c ON c.id = r.crawl_job_id AND c.organisation_id = r.organisation_id AND c.project_id = r.project_id LEFT JOIN scores s ON s.crawl_job_id = r.crawl_job_id),
b AS (SELECT r.report_id, arg_max_null(s.overall, (s.created_at, s.crawl_job_id)) AS previous_overall FROM r JOIN scores s ON s.organisation_id = r.organisation_id AND s.project_id = r.project_id AND s.created_at < r.t GROUP BY 1),
d AS (SELECT r.report_id, overall, previous_overall, overall - previous_overall AS diff FROM r LEFT JOIN b ON r.report_id = b.report_id)
SELECT report_id, overall, previous_overall, CASE WHEN diff < 0 THEN -(floor(-diff * 10 + 0.5) / 10) ELSE floor(diff * 10 + 0.5) / 10 END AS change FROM d"""


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of many issues, a third of which belong to one of them."""
    n = F.regexp_extract("issue_key", r"\d+", 0).cast("bigint")
    return sim_issues(spark, sf_dir).withColumns({"organisation_id": n % 3, "project_id": F.when(n % 3 == 0, F.lit(0)).otherwise(n % 20)})


ISSUES_OF = f"{ISSUES}, own AS MATERIALIZED (SELECT * EXCLUDE (project_id), n % 3 AS organisation_id, CASE WHEN n % 3 = 0 THEN 0 ELSE n % 20 END AS project_id FROM (SELECT *, substr(issue_key, 2)::BIGINT AS n FROM issues))"


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_data.counts(_issues(spark, sf_dir))


_NAMED = [f"count(*) FILTER (status = 'open' AND {c} = '{v}') AS {v}" for c, vs in (("severity", SEVERITIES), ("category", CATEGORIES)) for v in vs] + [f"count(*) FILTER (status = '{s}') AS {s}" for s in ("open", "ignored", "resolved")]
COUNTS = f"WITH {ISSUES_OF} SELECT organisation_id, project_id, {', '.join(_NAMED)} FROM own GROUP BY 1, 2"


def report_first_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_data.first_issues(_issues(spark, sf_dir))


FIRST = f"""WITH {ISSUES_OF}, s AS (SELECT organisation_id, project_id, issue_key, priority, category AS section, 10 AS most FROM own WHERE status = 'open' UNION ALL SELECT organisation_id, project_id, issue_key, priority, severity, 25 FROM own WHERE status = 'open' AND severity IN ('critical', 'high')),
r AS (SELECT *, row_number() OVER (PARTITION BY organisation_id, project_id, section ORDER BY priority DESC, issue_key)::INT AS rank FROM s) SELECT organisation_id, project_id, section, rank, issue_key FROM r WHERE rank <= most"""


def report_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report_data.written(*[_table(spark, sf_dir, n) for n in ("reports", "analyses", "recommendations")])
    told = F.array_join(F.transform("recommendations", lambda r: F.concat_ws(":", r["title"], r["body"])), "; ")
    return rows.select("report_id", "included", F.col("summary.output").alias("output"), F.col("summary.model").alias("model"), F.size("recommendations").alias("n"), told.alias("recommendations"))


WRITTEN = f"""WITH {_with("reports", "analyses", "recommendations")}, a AS (SELECT *, row_number() OVER (PARTITION BY organisation_id, project_id, crawl_job_id ORDER BY finished_at DESC, id DESC) AS k FROM analyses WHERE kind = 'management_summary' AND status = 'completed'),
b AS (SELECT *, row_number() OVER (PARTITION BY organisation_id, project_id ORDER BY created_at DESC, id DESC) AS k FROM recommendations WHERE status = 'accepted'),
c AS (SELECT organisation_id, project_id, count(*) AS n, string_agg(title || ':' || body, '; ' ORDER BY k) AS told FROM b WHERE k <= 10 GROUP BY 1, 2)
SELECT r.report_id, r.include_ai AS included, CASE WHEN include_ai THEN a.output END AS output, CASE WHEN include_ai AND a.output IS NOT NULL THEN a.model END AS model, CASE WHEN include_ai THEN coalesce(n, 0) ELSE 0 END::INT AS n, CASE WHEN include_ai THEN coalesce(told, '') ELSE '' END AS recommendations
FROM reports r LEFT JOIN a ON a.k = 1 AND a.organisation_id = r.organisation_id AND a.project_id = r.project_id AND a.crawl_job_id = r.crawl_job_id LEFT JOIN c ON c.organisation_id = r.organisation_id AND c.project_id = r.project_id"""

QUERIES = {"report_health": report_health, "report_counts": report_counts, "report_first_issues": report_first_issues, "report_written": report_written}
SQL = {"report_health": HEALTH, "report_counts": COUNTS, "report_first_issues": FIRST, "report_written": WRITTEN}
