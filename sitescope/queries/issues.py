"""Queries on issues, crawls, drafts, schedules and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, history, lifecycle, reports, schedule, usage
from .base import ISSUES, read, sim_issues

NOW = "TIMESTAMP '1998-01-15 12:00:00'"


def issue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.issue_summary(sim_issues(spark, sf_dir), F.lit("c9"))


SUMMARY = f"""WITH {ISSUES}, names(kind, name) AS (VALUES ('severity', 'critical'), ('severity', 'high'), ('severity', 'medium'), ('severity', 'low'), ('severity', 'informational'), ('category', 'technical'), ('category', 'on_page'), ('category', 'content'), ('category', 'internal_linking'), ('category', 'structured_data'),
('status', 'open'), ('status', 'resolved'), ('status', 'ignored'), ('latest', 'new'), ('latest', 'resolved')),
r AS (SELECT 'severity' AS kind, severity AS name FROM issues WHERE status = 'open' UNION ALL SELECT 'category', category FROM issues WHERE status = 'open' UNION ALL SELECT 'status', status FROM issues UNION ALL SELECT 'latest', 'new' FROM issues WHERE first_crawl = 'c9' AND status <> 'resolved' UNION ALL SELECT 'latest', 'resolved' FROM issues WHERE resolved_in = 'c9')
SELECT names.kind, names.name, count(r.name) AS issues FROM names LEFT JOIN r ON names.kind = r.kind AND names.name = r.name GROUP BY 1, 2"""


def issue_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.list_issues(sim_issues(spark, sf_dir), status="open", q="URGENT", sort="severity", number=3, size=50)
    return rows.select("issue_key", "severity", "priority")


LISTING = f"""WITH {ISSUES} SELECT issue_key, severity, priority FROM issues WHERE status = 'open' AND (title ILIKE '%urgent%' OR primary_url ILIKE '%urgent%') ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, priority DESC, issue_key LIMIT 50 OFFSET 100"""


def open_on_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.open_on_page(sim_issues(spark, sf_dir), F.lit("https://example.org/7")).select("issue_key", "severity")


ON_PAGE = f"WITH {ISSUES} SELECT issue_key, severity FROM issues WHERE status = 'open' AND primary_url = 'https://example.org/7'"


def issues_by_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.by_rule_prefix(sim_issues(spark, sf_dir), ["onpage.title", "onpage.meta_description"]).select("issue_key", "priority", "total")


BY_TOPIC = f"WITH {ISSUES}, m AS (SELECT * FROM issues WHERE status = 'open' AND (rule_id LIKE 'onpage.title%' OR rule_id LIKE 'onpage.meta_description%')) SELECT issue_key, priority, (SELECT count(*) FROM m) AS total FROM m ORDER BY priority DESC, issue_key LIMIT 8"


def lifecycle_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of orders merged with findings: of orders with a line item of January to March, and new ones of customers."""
    issues = sim_issues(spark, sf_dir).withColumns({"last_crawl": F.lit("c8"), "first_detected_at": F.col("detected_at"), "last_detected_at": F.col("detected_at"), "resolved_at": F.lit(None).cast("timestamp_ntz"), "recurrence_count": F.lit(0)})
    seen = read(spark, sf_dir, "lineitem").where(F.month("l_shipdate") <= 3).select("l_orderkey").distinct()
    key = F.concat(F.lit("i"), F.col("l_orderkey").cast("string"))
    new = read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("issue_key"), F.lit("high").alias("severity"))
    found = seen.select(key.alias("issue_key"), F.lit("medium").alias("severity")).unionByName(new)
    found = found.withColumns({"scope": F.lit("page"), "affected_urls": F.array(F.lit("https://example.org/1")), "affected_page_count": F.lit(1), "priority": F.lit(50.0)})
    crawled = spark.range(20).select(F.concat(F.lit("https://example.org/"), F.col("id").cast("string")).alias("url"))
    out = lifecycle.merge(issues, found, crawled, F.lit("c9"), F.lit(None).cast("timestamp_ntz"))
    return out.select("issue_key", "status", "severity", "first_crawl", "last_crawl", "resolved_in", "recurrence_count")


MERGE = f"""WITH {ISSUES}, f AS (SELECT DISTINCT 'i' || l_orderkey AS issue_key, 'medium' AS severity FROM lineitem WHERE month(l_shipdate) <= 3 UNION ALL SELECT 'n' || c_custkey, 'high' FROM customer),
j AS (SELECT coalesce(i.issue_key, f.issue_key) AS issue_key, i.issue_key IS NOT NULL AS known, f.issue_key IS NOT NULL AS found, i.status, i.severity, f.severity AS ns, first_crawl, resolved_in, scope = 'site' OR page_no < 20 AS verified FROM issues i FULL JOIN f ON i.issue_key = f.issue_key),
s AS (SELECT *, found AND known AND status = 'resolved' AS back, NOT found AND status IN ('open', 'ignored') AND verified AS gone FROM j)
SELECT issue_key, CASE WHEN NOT known OR back THEN 'open' WHEN gone THEN 'resolved' ELSE status END AS status, CASE WHEN found THEN ns ELSE severity END AS severity, CASE WHEN known THEN first_crawl ELSE 'c9' END AS first_crawl, CASE WHEN found THEN 'c9' ELSE 'c8' END AS last_crawl,
CASE WHEN gone THEN 'c9' WHEN NOT back THEN resolved_in END AS resolved_in, back::INT AS recurrence_count FROM s"""


def issue_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sim_issues(spark, sf_dir).withColumns({"last_crawl": F.when(F.col("page_no") < 10, "c9").otherwise("c1"), "recurrence_count": F.col("page_no") % 2})
    return compare.issue_changes(rows, "c9").groupBy("kind").agg(F.count("*").alias("issues"))


CHANGES = f"""WITH {ISSUES}, k AS (SELECT CASE WHEN first_crawl = 'c9' THEN 'new' WHEN resolved_in = 'c9' THEN 'resolved' WHEN page_no < 10 AND page_no % 2 > 0 THEN 'recurring' END AS kind FROM issues) SELECT kind, count(*) AS issues FROM k WHERE kind IS NOT NULL GROUP BY kind"""


def crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("created_at"), (F.floor(F.col("o_totalprice")) % 1000 / 10.0).alias("overall"),
        F.when(k % 6 == 5, "failed").when(k % 11 == 4, "running").otherwise("completed").alias("status"), F.when(k % 5 == 0, "queued").when(k % 3 == 0, "none").otherwise("completed").alias("analysis_status"), F.lit(None).cast("timestamp_ntz").alias("pages_pruned_at"),
    )


CRAWLS = """crawls AS MATERIALIZED (SELECT o_orderkey AS id, o_custkey AS project_id, o_orderdate AS created_at, (floor(o_totalprice)::BIGINT % 1000) / 10.0::DOUBLE AS overall, CASE WHEN o_orderkey % 6 = 5 THEN 'failed' WHEN o_orderkey % 11 = 4 THEN 'running' ELSE 'completed' END AS status,
CASE WHEN o_orderkey % 5 = 0 THEN 'queued' WHEN o_orderkey % 3 = 0 THEN 'none' ELSE 'completed' END AS analysis_status FROM orders)"""


def latest_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest(crawls(spark, sf_dir)).select("project_id", "id")


LATEST = f"WITH {CRAWLS} SELECT project_id, arg_max(id, (created_at, id)) AS id FROM crawls WHERE analysis_status = 'completed' GROUP BY 1"


def score_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.score_history(crawls(spark, sf_dir), keep=5).select("project_id", "id", "overall", "change")


SCORE_CHANGE = f"""WITH {CRAWLS}, d AS (SELECT *, overall - lag(overall) OVER (PARTITION BY project_id ORDER BY created_at, id) AS diff, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS k FROM crawls)
SELECT project_id, id, overall, CASE WHEN diff < 0 THEN -(floor(-diff * 10 + 0.5) / 10) ELSE floor(diff * 10 + 0.5) / 10 END AS change FROM d WHERE k <= 5"""


def crawl_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.crawl_before(crawls(spark, sf_dir)).select("project_id", "id", F.coalesce("previous_id", F.lit(0)).alias("previous_id"))


PAIRS = f"WITH {CRAWLS} SELECT project_id, id, coalesce(lag(id) OVER (PARTITION BY project_id ORDER BY created_at, id), 0) AS previous_id FROM crawls WHERE analysis_status = 'completed'"


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.prunable(crawls(spark, sf_dir), 3).select("project_id", "id")


RETENTION = f"""WITH {CRAWLS}, f AS (SELECT * FROM crawls WHERE status IN ('completed', 'failed')), d AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS k, count(*) OVER (PARTITION BY project_id) AS n FROM f WHERE status = 'completed'),
e AS (SELECT project_id, max(created_at) FILTER (k = 3) AS edge, max(id) FILTER (k = 1) AS newest FROM d WHERE n > 3 GROUP BY 1), a AS (SELECT project_id, arg_max(id, (created_at, id)) AS analysed FROM f WHERE analysis_status = 'completed' GROUP BY 1)
SELECT f.project_id, f.id FROM f JOIN e ON f.project_id = e.project_id LEFT JOIN a ON f.project_id = a.project_id WHERE created_at < edge AND analysis_status <> 'queued' AND f.id <> newest AND f.id IS DISTINCT FROM analysed"""


def usage_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("organisation_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))
    return usage.over_quota(usage.quota(rows, F.expr(NOW)), 1)


QUOTA = f"""WITH q AS (SELECT o_custkey % 50 AS organisation_id, count(*) FILTER (o_orderdate >= date_trunc('month', {NOW}) AND o_orderdate <= {NOW}) AS this_month, count(*) FILTER (o_orderdate >= date_trunc('day', {NOW}) AND o_orderdate <= {NOW}) AS today FROM orders GROUP BY 1) SELECT * FROM q WHERE this_month >= 1"""


def action_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.action_plan(sim_issues(spark, sf_dir))


PLAN = f"""WITH {ISSUES}, o AS (SELECT * FROM issues WHERE status = 'open' AND severity <> 'informational'), a AS (SELECT issue_key, priority FROM o WHERE severity IN ('critical', 'high') ORDER BY priority DESC, issue_key LIMIT 10),
b AS (SELECT issue_key, priority FROM o WHERE effort = 'low' AND issue_key NOT IN (SELECT issue_key FROM a) ORDER BY priority DESC, issue_key LIMIT 10), c AS (SELECT issue_key, priority FROM o WHERE issue_key NOT IN (SELECT issue_key FROM a) AND issue_key NOT IN (SELECT issue_key FROM b) ORDER BY priority DESC, issue_key LIMIT 10),
u AS (SELECT 'fix_first' AS section, * FROM a UNION ALL SELECT 'quick_wins', * FROM b UNION ALL SELECT 'plan_next', * FROM c) SELECT section, row_number() OVER (PARTITION BY section ORDER BY priority DESC, issue_key)::INT AS rank, issue_key FROM u"""


def category_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.by_category(sim_issues(spark, sf_dir))
    return rows.select("category", "open", "critical", "high", F.array_join("top", ",").alias("top"))


TOPN = f"""WITH {ISSUES}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY priority DESC, issue_key) AS k FROM issues WHERE status = 'open')
SELECT category, count(*) AS open, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, string_agg(issue_key, ',' ORDER BY k) FILTER (k <= 10) AS top FROM r GROUP BY category"""


def issue_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of the issues of the report's sections."""
    rows = reports.action_plan(sim_issues(spark, sf_dir), 300)
    return reports.references(rows, [F.col("section"), F.col("rank")]).select("issue_key", "ref")


REFS = PLAN.replace("LIMIT 10", "LIMIT 300").replace("SELECT section, row_number()", ", p AS (SELECT section, row_number()", 1).replace(" AS rank, issue_key FROM u", " AS rank, issue_key FROM u)") + """, n AS (SELECT issue_key, row_number() OVER (ORDER BY section, rank) AS n FROM p)
SELECT issue_key, 'issue-' || CASE WHEN n <= 26 THEN chr((96 + n)::INT) WHEN n <= 702 THEN chr((96 + (n - 1) // 26)::INT) || chr((97 + (n - 1) % 26)::INT) ELSE chr((96 + (n - 703) // 676 + 1)::INT) || chr((97 + (n - 703) // 26 % 26)::INT) || chr((97 + (n - 703) % 26)::INT) END AS ref FROM n"""


def draft_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as the steps of a draft."""
    act = F.element_at(F.array(*[F.lit(x) for x in ("created", "submitted", "approved", "published")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    to = F.element_at(F.array(*[F.lit(x) for x in ("draft", "pending_review", "approved", "published")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    start = F.element_at(F.array(*[F.lit(x) for x in ("", "draft", "pending_review", "approved")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    log = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("draft_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), act.alias("action"), start.alias("from_status"), to.alias("to_status"))
    return lifecycle.trail_errors(log).select("draft_id", "id", "action", "expected")


TRAIL = """WITH l AS (SELECT o_custkey AS draft_id, o_orderkey AS id, o_orderdate AS created_at, ['created', 'submitted', 'approved', 'published'][(o_orderkey % 4 + 1)::INT] AS action, ['', 'draft', 'pending_review', 'approved'][(o_orderkey % 4 + 1)::INT] AS f, ['draft', 'pending_review', 'approved', 'published'][(o_orderkey % 4 + 1)::INT] AS t FROM orders),
e AS (SELECT *, lag(t, 1, '') OVER (PARTITION BY draft_id ORDER BY created_at, id) AS expected FROM l) SELECT draft_id, id, action, expected FROM e WHERE f <> expected"""


def schedule_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    now, hour, zone = F.expr(NOW), (F.col("o_orderkey") % 24).cast("int"), F.lit("UTC")
    rows = read(spark, sf_dir, "orders")
    run = lambda f: F.date_format(schedule.following_run(at, now, f, hour, zone), "yyyy-MM-dd HH:mm")
    return rows.select("o_orderkey", run("daily").alias("daily"), run("weekly").alias("weekly"), F.date_format(schedule.first_run(at, hour, zone), "yyyy-MM-dd HH:mm").alias("first"))


SCHEDULE = f"""WITH o AS (SELECT o_orderkey, date_trunc('day', o_orderdate) AS d, o_orderdate AS t, to_hours((o_orderkey % 24)::INT) AS h FROM orders),
k AS (SELECT *, greatest(date_diff('day', d, {NOW}), 0) AS n FROM o), c AS (SELECT *, d + to_days(greatest(n, 1)::INT) + h AS d0, d + to_days(greatest(n + 1, 1)::INT) + h AS d1, d + to_days(greatest(n // 7 * 7, 7)::INT) + h AS w0, d + to_days(greatest(n // 7 * 7 + 7, 7)::INT) + h AS w1 FROM k)
SELECT o_orderkey, strftime(CASE WHEN d0 > {NOW} THEN d0 ELSE d1 END, '%Y-%m-%d %H:%M') AS daily, strftime(CASE WHEN w0 > {NOW} THEN w0 ELSE w1 END, '%Y-%m-%d %H:%M') AS weekly, strftime(CASE WHEN d + h > t THEN d + h ELSE d + to_days(1) + h END, '%Y-%m-%d %H:%M') AS first FROM c"""

QUERIES = {
    "issue_summary_zero_filled": issue_summary,
    "issue_listing": issue_listing,
    "issues_on_page": open_on_page,
    "issues_by_topic": issues_by_topic,
    "issue_lifecycle_merge": lifecycle_merge,
    "issue_changes": issue_changes,
    "latest_crawl_per_project": latest_crawl,
    "score_change_lag": score_change,
    "crawl_pairs": crawl_pairs,
    "retention_keep_k": retention,
    "usage_quota": usage_quota,
    "action_plan": action_plan,
    "report_category_topn": category_topn,
    "issue_refs": issue_refs,
    "draft_trail_validation": draft_trail,
    "schedule_next_run": schedule_next,
}
SQL = {
    "issue_summary_zero_filled": SUMMARY,
    "issue_listing": LISTING,
    "issues_on_page": ON_PAGE,
    "issues_by_topic": BY_TOPIC,
    "issue_lifecycle_merge": MERGE,
    "issue_changes": CHANGES,
    "latest_crawl_per_project": LATEST,
    "score_change_lag": SCORE_CHANGE,
    "crawl_pairs": PAIRS,
    "retention_keep_k": RETENTION,
    "usage_quota": QUOTA,
    "action_plan": PLAN,
    "report_category_topn": TOPN,
    "issue_refs": REFS,
    "draft_trail_validation": TRAIL,
    "schedule_next_run": SCHEDULE,
}
