"""Queries of listings, filters and limits that other queries do not reach, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, records, reports, usage
from ..streaming import limits
from .base import read


def newest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifteen rows of one project."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("project_id"), F.col("o_orderdate").alias("created_at"))
    return records.newest(rows, 15, project_id=3).select("id")


NEWEST_SQL = "SELECT o_orderkey AS id FROM orders WHERE o_custkey % 7 = 3 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 15"


def draft_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("/p/"), (F.col("o_custkey") % 5).cast("string")).alias("page_url"), F.col("o_orderdate").alias("updated_at"))
    return records.list_drafts(rows, status="O", page_url="/p/2", number=2, size=10).select("id", "status", "page_url")


DRAFTS_SQL = "SELECT o_orderkey AS id, o_orderstatus AS status, '/p/2' AS page_url FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 5 = 2 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10 OFFSET 10"


def default_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_regionkey") == 1).alias("is_default"))
    return records.single_default(plans, 7)


DEFAULT_SQL = "SELECT n_nationkey AS id, n_nationkey = 7 AS is_default FROM nation"


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of the platform itself whose name starts with a prefix in which % and _ stand for themselves."""
    k = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(k.alias("id"), F.concat("event_type", F.when(k % 3 == 0, "_x").otherwise("%x"), (k % 10).cast("string")).alias("action"), F.when(k % 4 > 0, k % 4).alias("organisation_id"))
    return history.prefix_filter(rows, "action", "click_x", own_only=True).select("id", "action")


AUDIT_SQL = "SELECT event_id AS id, concat('click_x', event_id % 10) AS action FROM events WHERE event_type = 'click' AND event_id % 3 = 0 AND event_id % 4 = 0"


def pruned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by crawl once those of crawls that can go are gone."""
    pages = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("crawl_job_id"))
    gone = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")).where("id % 3 = 0")
    return history.prune(pages, gone).groupBy("crawl_job_id").agg(F.count("*").alias("pages"))


PRUNED_SQL = "SELECT l_orderkey % 50 AS crawl_job_id, count(*) AS pages FROM lineitem WHERE l_orderkey % 50 NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0) GROUP BY 1"


def answer_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", usage.preview(F.col("text"), 60).alias("preview"))


PREVIEW_SQL = "SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN left(text, 57) || '...' ELSE text END AS preview FROM conversations"


#: Evidence of customers: (key, JSON value, label, text that is shown), from k and name. Keys beyond the eighth are left out.
EVIDENCE = (
    ("market_segment", "concat('\"', name, '\"')", "Market segment", "name"),
    ("final_url", "'null'", "Final URL", "'none'"),
    ("HTTP_status", "CAST(k % 500 AS STRING)", "HTTP status", "CAST(k % 500 AS VARCHAR)"),
    ("is_noindex", "CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END", "Is noindex", "CASE WHEN k % 2 = 0 THEN 'yes' ELSE 'no' END"),
    ("ms_h1", "concat('[', k, ',\"x\",false]')", "ms H1", "concat(k, ', x, no')"),
    ("urls", "concat('[', array_join(transform(sequence(1, 12), i -> concat('\"u', i, '\"')), ','), ']')", "URLs", "'u1, u2, u3, u4, u5, u6, u7, u8, u9, u10 (and 2 more)'"),
    ("by_page", "concat('{\"a_b\":[1,', k, '],\"c\":{\"d_e\":null}}')", "By page", "concat('a b: 1, ', k, '; c: d e: none')"),
    ("long_text", "concat('\"', repeat('é', CAST(299 + k % 3 AS INT)), '\"')", "Long text", "CASE WHEN k % 3 = 2 THEN repeat('é', 299) || '…' ELSE repeat('é', (299 + k % 3)::INT) END"),
    ("left_out", "'1'", None, None),
)


def evidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's evidence as it is shown: numbers, texts, booleans, nothing, lists, maps within lists within maps."""
    made = ", ',', ".join(f"'\"{key}\":', {value}" for key, value, _, _ in EVIDENCE)
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_mktsegment AS name").selectExpr("k AS c_custkey", f"concat('{{', {made}, '}}') AS evidence")
    rows = rows.select("c_custkey", F.posexplode(reports.evidence_pairs(F.col("evidence"))).alias("k", "pair"))
    return rows.select("c_custkey", "k", "pair.label", "pair.value")


EVIDENCE_SQL = "WITH c AS (SELECT c_custkey, c_custkey AS k, c_mktsegment AS name FROM customer) " + " UNION ALL ".join(f"SELECT c_custkey, {n}::INT AS k, '{label}' AS label, {shown} AS value FROM c" for n, (_, _, label, shown) in enumerate(EVIDENCE) if label)


def failures_after_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of the last day since a user's last success."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("ok"))
    return limits.failures_in_window(rows, "user_id", "ts", 86_400, 2, ok="ok", tie="event_id").select("event_id", "failures", "blocked")


FAILURES_SQL = """WITH e AS (SELECT event_id, user_id, ts, event_type = 'purchase' AS ok FROM events),
s AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS since FROM e),
f AS (SELECT a.event_id, CASE WHEN a.ok THEN 0 ELSE (SELECT count(*) FROM s b WHERE b.user_id = a.user_id AND b.since = a.since AND NOT b.ok AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 1 DAY) END AS failures FROM s a)
SELECT event_id, failures, failures >= 2 AS blocked FROM f"""

QUERIES = {
    "newest_reports": newest_reports,
    "draft_listing": draft_listing,
    "default_plan": default_plan,
    "audit_log": audit_log,
    "pruned_pages": pruned_pages,
    "answer_previews": answer_previews,
    "evidence_table": evidence_table,
    "failures_after_success": failures_after_success,
}
SQL = {
    "newest_reports": NEWEST_SQL,
    "draft_listing": DRAFTS_SQL,
    "default_plan": DEFAULT_SQL,
    "audit_log": AUDIT_SQL,
    "pruned_pages": PRUNED_SQL,
    "answer_previews": PREVIEW_SQL,
    "evidence_table": EVIDENCE_SQL,
    "failures_after_success": FAILURES_SQL,
}
