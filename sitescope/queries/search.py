"""Queries on search figures and event streams."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..sources import landing
from ..streaming import limits
from .base import DAYS, read, sim_days

WINDOW = "win AS MATERIALIZED (SELECT * FROM days WHERE day >= (SELECT max(day) FROM days) - 13)"
RATES = "CASE WHEN sum(impressions) > 0 THEN floor(sum(clicks)::DOUBLE / sum(impressions)::DOUBLE * 10000 + 0.5) / 10000 END AS ctr, CASE WHEN sum(impressions) > 0 THEN floor(sum(position * impressions) / sum(impressions)::DOUBLE * 10 + 0.5) / 10 END AS avg_position"


def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.window(sim_days(spark, sf_dir), 14)


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.totals(_window(spark, sf_dir))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.daily(_window(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


def top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top(_window(spark, sf_dir), "page")


def top_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.concat("event_type", F.lit(" "), F.get_json_object("props", "$.k")).alias("query"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("clicks"), F.lit(1).alias("impressions"), F.floor("value").cast("double").alias("position"))
    return search.top(rows, "query")


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = sim_days(spark, sf_dir).withColumns({"impressions": F.col("impressions") * 20, "position": F.col("position") / 3.0})
    return search.opportunities(search.window(days, 14)).select("page", "clicks", "impressions", "ctr", "band", "band_ctr")


OPPORTUNITIES = f"""WITH {DAYS}, win AS MATERIALIZED (SELECT page, clicks, impressions * 20 AS impressions, position / 3.0::DOUBLE AS position FROM days WHERE day >= (SELECT max(day) FROM days) - 13),
p AS (SELECT page, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, sum(position * impressions) / sum(impressions)::DOUBLE AS pos FROM win GROUP BY page), b AS (SELECT *, CASE WHEN pos < 3.05 THEN 'top_3' ELSE 'positions_4_10' END AS band FROM p WHERE pos < 10.05),
c AS (SELECT *, floor(sum(clicks) OVER (PARTITION BY band)::DOUBLE / sum(impressions) OVER (PARTITION BY band)::DOUBLE * 10000 + 0.5) / 10000 AS band_ctr, floor(clicks::DOUBLE / impressions::DOUBLE * 10000 + 0.5) / 10000 AS ctr FROM b)
SELECT page, clicks, impressions, ctr, band, band_ctr FROM c WHERE impressions >= 100 AND ctr < band_ctr ORDER BY impressions * band_ctr - clicks DESC, page LIMIT 10"""


def page_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.totals(_window(spark, sf_dir).where("page = '7'"))


def failure_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", (F.col("user_id") % 20).alias("key"), "ts")
    return limits.failures_in_window(rows, "key", "ts", 86_400, 3).select("event_id", "failures", "blocked")


FAILURES = """WITH e AS (SELECT event_id, user_id % 20 AS key, epoch_us(ts) AS t FROM events WHERE event_type = 'error'), c AS (SELECT event_id, count(*) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS failures FROM e) SELECT event_id, failures, failures >= 3 AS blocked FROM c"""


def throttle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = limits.request_gaps(read(spark, sf_dir, "events"), "user_id", "ts", 3600.0)
    return rows.select("event_id", F.round("gap", 3).alias("gap"), "too_soon")


GAPS = """WITH g AS (SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0::DOUBLE AS gap FROM events) SELECT event_id, round(gap, 3) AS gap, coalesce(gap < 3600, false) AS too_soon FROM g"""


def stale_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"), F.when(F.col("event_id") % 4 > 0, F.col("ts")).alias("heartbeat_at"), F.col("ts").alias("started_at"))
    return limits.stale(rows, F.lit(datetime.datetime(2024, 1, 15))).select("event_id")


STALE = "SELECT event_id FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 300 SECOND"


def replace_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last week imported anew: its old rows make way."""
    days = sim_days(spark, sf_dir).withColumn("integration_id", F.lit(1))
    start, end = datetime.date(2024, 1, 20), datetime.date(2024, 1, 26)
    new = days.where(F.col("day").between(F.lit(start), F.lit(end))).withColumn("clicks", F.col("clicks") + 1).where(F.length("page") < 2)
    return landing.replaced(days, new, start, end).select("page", F.col("day").cast("string").alias("day"), "clicks", "impressions")


REPLACED = f"""WITH {DAYS} SELECT page, day::VARCHAR AS day, clicks, impressions FROM days WHERE day NOT BETWEEN DATE '2024-01-20' AND DATE '2024-01-26' UNION ALL SELECT page, day::VARCHAR, clicks + 1, impressions FROM days WHERE day BETWEEN DATE '2024-01-20' AND DATE '2024-01-26' AND length(page) < 2"""

QUERIES = {
    "search_totals": totals,
    "search_daily": daily,
    "search_top_pages": top_pages,
    "search_top_queries": top_queries,
    "click_opportunities": opportunities,
    "page_performance": page_performance,
    "sliding_failure_window": failure_window,
    "host_throttle_gaps": throttle_gaps,
    "stale_heartbeat": stale_heartbeat,
    "replace_by_period": replace_by_period,
}
SQL = {
    "search_totals": f"WITH {DAYS}, {WINDOW} SELECT sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, {RATES} FROM win",
    "search_daily": f"WITH {DAYS}, {WINDOW} SELECT day::VARCHAR AS day, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions FROM win GROUP BY day",
    "search_top_pages": f"WITH {DAYS}, {WINDOW} SELECT page, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, {RATES} FROM win GROUP BY page ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20",
    "search_top_queries": f"WITH q AS (SELECT event_type || ' ' || json_extract_string(props, '$.k') AS query, (event_type = 'click')::INT AS clicks, 1 AS impressions, floor(value) AS position FROM events) SELECT query, sum(clicks)::BIGINT AS clicks, sum(impressions)::BIGINT AS impressions, {RATES} FROM q GROUP BY query ORDER BY 2 DESC, 3 DESC, 1 LIMIT 20",
    "click_opportunities": OPPORTUNITIES,
    "page_performance": f"WITH {DAYS}, {WINDOW} SELECT coalesce(sum(clicks), 0)::BIGINT AS clicks, coalesce(sum(impressions), 0)::BIGINT AS impressions, {RATES} FROM win WHERE page = '7'",
    "sliding_failure_window": FAILURES,
    "host_throttle_gaps": GAPS,
    "stale_heartbeat": STALE,
    "replace_by_period": REPLACED,
}
