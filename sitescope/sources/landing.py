"""Other landed inputs, and the sink that replaces a period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import host

SEARCH_ROW = "keys array<string>, clicks long, impressions long, position double"
EVAL_CASE = "name string, kind string, question string, expect struct<cites_top_issues: boolean, cites_rules: array<string>, admits_missing_data: boolean, answers: boolean, cites_page_issues: boolean>"


def site_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, url) of lines ``Name, https://...``, split at the last comma; empty lines and # lines do not count."""
    lines = spark.read.text(path).where(~F.trim("value").rlike("^(#.*)?$"))
    part = lambda k: F.trim(F.regexp_extract("value", "^(.*),([^,]*)$", k))
    return lines.select(part(1).alias("name"), part(2).alias("url"))


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a JSON array; a name that occurs twice is an error."""
    cases = spark.read.schema(EVAL_CASE).option("multiLine", True).json(path)
    twice = cases.groupBy("name").count().where("count > 1").select("name").take(5)
    if twice:
        raise ValueError("evaluation case names occur twice: " + ", ".join(r["name"] for r in twice))
    return cases


def search_rows(landed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(page days, page queries) of landed rows; only rows with exactly two keys count."""
    rows = landed.where(F.size("keys") == 2)
    page = F.left(F.col("keys")[0], F.lit(2048))
    base = rows.select(page.alias("page"), host(page).alias("page_host"), F.col("keys")[1].alias("second"), "clicks", "impressions", "position")
    day = F.col("second").try_cast("date")
    days = base.where(day.isNotNull()).select("page", "page_host", day.alias("day"), "clicks", "impressions", "position")
    queries = base.where(day.isNull()).select("page", "page_host", F.left("second", F.lit(500)).alias("query"), "clicks", "impressions", "position")
    return days, queries


def sync_period(today: Column, days: int = 90) -> tuple[Column, Column]:
    return F.date_sub(today, days), F.date_sub(today, 1)


def replaced(current: DataFrame, new: DataFrame, start, end, keys: tuple[str, ...] = ("integration_id",)) -> DataFrame:
    """The rows after a period was imported anew: the old ones of [start, end] of those integrations make way."""
    integrations = new.select(*keys).distinct()
    inside = F.col("day").between(F.lit(start), F.lit(end))
    kept = current.where(~inside).unionByName(current.where(inside).join(integrations, list(keys), "left_anti"))
    return kept.unionByName(new)


def write_days(rows: DataFrame, path: str) -> None:
    """Overwrites exactly the (integration_id, day) partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("integration_id", "day").parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Evaluation results, one JSON object a line."""
    results.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def error_message(raw: Column) -> Column:
    """A readable class of a raw fetch error."""
    low = F.lower(raw)
    has = lambda *xs: low.rlike("|".join(xs))
    return (
        F.when(has("certificate", "ssl", "tls"), "TLS certificate problem")
        .when(has("name or service not known", "nodename", "getaddrinfo", "dns"), "host name could not be resolved")
        .when(has("refused"), "connection refused")
        .when(has("reset"), "connection was reset")
        .when(has("timed? ?out"), "timed out")
        .when(raw.isNotNull(), "request failed")
    )


def carried_over(new: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """Pages that answered 304 take ``columns`` from the previous crawl's row of the same URL."""
    old = previous.select(F.col("url").alias("old_url"), *[F.col(c).alias(f"old_{c}") for c in columns])
    out = new.join(old, F.col("url") == F.col("old_url"), "left")
    same = F.col("status_code") == 304
    out = out.withColumns({c: F.when(same, F.col(f"old_{c}")).otherwise(F.col(c)) for c in columns})
    return out.drop("old_url", *[f"old_{c}" for c in columns])
