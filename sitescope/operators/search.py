"""Search performance: totals, days, top pages and queries, and pages that earn too few clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import click_rate, weighted_position
from ..functions.urls import normalise_url

# Bounds of the opportunity list.
MIN_IMPRESSIONS, LIMIT, TOP_3, FIRST_PAGE = 100, 10, 3.05, 10.05


def window(days: DataFrame, length: int, hosts: list[str] | None = None) -> DataFrame:
    """The last ``length`` days up to the newest day of the hosts."""
    rows = days if hosts is None else days.where(F.col("page_host").isin(hosts))
    newest = rows.agg(F.max("day").alias("newest"))
    return rows.join(F.broadcast(newest), F.lit(True)).where(F.col("day") >= F.date_sub("newest", length - 1)).drop("newest")  # one row


def _sums() -> list:
    return [
        F.sum("clicks").cast("bigint").alias("clicks"),
        F.sum("impressions").cast("bigint").alias("impressions"),
        F.sum(F.col("position") * F.col("impressions")).alias("weighted"),
    ]


def _rates(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("ctr", click_rate(F.col("clicks"), F.col("impressions"))).withColumn("avg_position", weighted_position(F.col("weighted"), F.col("impressions")))
    return out.drop("weighted")


def totals(rows: DataFrame) -> DataFrame:
    return _rates(rows.agg(*_sums()).fillna({"clicks": 0, "impressions": 0}))


def daily(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day").agg(*_sums()).drop("weighted").orderBy("day")


def top(rows: DataFrame, by: str, limit: int = 20) -> DataFrame:
    """The pages or queries with most clicks, then impressions, then by name."""
    return _rates(rows.groupBy(by).agg(*_sums())).orderBy(F.desc("clicks"), F.desc("impressions"), by).limit(limit)


def opportunities(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """First-page pages with a lower click rate than the site's pages at like positions, by the clicks they lack.

    Small pages count in their band's rate but are not listed. Rates are compared as rounded.
    """
    per = rows.groupBy("page").agg(*_sums()).where("impressions > 0").withColumn("exact", F.col("weighted") / F.col("impressions")).where(F.col("exact") < FIRST_PAGE)
    per = per.withColumn("band", F.when(F.col("exact") < TOP_3, "top_3").otherwise("positions_4_10"))
    bands = per.groupBy("band").agg(click_rate(F.sum("clicks"), F.sum("impressions")).alias("band_ctr"))
    out = _rates(per.join(F.broadcast(bands), "band")).where((F.col("impressions") >= MIN_IMPRESSIONS) & (F.col("ctr") < F.col("band_ctr")))  # two bands
    gap = F.col("impressions") * F.col("band_ctr") - F.col("clicks")
    return out.withColumn("gap", gap).orderBy(F.desc("gap"), "page").limit(limit).select("page", "clicks", "impressions", "ctr", "avg_position", "band", "band_ctr", "gap")


def attach_pages(found: DataFrame, pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Adds the page of the crawl at each row's (normalised) address, and that page's open title and description issues.

    Rows whose page the crawl does not have get no columns of it, and no issues.
    """
    named = issues.where("status = 'open'").where(F.startswith("rule_id", F.lit("onpage.title_")) | F.startswith("rule_id", F.lit("onpage.meta_description_")))
    counts = named.select(F.explode(F.array_distinct("affected_urls")).alias("__url")).groupBy("__url").agg(F.count("*").alias("metadata_issues"))
    known = pages.select(F.col("url").alias("__url"), F.col("crawl_job_id").alias("crawl_id"), F.col("id").alias("page_id"), "title", "meta_description")
    known = known.join(counts, "__url", "left")
    out = found.withColumn("__url", normalise_url(F.col("page"), F.lit(None).cast("string"))).join(known, "__url", "left")
    return out.drop("__url").fillna({"metadata_issues": 0})


def page_performance(rows: DataFrame, queries: DataFrame, page: str, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """(totals, top queries) of one page within a window that its host sets."""
    return totals(rows.where(F.col("page") == page)), top(queries.where(F.col("page") == page), "query", limit)


def previous_rank(rows: DataFrame, by: str) -> DataFrame:
    """Rank of each page by clicks, day by day, and the day before it."""
    own = Window.partitionBy("day").orderBy(F.desc("clicks"), by)
    then = Window.partitionBy(by).orderBy("day")
    ranked = rows.groupBy("day", by).agg(F.sum("clicks").alias("clicks")).withColumn("rank", F.row_number().over(own))
    return ranked.withColumn("before", F.lag("rank").over(then))
