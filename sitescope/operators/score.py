"""Scores of a crawl and priorities of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..plans.settings import CATEGORIES, CATEGORY_WEIGHTS, CONFIDENCE, EFFORT_POINTS, GROUP_POINTS, IMPORTANT_POINTS, SEVERITIES, SEVERITY_POINTS, SEVERITY_WEIGHTS


def lookup(column: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def severity_rank(severity: str = "severity") -> Column:
    return lookup(F.col(severity), {s: k for k, s in enumerate(SEVERITIES)})


def denominators(pages: DataFrame) -> DataFrame:
    """A row for each crawl: pages, and pages that can be analysed."""
    return pages.groupBy("crawl_job_id").agg(F.count("*").alias("pages"), F.count_if("analysable").alias("html"))


def category_scores(findings: DataFrame, totals: DataFrame, weights: dict = SEVERITY_WEIGHTS) -> DataFrame:
    """(crawl_job_id, category, pages_considered, penalty, score) of all categories of every crawl in ``totals``; null score where no page can be judged.

    A rule's penalty is rounded to four digits before the penalties of a category are added.
    """
    cats = findings.sparkSession.createDataFrame([(c, k) for k, c in enumerate(CATEGORIES)], "category string, category_order int")
    cats = totals.join(F.broadcast(cats), F.lit(True)).select("crawl_job_id", "category", "category_order", F.when(F.col("category") == "technical", F.col("pages")).otherwise(F.col("html")).alias("n"))
    share = F.when(F.col("scope") == "site", F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("affected_page_count") / F.col("n")))
    rows = findings.join(cats, ["crawl_job_id", "category"]).where("n > 0").withColumn("penalty", lookup(F.col("severity"), weights) * share)
    rules = rows.groupBy("crawl_job_id", "category", "rule_id").agg(half_up(F.least(F.lit(1.0), F.sum("penalty")), 4).alias("penalty"))
    sums = rules.groupBy("crawl_job_id", "category").agg(F.least(F.lit(1.0), F.sum("penalty")).alias("penalty"))
    out = cats.join(sums, ["crawl_job_id", "category"], "left").withColumn("penalty", F.coalesce("penalty", F.lit(0.0)))
    score = F.when(F.col("n") > 0, half_up(100.0 * (1.0 - F.col("penalty")), 1))
    return out.select("crawl_job_id", "category", F.col("n").alias("pages_considered"), "penalty", score.alias("score"))


def overall(scores: DataFrame, weights: dict = CATEGORY_WEIGHTS) -> DataFrame:
    """A row for each crawl: the weighted mean of the categories that have a score."""
    w = lookup(F.col("category"), {k: float(v) for k, v in weights.items()})
    rows = scores.withColumn("w", w).where("score IS NOT NULL AND w > 0")
    return rows.groupBy("crawl_job_id").agg(F.when(F.sum("w") > 0, half_up(F.sum(F.col("score") * F.col("w")) / F.sum("w"), 1)).alias("overall"))


def priority(findings: DataFrame, total_pages: Column, important: Column, grouped: Column) -> DataFrame:
    """Adds priority (0 to 100) and the factors that make it up."""
    total = F.greatest(total_pages, F.lit(1))
    affected = F.when(F.col("scope") == "site", total).otherwise(F.col("affected_page_count"))
    reach = F.when(total > 1, half_up(20.0 * F.log10(1.0 + affected) / F.log10(1.0 + total), 1)).otherwise(20.0)
    importance = F.when(important | (F.col("scope") == "site"), IMPORTANT_POINTS).when(grouped, GROUP_POINTS).otherwise(0.0)
    parts = {"severity": lookup(F.col("severity"), SEVERITY_POINTS), "reach": reach, "page importance": importance, "effort": lookup(F.col("effort"), EFFORT_POINTS)}
    factor = lookup(F.col("confidence"), CONFIDENCE)
    factors = [F.struct(F.lit(k).alias("factor"), v.cast("double").alias("points"), F.lit(None).cast("double").alias("multiplier")) for k, v in parts.items()]
    factors.append(F.struct(F.lit("confidence").alias("factor"), F.lit(None).cast("double").alias("points"), factor.cast("double").alias("multiplier")))
    score = half_up(F.least(F.lit(100.0), (parts["severity"] + reach + importance + parts["effort"]) * factor), 1)
    return findings.withColumn("priority", score).withColumn("priority_breakdown", F.array(*factors))
