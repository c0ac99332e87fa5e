"""What stored reports are made of, for all reports at once: health with the score before, counts, first issues, the
management summary and accepted recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..plans.settings import CATEGORIES, SEVERITIES
from .reports import SECTION

PROJECT = ["organisation_id", "project_id"]
PRIORITY = 25
PARTS = 64


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], limit: int, spread: str) -> DataFrame:
    """The first ``limit`` rows of each group with their ``rank``. Ranks are given within parts of a group first, so that a
    task which orders a whole group has ``PARTS * limit`` rows of it at most."""
    out = rows.withColumn("part", F.pmod(F.xxhash64(spread), F.lit(PARTS)))
    for by in ([*keys, "part"], keys):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)
    return out.drop("part")


def health(reports: DataFrame, scores: DataFrame, crawls: DataFrame) -> DataFrame:
    """(report_id, overall, previous_overall, change) of each report.

    ``reports`` have report_id, organisation_id, project_id, crawl_job_id; ``scores`` one row for each analysed crawl (with
    created_at, overall); ``crawls`` id and created_at. The score before is the newest of the project that is older than the
    report's own, or than its crawl where that has none; of those made at one time that of the largest crawl. Change is
    null where either score is. Reports whose crawl is gone or of another project are left out. Reports and scores of a
    project are ordered together in one window: no join by inequality.
    """
    crawl = crawls.select(*PROJECT, F.col("id").alias("crawl_job_id"), F.col("created_at").alias("crawl_at"))
    own = scores.select("crawl_job_id", F.col("created_at").alias("scored_at"), "overall")
    asks = reports.select("report_id", *PROJECT, "crawl_job_id").join(crawl, [*PROJECT, "crawl_job_id"]).join(own, "crawl_job_id", "left")
    asks = asks.select(*PROJECT, F.coalesce("scored_at", "crawl_at").alias("at"), F.lit(0).alias("kind"), "crawl_job_id", "report_id", "overall", F.lit(None).cast("struct<overall: double>").alias("score"))
    told = scores.select(*PROJECT, F.col("created_at").alias("at"), F.lit(1).alias("kind"), "crawl_job_id", F.lit(None).cast(reports.schema["report_id"].dataType).alias("report_id"), F.lit(None).cast("double").alias("overall"), F.struct(F.col("overall").cast("double").alias("overall")).alias("score"))
    # A report comes before the scores of its own time, which so are not older.
    before = Window.partitionBy(*PROJECT).orderBy("at", "kind", "crawl_job_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = asks.unionByName(told).withColumn("previous_overall", F.last("score", ignorenulls=True).over(before)["overall"]).where("kind = 0")
    return rows.select("report_id", "overall", "previous_overall", half_up(F.col("overall") - F.col("previous_overall"), 1).alias("change"))


def counts(issues: DataFrame) -> DataFrame:
    """One row for each project: open issues, those of each severity and category, and how many are ignored or resolved."""
    is_open = F.col("status") == "open"
    some = [F.count_if(is_open & (F.col("severity") == s)).alias(s) for s in SEVERITIES] + [F.count_if(is_open & (F.col("category") == c)).alias(c) for c in CATEGORIES]
    return issues.groupBy(*PROJECT).agg(F.count_if(is_open).alias("open"), *some, *[F.count_if(F.col("status") == s).alias(s) for s in ("ignored", "resolved")])


def first_issues(issues: DataFrame) -> DataFrame:
    """(project, section, rank, issue_key): the first open issues by priority of each category (10) and of the two highest
    severities (25). One shuffle ranks all sections of all projects."""
    rows = issues.where("status = 'open'")
    severe = F.when(F.col("severity").isin("critical", "high"), F.col("severity"))
    rows = rows.select(*PROJECT, "issue_key", "priority", F.explode(F.array_compact(F.array("category", severe))).alias("section"))
    ranked = first_rows(rows, [*PROJECT, "section"], [F.desc("priority"), F.col("issue_key")], PRIORITY, "issue_key")
    return ranked.where((F.col("rank") <= SECTION) | F.col("section").isin("critical", "high")).select(*PROJECT, "section", "rank", "issue_key")


def written(reports: DataFrame, analyses: DataFrame, recommendations: DataFrame) -> DataFrame:
    """(report_id, included, summary, recommendations): the newest completed management summary of a report's crawl, and the
    newest ten accepted recommendations of its project.

    Reports with ``include_ai`` false have neither. The newest summary counts even if its output is null, and then there is
    none. Ties go to the larger id; of summaries that repeat an id and a time, the largest output (then model) counts.
    """
    done = analyses.where("kind = 'management_summary' AND status = 'completed'")
    newest = done.groupBy(*PROJECT, "crawl_job_id").agg(F.max_by(F.struct("output", "model", F.col("finished_at").alias("generated_at")), F.struct("finished_at", "id", "output", "model")).alias("s"))
    newest = newest.select(*PROJECT, "crawl_job_id", F.when(F.col("s.output").isNotNull(), F.col("s")).alias("summary"))
    taken = first_rows(recommendations.where("status = 'accepted'"), PROJECT, [F.desc("created_at"), F.desc("id")], SECTION, "id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct("title", "body", "steps", "page_url").alias("r")))), lambda x: x["r"])
    taken = taken.groupBy(*PROJECT).agg(listed.alias("recommendations"))
    asks = reports.select("report_id", *PROJECT, "crawl_job_id", F.coalesce("include_ai", F.lit(False)).alias("included"))
    rows = asks.join(newest, [*PROJECT, "crawl_job_id"], "left").join(taken, PROJECT, "left")
    none = F.array().cast(taken.schema["recommendations"].dataType)
    return rows.select("report_id", "included", F.when(F.col("included"), F.col("summary")).alias("summary"), F.when(F.col("included"), F.coalesce("recommendations", none)).otherwise(none).alias("recommendations"))
