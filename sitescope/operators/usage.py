"""Use of plans and of the assistant: quotas, reports, failure reasons, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up


def quota(events: DataFrame, now: Column, at: str = "created_at", org: str = "organisation_id") -> DataFrame:
    """(organisation, this month, today) of counted events, in UTC."""
    month, day = F.date_trunc("MONTH", now), F.date_trunc("DAY", now)
    return events.groupBy(org).agg(F.count_if((F.col(at) >= month) & (F.col(at) <= now)).alias("this_month"), F.count_if((F.col(at) >= day) & (F.col(at) <= now)).alias("today"))


def over_quota(used: DataFrame, limit: int, column: str = "this_month") -> DataFrame:
    return used.where(F.col(column) >= limit)


def reasons(violations: Column, error: Column) -> Column:
    """Why a task failed: what stands before the colon of each violation (claims whole), else the error without its bracket."""
    claim = "Makes an unsupported claim"
    short = F.transform(violations, lambda v: F.when(F.startswith(v, F.lit(claim)), v).otherwise(F.substring_index(v, ":", 1)))
    plain = F.trim(F.regexp_replace(F.coalesce(error, F.lit("Unknown error")), r"\s*\(.*\)\.?$", ""))
    return F.when(F.size(violations) > 0, short).otherwise(F.array(plain))


def failure_reasons(tasks: DataFrame, limit: int = 10) -> DataFrame:
    rows = tasks.where("status = 'failed'").select(F.explode(reasons(F.col("violations"), F.col("error"))).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("tasks")).orderBy(F.desc("tasks"), "reason").limit(limit)


def usage_report(tasks: DataFrame, newest: int = 5000) -> DataFrame:
    """By kind: tasks, outcomes, mean tries, median seconds, mean prompt tokens a call and cold starts, of the newest tasks."""
    rows = tasks.where(F.col("status").isin("completed", "failed")).orderBy(F.desc("created_at"), F.desc("id")).limit(newest)
    tries = F.when(F.coalesce("calls", F.lit(0)) > 0, F.col("calls")).otherwise(F.col("attempts"))
    return rows.groupBy("kind").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        half_up(F.avg(tries), 2).alias("avg_tries"),
        half_up(F.percentile(F.col("duration_ms") / 1000.0, 0.5), 1).alias("median_seconds"),
        half_up(F.sum("prompt_tokens") / F.sum(tries), 0).alias("tokens_per_call"),
        F.count_if(F.col("load_ms") > 1000).alias("cold_starts"),
    )


def feedback(ratings: DataFrame, tasks: DataFrame) -> DataFrame:
    """By kind of task: ratings and how many were helpful."""
    return ratings.join(tasks.select("task_id", "kind"), "task_id").groupBy("kind").agg(F.count("*").alias("ratings"), F.count_if(F.col("helpful")).alias("helpful"))


def latest_feedback(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: for each task and user the newest rating."""
    rows = old.unionByName(new)
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in ("task_id", "user_id")]), "created_at").alias("v")
    return rows.groupBy("task_id", "user_id").agg(last).select("task_id", "user_id", "v.*")


def evaluation_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("cases"),
        F.count_if("passed").alias("passed"),
        F.count_if("completed").alias("completed"),
        F.count_if("grounded").alias("grounded"),
        half_up(F.percentile("seconds", 0.5), 1).alias("median_seconds"),
        half_up(F.avg(F.when(F.col("completed"), F.col("prompt_tokens"))), 0).alias("avg_prompt_tokens"),
    )


def preview(answer: Column, limit: int = 200) -> Column:
    return F.when(F.length(answer) > limit, F.concat(F.left(answer, F.lit(limit - 3)), F.lit("..."))).otherwise(answer)
