"""Issues across crawls: merge of findings, triage, and checks of the drafts' trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import table

MAX_URLS = 200
VALUES = ("severity", "affected_urls", "affected_page_count", "priority")


def verified(issues: DataFrame, crawled: DataFrame) -> DataFrame:
    """Adds ``verified``: whether the crawl saw all that an issue affects. Site issues always are.

    Addresses are exploded and joined, not tested against an array of all crawled ones.
    """
    urls = issues.where("scope <> 'site'").select("issue_key", F.explode(F.array_distinct("affected_urls")).alias("u"))
    seen = crawled.select(F.col("url").alias("u")).distinct().withColumn("seen", F.lit(True))
    all_seen = urls.join(seen, "u", "left").groupBy("issue_key").agg(F.count_if(F.col("seen").isNull()).alias("unseen"))
    out = issues.join(all_seen, "issue_key", "left")
    return out.withColumn("verified", (F.col("scope") == "site") | F.coalesce(F.col("unseen") == 0, F.lit(False))).drop("unseen")


def merge(issues: DataFrame, findings: DataFrame, crawled: DataFrame, crawl_id: Column, now: Column) -> DataFrame:
    """The issues after a crawl.

    New findings open an issue; found again, open ones are updated, ignored ones stay ignored, resolved ones reopen and
    count a recurrence; not found, open and ignored ones are resolved if the crawl saw what they affect. ``issues``:
    issue_key, scope, status, severity, affected_urls, affected_page_count, priority, first_crawl, last_crawl, resolved_in,
    first_detected_at, last_detected_at, resolved_at, recurrence_count.
    """
    new = findings.select("issue_key", F.col("scope").alias("new_scope"), *[F.col(c).alias(f"new_{c}") for c in VALUES], F.lit(True).alias("found"))
    both = verified(issues, crawled).withColumn("known", F.lit(True)).join(new, "issue_key", "full_outer")
    found, known = F.coalesce("found", F.lit(False)), F.coalesce("known", F.lit(False))
    back = found & known & (F.col("status") == "resolved")
    gone = ~found & F.col("status").isin("open", "ignored") & F.coalesce("verified", F.lit(False))
    status = F.when(~known | back, "open").when(gone, "resolved").otherwise(F.col("status"))
    value = lambda c: F.when(found, F.slice(F.col(f"new_{c}"), 1, MAX_URLS) if c == "affected_urls" else F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(
        "issue_key",
        F.coalesce("scope", "new_scope").alias("scope"),
        status.alias("status"),
        *[value(c) for c in VALUES],
        F.when(known, F.col("first_crawl")).otherwise(crawl_id).alias("first_crawl"),
        F.when(found, crawl_id).otherwise(F.col("last_crawl")).alias("last_crawl"),
        F.when(gone, crawl_id).when(~back, F.col("resolved_in")).alias("resolved_in"),
        F.when(known, F.col("first_detected_at")).otherwise(now).alias("first_detected_at"),
        F.when(found, now).otherwise(F.col("last_detected_at")).alias("last_detected_at"),
        F.when(gone, now).when(~back, F.col("resolved_at")).alias("resolved_at"),
        (F.coalesce("recurrence_count", F.lit(0)) + back.cast("int")).alias("recurrence_count"),
    )


def save(issues: DataFrame, path: str) -> None:
    """Replaces an issue table that the new state was computed from: written aside first, as it cannot be read and overwritten at once."""
    table(issues, "issues").write.mode("overwrite").parquet(path)


def triage(issues: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sets open and ignored issues to the wanted status; resolved ones do not change."""
    asks = wanted.select("issue_key", F.col("status").alias("wanted")).where(F.col("wanted").isin("open", "ignored"))
    out = issues.join(asks, "issue_key", "left")
    return out.withColumn("status", F.when(F.col("status").isin("open", "ignored") & F.col("wanted").isNotNull(), F.col("wanted")).otherwise(F.col("status"))).drop("wanted")


# The actions on a draft, the statuses they start from and where they lead.
MOVES = {
    "created": (("",), "draft"),
    "edited": (("draft", "rejected"), "draft"),
    "submitted": (("draft",), "pending_review"),
    "approved": (("pending_review",), "approved"),
    "rejected": (("pending_review",), "rejected"),
    "reopened": (("approved", "rejected"), "draft"),
    "published": (("approved",), "published"),
    "rolled_back": (("published",), "rolled_back"),
}


def trail_errors(log: DataFrame, draft: str = "draft_id", order: str = "created_at", moves: dict = MOVES) -> DataFrame:
    """Steps whose from_status is not the to_status before, or that their action does not allow."""
    by = Window.partitionBy(draft).orderBy(order, "id")
    rows = log.withColumn("expected", F.lag("to_status", 1, "").over(by))
    allowed = F.lit(False)
    for action, (sources, target) in moves.items():
        allowed = allowed | ((F.col("action") == action) & F.col("from_status").isin(*sources) & (F.col("to_status") == target))
    return rows.where((F.col("from_status") != F.col("expected")) | ~allowed)


def current_drafts(log: DataFrame, draft: str = "draft_id") -> DataFrame:
    return log.groupBy(draft).agg(F.max_by("to_status", F.struct("created_at", "id")).alias("status"), F.count("*").alias("steps"))


def contributors(*relations: DataFrame) -> DataFrame:
    """(draft_id, user_id) of everyone who made, edited, submitted or asked for a draft."""
    out = relations[0].select("draft_id", "user_id")
    for r in relations[1:]:
        out = out.unionByName(r.select("draft_id", "user_id"))
    return out.where("user_id IS NOT NULL").distinct()
