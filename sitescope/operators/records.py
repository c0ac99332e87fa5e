"""Listings and state changes of the other relations: projects, crawls, members, invitations, analyses, drafts, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import contains_text, page_of


def listing(rows: DataFrame, *, equal: dict | None = None, q: str | None = None, searched: tuple[str, ...] = (), order: tuple[Column, ...] = (), number: int = 1, size: int = 25) -> DataFrame:
    """One page of rows that equal given values and hold a text; values of None do not filter."""
    for column, value in (equal or {}).items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if q:
        rows = rows.where(contains_text(list(searched), q))
    return page_of(rows.orderBy(*order), number, size)


def list_projects(projects: DataFrame, q: str | None = None, sort: str = "name", descending: bool = False, **page) -> DataFrame:
    """Live projects by name, domain or age; ties go by id."""
    key = F.col(sort).desc() if descending else F.col(sort).asc()
    return listing(projects.where("deleted_at IS NULL"), q=q, searched=("name", "domain"), order=(key, F.col("id").asc()), **page)


def list_crawls(crawls: DataFrame, projects: DataFrame, project_id=None, status: str | None = None, analysed: bool | None = None, **page) -> DataFrame:
    """Crawls of live projects, newest first."""
    live = projects.where("deleted_at IS NULL").select(F.col("id").alias("project_id"), F.col("name").alias("project_name"))
    rows = crawls.join(live, "project_id")
    if analysed is not None:
        done = F.coalesce(F.col("analysis_status") == "completed", F.lit(False))
        rows = rows.where(done if analysed else ~done)
    return listing(rows, equal={"project_id": project_id, "status": status}, order=(F.desc("created_at"), F.desc("id")), **page)


def list_analyses(analyses: DataFrame, kind: str | None = None, subject_id=None, page_url: str | None = None, **page) -> DataFrame:
    """Analyses, newest first; ``page_url`` is looked up in their parameters."""
    rows = analyses if page_url is None else analyses.where(F.get_json_object("params", "$.page_url") == page_url)
    return listing(rows, equal={"kind": kind, "subject_id": subject_id}, order=(F.desc("created_at"), F.desc("id")), **page)


def list_drafts(drafts: DataFrame, status: str | None = None, page_url: str | None = None, **page) -> DataFrame:
    return listing(drafts, equal={"status": status, "page_url": page_url}, order=(F.desc("updated_at"), F.desc("id")), **page)


def newest(rows: DataFrame, limit: int, **equal) -> DataFrame:
    """The newest rows: syncs, reports, recommendations."""
    return listing(rows, equal=equal, order=(F.desc("created_at"), F.desc("id")), size=limit)


def organisations_of(organisations: DataFrame, members: DataFrame, user_id, admin: bool = False) -> DataFrame:
    """A user's active organisations with the role; an administrator sees all, also without a role."""
    own = members.where(F.col("user_id") == user_id).select(F.col("organisation_id").alias("id"), "role")
    rows = organisations.join(own, "id", "left")
    return (rows if admin else rows.where("role IS NOT NULL AND is_active")).orderBy("name", "id")


def members_of(members: DataFrame, users: DataFrame, organisation_id) -> DataFrame:
    own = members.where(F.col("organisation_id") == organisation_id)
    return own.join(users.select(F.col("id").alias("user_id"), "full_name"), "user_id").orderBy("full_name", "user_id")


def owners(members: DataFrame) -> DataFrame:
    return members.where("role = 'owner'").groupBy("organisation_id").agg(F.count("*").alias("owners"))


def pending_invitations(invitations: DataFrame, now: Column) -> DataFrame:
    return invitations.where(F.col("accepted_at").isNull() & F.col("revoked_at").isNull() & (F.col("expires_at") > now)).orderBy(F.desc("created_at"), F.desc("id"))


def connection_state(integrations: DataFrame, syncs: DataFrame) -> DataFrame:
    """One row: whether an integration is usable, and when one was last read with success."""
    done = syncs.where("status = 'succeeded'").join(integrations.where("enabled").select(F.col("id").alias("integration_id")), "integration_id", "left_semi")
    last = done.agg(F.max("finished_at").alias("last_synced_at"))
    return integrations.agg((F.count_if("enabled") > 0).alias("connected")).join(F.broadcast(last), F.lit(True))  # one row each


def plan_limits(organisations: DataFrame, plans: DataFrame) -> DataFrame:
    """Each organisation's plan: its own, else the default one; limits are null where there is none."""
    own = organisations.join(plans.withColumnRenamed("id", "plan_id"), "plan_id", "left")
    default = plans.where("is_default").limit(1).select(F.col("name").alias("default_name"), F.col("crawls_per_month").alias("default_limit"))
    rows = own.join(F.broadcast(default), F.lit(True), "left")  # one row
    return rows.select("organisation_id", F.coalesce("name", "default_name").alias("plan"), F.when(F.col("name").isNotNull(), F.col("crawls_per_month")).otherwise(F.col("default_limit")).alias("crawls_per_month"))


def start_crawls(wanted: DataFrame, crawls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) requests: a project with an active crawl gets no second one. Accepted ones name the newest completed crawl."""
    active = crawls.where(F.col("status").isin("queued", "running", "cancelling")).select("project_id").distinct()
    last = crawls.where("status = 'completed'").groupBy("project_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("previous_id"))
    accepted = wanted.join(active, "project_id", "left_anti").join(last, "project_id", "left").withColumn("status", F.lit("queued"))
    return accepted, wanted.join(active, "project_id", "left_semi")


def cancel(crawls: DataFrame, asked: DataFrame) -> DataFrame:
    """Waiting crawls are cancelled at once, running ones are told to stop."""
    rows = crawls.join(asked.select("id").distinct().withColumn("asked", F.lit(True)), "id", "left")
    status = F.when(F.col("asked") & (F.col("status") == "queued"), "cancelled").when(F.col("asked") & (F.col("status") == "running"), "cancelling").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("asked")


def analysable_crawls(crawls: DataFrame) -> DataFrame:
    """Crawls whose analysis may be asked for: completed, with pages, not waiting or running, and the newest completed one."""
    by = Window.partitionBy("project_id").orderBy(F.desc("created_at"), F.desc("id"))
    rows = crawls.where("status = 'completed'").withColumn("k", F.row_number().over(by)).where("k = 1").drop("k")
    return rows.where(F.col("pages_pruned_at").isNull() & ~F.coalesce(F.col("analysis_status").isin("queued", "running"), F.lit(False)))


def single_default(plans: DataFrame, chosen) -> DataFrame:
    """Exactly one default plan."""
    return plans.withColumn("is_default", F.col("id") == chosen)


def revoked_families(tokens: DataFrame, used: DataFrame) -> DataFrame:
    """Families of tokens of which a revoked one was used again: all their tokens are revoked."""
    bad = used.join(tokens.where("revoked").select("token", "family_id"), "token").select("family_id").distinct()
    hit = tokens.join(bad.withColumn("bad", F.lit(True)), "family_id", "left")
    return hit.withColumn("revoked", F.col("revoked") | F.coalesce("bad", F.lit(False))).drop("bad")


def search_preview(title: Column, description: Column) -> Column:
    """How a search result would show a page: title and description cut with an ellipsis."""
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.rtrim(F.left(c, F.lit(n - 1))), F.lit("…"))).otherwise(c)
    return F.struct(cut(title, 60).alias("title"), cut(description, 158).alias("description"))


def with_refs(texts: DataFrame, refs: DataFrame, column: str = "text", pattern: str = "i[0-9]+") -> DataFrame:
    """Texts with issue keys put as their short references: words are exploded, joined and put together again."""
    words = texts.select("id", F.posexplode(F.split(F.col(column), " ")).alias("n", "w"))
    key = F.regexp_extract("w", f"^({pattern})([.,;:]*)$", 1)
    named = words.withColumn("issue_key", key).join(refs.select("issue_key", "ref"), "issue_key", "left")
    shown = F.when(F.col("ref").isNotNull(), F.concat("ref", F.regexp_extract("w", "[.,;:]*$", 0))).otherwise(F.col("w"))
    own = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", shown.alias("w")))).alias("ws"))
    return own.select("id", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias(column))
