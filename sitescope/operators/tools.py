"""The registry of parameterised queries: what an assistant may ask about a project, each a function to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up
from . import answers, catalogue, compare, history, search


@dataclass(frozen=True)
class Project:
    """The relations of one project: its latest crawl, its issues and its search figures."""

    pages: DataFrame
    links: DataFrame
    issues: DataFrame
    checks: DataFrame
    suggestions: DataFrame
    days: DataFrame
    queries: DataFrame
    crawls: DataFrame
    before: DataFrame | None = None


def page_facts(pages: DataFrame) -> DataFrame:
    """What is told about a page: its fields, main headings, an outline and the start of its text."""
    heads = F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"])
    outline = F.transform("headings", lambda h: F.concat(F.lit("H"), h["level"].cast("string"), F.lit(": "), h["text"]))
    return pages.select("url", "status_code", "title", "meta_description", "canonical_url", "lang", "word_count", "inlinks_count", F.slice(heads, 1, 10).alias("h1"), F.slice(outline, 1, 25).alias("outline"), F.left("text", F.lit(1500)).alias("excerpt"))


def project_summary(p: Project) -> DataFrame:
    """One row: pages, open issues by severity, and the newest crawl."""
    open_ = p.issues.where("status = 'open'").agg(F.count("*").alias("open"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "informational")])
    newest = p.crawls.orderBy(F.desc("created_at"), F.desc("id")).limit(1).select(F.col("id").alias("crawl"), F.col("status").alias("crawl_status"))
    pages = p.pages.agg(F.count("*").alias("pages"))
    return open_.join(F.broadcast(pages), F.lit(True)).join(F.broadcast(newest), F.lit(True), "left")  # one row each


def top_issues(p: Project, limit: int = 10, severity: str | None = None, category: str | None = None) -> DataFrame:
    rows = p.issues.where("status = 'open'")
    rows = rows if severity is None else rows.where(F.col("severity") == severity)
    rows = rows if category is None else rows.where(F.col("category") == category)
    return rows.orderBy(F.desc("priority"), "issue_key").limit(min(max(limit, 1), 20))


def issue_evidence(p: Project, issue_key: str) -> DataFrame:
    return p.issues.where(F.col("issue_key") == issue_key)


def page_details(p: Project, url: str) -> DataFrame:
    """The page's facts with the keys of its open issues."""
    own = history.open_on_page(p.issues, F.lit(url)).agg(F.collect_list("issue_key").alias("issues"))
    return page_facts(p.pages.where(F.col("url") == url)).join(F.broadcast(own), F.lit(True), "left")  # one row each


def internal_links(p: Project, url: str, limit: int = 30) -> DataFrame:
    """(kind, url, text): links to a page, from it, and suggested ones."""
    page = p.pages.where(F.col("url") == url).select(F.col("id").alias("page_id"))
    links = p.links.join(F.broadcast(page), (F.col("source_id") == F.col("page_id")) | (F.col("target_id") == F.col("page_id")))  # one page
    source = p.pages.select(F.col("id").alias("source_id"), F.col("url").alias("source_url"))
    to = links.where("target_id = page_id").join(source, "source_id").select(F.lit("inbound").alias("kind"), F.col("source_url").alias("url"), "anchor_text").orderBy("url").limit(limit)
    out = links.where("source_id = page_id").select(F.lit("outbound").alias("kind"), F.col("target_url").alias("url"), "anchor_text").orderBy("url").limit(limit)
    more = p.suggestions.where(F.col("target_url") == url).select(F.lit("suggested").alias("kind"), F.col("source_url").alias("url"), "anchor_text")
    return to.unionByName(out).unionByName(more)


def schema_findings(p: Project, url: str | None = None, invalid_only: bool = False, limit: int = 30) -> DataFrame:
    rows = p.checks if url is None else p.checks.where(F.col("url") == url)
    rows = rows.where("NOT valid") if invalid_only else rows
    return rows.orderBy("valid", "url").limit(limit).select("url", "format", "types", "valid", F.slice("errors", 1, 5).alias("errors"), F.slice("warnings", 1, 5).alias("warnings"))


def crawl_changes(p: Project) -> DataFrame:
    if p.before is None:
        raise ValueError("there is one analysed crawl; a comparison needs two")
    return compare.summary(compare.changes(p.before, p.pages))


def rule(p: Project, rule_id: str) -> DataFrame:
    return catalogue.catalogue(p.pages.sparkSession).where(F.col("id") == rule_id)


def search_performance(p: Project, days: int = 28) -> DataFrame:
    """One row: totals of the window, the click rate in percent, and top pages, queries and opportunities."""
    rows = search.window(p.days, days)
    lists = {"pages": search.top(rows, "page", 10), "queries": search.top(p.queries, "query", 10), "opportunities": search.opportunities(rows, 5)}
    out = search.totals(rows).withColumn("ctr_percent", half_up(F.col("ctr") * 100, 1))
    for name, df in lists.items():
        out = out.join(F.broadcast(df.agg(F.collect_list(F.struct("*")).alias(name))), F.lit(True))  # ten rows at most
    return out


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "get_project_summary": project_summary,
    "get_seo_issues": top_issues,
    "get_issue_evidence": issue_evidence,
    "get_page_details": page_details,
    "get_internal_links": internal_links,
    "get_schema_findings": schema_findings,
    "compare_latest_crawls": crawl_changes,
    "get_rule": rule,
    "get_search_performance": search_performance,
}


def run(project: Project, name: str, **arguments) -> DataFrame:
    """Runs a tool by name; unknown names and arguments are errors."""
    import inspect

    if name not in TOOLS:
        raise KeyError(f"no tool named {name}; there are {', '.join(TOOLS)}")
    known = set(inspect.signature(TOOLS[name]).parameters) - {"p"}
    if extra := set(arguments) - known:
        raise TypeError(f"{name} takes {', '.join(sorted(known)) or 'no arguments'}, not {', '.join(sorted(extra))}")
    return TOOLS[name](project, **arguments)


def evidence_for(questions: DataFrame, issues: DataFrame, per_topic: int = 8) -> DataFrame:
    """(question_id, topic, issue_key, rank): the open issues that each question's topics are about.

    Topics are exploded and joined with issues by rule prefix through the small table of topics.
    """
    spark: SparkSession = questions.sparkSession
    dim = spark.createDataFrame([(t, x) for t, _, prefixes in answers.TOPICS for x in prefixes], "topic string, prefix string")
    by = Window.partitionBy("topic").orderBy(F.desc("priority"), "issue_key")
    rows = issues.where("status = 'open'").join(F.broadcast(dim), F.expr("startswith(rule_id, prefix)"))  # some thirty prefixes
    top = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_topic).select("topic", "issue_key", "rank")
    asked = questions.select("question_id", F.explode(answers.topics(F.col("question"))).alias("topic"))
    return asked.join(F.broadcast(top), "topic")  # topics times per_topic rows
