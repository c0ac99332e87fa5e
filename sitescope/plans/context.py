"""What the rules see of a crawl: pages and links with derived columns, computed once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .scratch import table
from .settings import FAILED_FETCHES, Settings

#: A side is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 50_000


def analysable() -> Column:
    ok = F.col("fetch_status").isin("fetched", "not_modified") & F.col("status_code").between(200, 299)
    return F.coalesce(ok & F.col("content_type").isin("text/html", "application/xhtml+xml"), F.lit(False))


def canonicalised_elsewhere() -> Column:
    return F.coalesce((F.col("canonical_url") != "") & (F.col("canonical_url") != F.col("url")), F.lit(False))


def is_redirect() -> Column:
    return F.coalesce(F.col("status_code").between(300, 399), F.lit(False))


def failed() -> Column:
    """Status of 400 and up, or a fetch that did not come through; null status is no error."""
    return F.coalesce(F.col("status_code") >= 400, F.lit(False)) | F.coalesce(F.col("fetch_status").isin(*FAILED_FETCHES), F.lit(False))


def important(settings: Settings, url: str = "url") -> Column:
    return F.coalesce(F.col(url).isin(settings.root_url, *settings.important_pages), F.lit(False))


def page_group(settings: Settings, url: str = "url") -> Column:
    """The first configured group that matches the path, or null."""
    out = F.lit(None).cast("string")
    for name, patterns in reversed(settings.page_groups):
        out = F.when(urls.matches_any(urls.path(F.col(url)), patterns), F.lit(name)).otherwise(out)
    return out


def content_types(settings: Settings, url: str = "url") -> Column:
    keys = [F.when(urls.matches_any(urls.path(F.col(url)), t.patterns), F.lit(t.key)) for t in settings.content_types]
    return F.filter(F.array(*keys), lambda k: k.isNotNull()) if keys else F.array().cast("array<string>")


@dataclass
class Context:
    """``pages`` and ``links`` of one or more crawls of a site, and ``job``, one row of facts for each crawl."""

    pages: DataFrame
    links: DataFrame
    job: DataFrame
    settings: Settings

    @classmethod
    def of(cls, pages: DataFrame, links: DataFrame, job: DataFrame, settings: Settings) -> Context:
        rows = pages.withColumns({"analysable": analysable(), "elsewhere": canonicalised_elsewhere(), "redirected": is_redirect(), "important": important(settings)})
        rows = rows.withColumn("indexable", F.col("analysable") & ~F.coalesce("is_noindex", F.lit(False)) & ~F.col("elsewhere"))
        return cls(rows, links, job, settings)

    def beside_job(self, rows: DataFrame, *columns: Column) -> DataFrame:
        """``rows`` with columns of their crawl's facts; these are broadcast only where they were counted and are few."""
        facts = self.job.select(F.col("id").alias("crawl_job_id"), *columns)
        return rows.join(F.broadcast(facts) if facts.count() <= BROADCAST_ROWS else facts, "crawl_job_id", "left")


def page_limit_reached() -> Column:
    return F.exists(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.contains(w, F.lit("page limit")))


def resolve_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Sets target_id to the page with the link's address in the same crawl; null where there is none."""
    targets = pages.select("crawl_job_id", F.col("url").alias("target_url"), F.col("id").alias("target_id"))
    return links.drop("target_id").join(targets, ["crawl_job_id", "target_url"], "left")


def count_inlinks(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Sets inlinks_count: distinct other pages with an internal link to a page."""
    seen = links.where("is_internal AND target_id IS NOT NULL AND source_id <> target_id").select("source_id", "target_id").distinct()
    counts = seen.groupBy(F.col("target_id").alias("id")).agg(F.count("*").cast("int").alias("inlinks_count"))
    return pages.drop("inlinks_count").join(counts, "id", "left").fillna({"inlinks_count": 0})


def mark_orphans(pages: DataFrame, root_url: str, complete: bool = True) -> DataFrame:
    """Sets is_orphan: in the sitemap, fetched and never linked; never where the crawl was cut short."""
    orphan = F.col("in_sitemap") & (F.col("inlinks_count") == 0) & (F.col("url") != root_url) & F.col("fetch_status").isin("fetched", "not_modified")
    return pages.withColumn("is_orphan", F.coalesce(orphan, F.lit(False)) & F.lit(complete))


def depths(root: str, edges: DataFrame, max_depth: int) -> DataFrame:
    """(url, depth) of all pages within ``max_depth`` links of the root, over edges (source, target)."""
    spark = edges.sparkSession
    seen = front = spark.createDataFrame([(root, 0)], "url string, depth int")
    for d in range(1, max_depth + 1):
        front = edges.join(front, F.col("source") == F.col("url")).select(F.col("target").alias("url")).distinct()
        front = table(front.join(seen, "url", "left_anti").withColumn("depth", F.lit(d)), "depths")
        seen = seen.unionByName(front)
    return seen


def frontier(links: DataFrame, roots: DataFrame, listed: DataFrame, max_depth: int, max_pages: int) -> DataFrame:
    """(site, url, depth, via, place, crawled): what a crawl of every site reaches, for all sites at once.

    ``links`` are (site, source, target), ``roots`` (site, url), ``listed`` (site, url) the addresses of sitemaps. A level of all
    sites is one join; pages that no link reaches within ``max_depth`` have no depth and are recorded, not followed. A site's
    first ``max_pages`` by depth and address are crawled, those of sitemaps last.
    """
    seen = front = table(roots.select("site", "url").distinct().withColumn("depth", F.lit(0)), "frontier")
    edges = links.select("site", F.col("source").alias("url"), "target").distinct()
    for d in range(1, max_depth + 1):
        reached = edges.join(front.select("site", "url"), ["site", "url"]).select("site", F.col("target").alias("url")).distinct()
        front = table(reached.join(seen, ["site", "url"], "left_anti").withColumn("depth", F.lit(d)), "frontier")
        if not front.head(1):
            break
        seen = seen.unionByName(front)
    alone = listed.select("site", "url").distinct().join(seen, ["site", "url"], "left_anti").withColumn("depth", F.lit(None).cast("int"))
    rows = seen.unionByName(alone).withColumn("via", F.when(F.col("depth") == 0, "root").when(F.col("depth") > 0, "link").otherwise("sitemap"))
    by = Window.partitionBy("site").orderBy(F.col("depth").asc_nulls_last(), "url")
    return rows.withColumn("place", F.row_number().over(by)).withColumn("crawled", F.col("place") <= max_pages)
