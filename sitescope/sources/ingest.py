"""From the log of fetches to pages and links: in one batch, or as a stream into two tables.

A fetch makes one page, or two where it was redirected: the address that was asked for with its first hop's answer, and the
address where it ended, if that is in the crawl's scope. Pages that answered 304 take what the previous crawl knew of them, and
its links; HTML pages are parsed where they are read. Of several pages with one address in a crawl the first fetched counts.

As a stream, the log is joined with the (static) previous crawl, and each batch writes its pages and links to a folder of its
own number, so that a batch which is run again after a failure replaces what it wrote. ``ingested`` reads both tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import host
from ..plans.scratch import table
from .html import parse_pages, robots_directives

FETCH = """crawl_id string, url string, depth int, via string, outcome string, status_code int, content_type string, headers map<string, string>, body string,
elapsed_ms int, error string, final_url string, redirect_chain array<struct<url: string, status_code: int, elapsed_ms: int>>, fetched_at timestamp, allowed_hosts array<string>"""
# Outcomes of fetches that failed, types that are HTML, what a 304 takes over.
FAILED = ("error", "too_large", "blocked_destination")
HTML = ("text/html", "application/xhtml+xml")
COPIED = """status_code content_type content_length title title_count meta_description meta_description_count meta_robots x_robots_tag is_noindex is_nofollow canonical_url canonical_count
lang headings h1_count word_count content_hash text images image_count images_missing_alt structured_data hreflang internal_links_count external_links_count""".split()
LINK = "array<struct<url: string, anchor_text: string, nofollow: boolean>>"


def page_id(crawl: Column, url: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("\n", crawl, url), 256), F.lit(32))


def previous_crawl(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(crawl_id, url, before): what a new crawl may take over, with each page's links (at most as many as a page keeps).

    ``crawl_id`` of both tables is that of the crawl that follows; links have source_id, target_url, anchor_text and nofollow.
    """
    own = links.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct(F.col("target_url").alias("url"), "anchor_text", "nofollow"))).alias("links"))
    rows = pages.join(own.withColumnRenamed("source_id", "id"), "id", "left").withColumn("links", F.coalesce("links", F.array().cast(LINK)))
    return rows.select("crawl_id", "url", F.struct(*COPIED, "links").alias("before"))


def _header(name: str, limit: int) -> Column:
    value = F.left(F.element_at("headers", name), F.lit(limit))
    return F.when(value != "", value)


def _arrivals(fetches: DataFrame) -> DataFrame:
    """One row for each page a fetch makes: ``part`` 0 the address asked for, 1 where a redirect ended."""
    failed, blocked = F.col("outcome").isin(*FAILED), F.col("outcome") == "blocked_by_robots"
    moved = ~failed & ~blocked & (F.coalesce(F.size("redirect_chain"), F.lit(0)) > 0)
    out = F.col("outcome") == "redirect_out_of_scope"
    on = ~out & F.array_contains("allowed_hosts", host(F.col("final_url")))
    kind = F.when(blocked, "blocked").when(failed, "failed").when(moved & out, "out").when(moved, "moved").otherwise("answer")
    parts = F.when(moved & F.coalesce(on, F.lit(False)), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = fetches.withColumn("kind", kind).withColumn("part", F.explode(parts))
    last = F.col("part") == 1
    return rows.withColumns({"kind": F.when(last, "answer").otherwise(F.col("kind")), "asked": F.col("url"), "url": F.when(last, F.col("final_url")).otherwise(F.col("url"))})


def pages_of(fetches: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Every page that the fetches make, with its facts and ``links``. ``fetches`` may be a stream; ``previous`` is a table.

    Fetches that were blocked or failed make pages without facts. A 304 without a page in the previous crawl has none either.
    """
    rows = _arrivals(fetches)
    answer, first = F.col("kind") == "answer", F.col("redirect_chain")[0]
    turned = F.col("kind").isin("moved", "out")
    status = F.when(turned, first["status_code"]).otherwise(F.col("status_code"))
    base_type = F.lower(F.trim(F.substring_index("content_type", ";", 1)))
    fine = answer & F.col("status_code").between(200, 299)
    is_html = F.coalesce(fine & base_type.isin(*HTML), F.lit(False))
    length = F.element_at("headers", "content-length")
    rows = rows.select(
        "crawl_id", "url", "asked", "part", "depth", "via", "kind", F.col("outcome").alias("outcome_name"), "final_url", status.alias("status_code"), "error", "allowed_hosts", "fetched_at",
        F.when(~turned & (F.col("content_type") != ""), F.col("content_type")).alias("content_type"),
        F.when(turned, first["elapsed_ms"]).otherwise(F.col("elapsed_ms")).alias("response_time_ms"),
        F.coalesce(F.octet_length("body"), length.try_cast("int")).alias("content_length"),
        F.when(F.col("part") == 0, F.col("redirect_chain")).otherwise(F.array().cast("array<struct<url: string, status_code: int, elapsed_ms: int>>")).alias("redirect_chain"),
        _header("etag", 300).alias("etag"), _header("last-modified", 100).alias("last_modified"), _header("x-robots-tag", 300).alias("x_robots_tag"),
        is_html.alias("is_html"), (answer & (F.col("part") == 0) & (F.col("outcome") == "not_modified")).alias("unchanged"), fine.alias("fine"),
        F.coalesce("final_url", "url").alias("base"), F.when(is_html, F.col("body")).alias("html"),
    )
    rows = parse_pages(rows, "base", "html")
    said = F.array_union(robots_directives(F.col("meta_robots")), robots_directives(F.col("x_robots_tag")))
    told = lambda x: F.col("is_html") & F.arrays_overlap(said, F.array(F.lit(x), F.lit("none")))
    inside = F.size(F.filter("links", lambda x: F.array_contains(F.col("allowed_hosts"), host(x["url"]))))
    kind = F.col("kind")
    rows = rows.withColumns({"is_noindex": told("noindex"), "is_nofollow": told("nofollow"), "internal_links_count": inside, "external_links_count": F.size("links") - inside, "text": F.when(F.col("text") != "", F.col("text"))})
    if previous is not None:
        rows = rows.join(previous, ["crawl_id", "url"], "left")
        same = F.col("unchanged") & F.col("before").isNotNull()
        rows = rows.withColumns({c: F.when(same, F.col(f"before.{c}")).otherwise(F.col(c)) for c in [*COPIED, "links"]}).withColumn("same", same).drop("before")
    else:
        rows = rows.withColumn("same", F.lit(False))
    state = F.when(kind == "blocked", "blocked_by_robots").when(kind == "failed", F.col("outcome_name")).when(kind == "out", "redirect_out_of_scope")
    state = state.when(F.col("same"), "not_modified").when((kind == "answer") & F.col("fine") & ~F.col("is_html"), "skipped_content_type").otherwise("fetched")
    fetch_id = F.left(F.sha2(F.concat_ws("\n", "crawl_id", "asked", F.col("fetched_at").cast("string"), "part"), 256), F.lit(32))
    return rows.withColumns({"id": page_id(F.col("crawl_id"), F.col("url")), "fetch_id": fetch_id, "fetch_status": state}).drop("asked", "part", "kind", "base", "is_html", "unchanged", "fine", "same", "outcome_name")


def links_of(pages: DataFrame) -> DataFrame:
    """A row for each link of each page."""
    rows = pages.select("crawl_id", "fetch_id", F.col("id").alias("source_id"), "allowed_hosts", F.explode("links").alias("x"))
    inside = F.array_contains("allowed_hosts", host(F.col("x.url")))
    return rows.select("crawl_id", "fetch_id", "source_id", F.col("x.url").alias("target_url"), inside.alias("is_internal"), F.col("x.nofollow").alias("nofollow"), F.when(F.col("x.anchor_text") != "", F.col("x.anchor_text")).alias("anchor_text"))


def first_fetched(pages: DataFrame) -> DataFrame:
    """Of every address of a crawl the page that was fetched first."""
    by = Window.partitionBy("crawl_id", "url").orderBy("fetched_at", "fetch_id")
    return pages.withColumn("k", F.row_number().over(by)).where("k = 1").drop("k")


def counts(pages: DataFrame) -> DataFrame:
    """Pages crawled, blocked and failed, by crawl."""
    is_ = lambda *xs: F.count_if(F.col("fetch_status").isin(*xs))
    blocked, failed = is_("blocked_by_robots"), is_(*FAILED)
    return pages.groupBy("crawl_id").agg((F.count("*") - blocked - failed).alias("crawled"), blocked.alias("blocked"), failed.alias("failed"))


def ingest(stream: DataFrame, out: str, checkpoint: str, previous: DataFrame | None = None):
    """The stream's writer: every batch writes its own folder of ``out``/pages and ``out``/links, anew if it is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        pages = table(batch, "ingest")  # parsed once for both tables
        pages.drop("links").write.mode("overwrite").parquet(f"{out}/pages/batch_id={number}")
        links_of(pages).write.mode("overwrite").parquet(f"{out}/links/batch_id={number}")

    return pages_of(stream, previous).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def ingested(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(pages, links) that the stream has written: one page for each address, and the links of those pages."""
    pages = first_fetched(spark.read.parquet(f"{out}/pages"))
    return pages, spark.read.parquet(f"{out}/links").join(pages.select("fetch_id"), "fetch_id", "left_semi")
