"""Two crawls of a site compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up

CHANGES = ("added", "removed", "status", "title", "meta_description", "redirect", "content", "inbound_links")
FIRST = 50


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, url, before, after), from one full outer join on the address."""
    own = ["status_code", "title", "meta_description", "final_url", "redirects", "content_hash", "inlinks_count", "analysable"]
    side = lambda df, p: df.select("url", F.lit(True).alias(f"{p}_here"), *[F.col(c).alias(f"{p}_{c}") for c in own])
    both = side(old, "o").join(side(new, "n"), "url", "full_outer")
    common = F.col("o_here").isNotNull() & F.col("n_here").isNotNull()
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    target = lambda p: F.when(F.col(f"{p}_redirects") > 0, F.col(f"{p}_final_url"))
    seen = common & F.coalesce("n_analysable", F.lit(False))
    found = [
        ("added", F.col("o_here").isNull(), F.lit(None), F.lit(None)),
        ("removed", F.col("n_here").isNull(), F.lit(None), F.lit(None)),
        ("status", common & ~F.col("o_status_code").eqNullSafe(F.col("n_status_code")), F.col("o_status_code"), F.col("n_status_code")),
        ("title", seen & (text("o_title") != text("n_title")), F.col("o_title"), F.col("n_title")),
        ("meta_description", seen & (text("o_meta_description") != text("n_meta_description")), F.col("o_meta_description"), F.col("n_meta_description")),
        ("redirect", common & ~target("o").eqNullSafe(target("n")), target("o"), target("n")),
        ("content", common & (text("o_content_hash") != "") & (text("n_content_hash") != "") & (F.col("o_content_hash") != F.col("n_content_hash")), F.lit(None), F.lit(None)),
        ("inbound_links", common & ~F.col("o_inlinks_count").eqNullSafe(F.col("n_inlinks_count")), F.col("o_inlinks_count"), F.col("n_inlinks_count")),
    ]
    hits = [F.when(c, F.struct(F.lit(n).alias("change"), b.cast("string").alias("before"), a.cast("string").alias("after"))) for n, c, b, a in found]
    return both.select("url", F.inline(F.filter(F.array(*hits), lambda x: x.isNotNull()))).select("change", "url", "before", "after")


def summary(found: DataFrame) -> DataFrame:
    """(change, total, first): counts, and the first addresses in order, of every kind of change.

    Only the first addresses are collected: each kind is cut to FIRST rows before they meet.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("change").orderBy("url")
    first = found.withColumn("k", F.row_number().over(by)).where(F.col("k") <= FIRST).groupBy("change").agg(F.array_sort(F.collect_list("url")).alias("first"))
    kinds = found.sparkSession.createDataFrame([(c,) for c in CHANGES], "change string")
    out = kinds.join(found.groupBy("change").agg(F.count("*").alias("total")), "change", "left").join(first, "change", "left")
    return out.select("change", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"), F.coalesce("first", F.array().cast("array<string>")).alias("first"))


def score_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(category, before, after, change) from two tables of category scores."""
    both = old.select("category", F.col("score").alias("before")).join(new.select("category", F.col("score").alias("after")), "category", "full_outer")
    diff = F.col("after") - F.col("before")
    return both.withColumn("change", F.when(diff < 0, -half_up(-diff, 1)).otherwise(half_up(diff, 1)))


def issue_changes(issues: DataFrame, crawl_id) -> DataFrame:
    """(kind, issue_key): new, resolved and recurring issues of a crawl."""
    crawl = F.lit(crawl_id)
    kind = F.when(F.col("first_crawl") == crawl, "new").when(F.col("resolved_in") == crawl, "resolved").when((F.col("last_crawl") == crawl) & (F.col("recurrence_count") > 0), "recurring")
    return issues.select(kind.alias("kind"), "issue_key").where("kind IS NOT NULL")
