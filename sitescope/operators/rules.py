"""The audit rules as DataFrame operators.

All rules that look at one page by itself are evaluated together, in one pass over the pages: each is a condition, a
severity and its evidence, and a page yields the array of those that hold. Rules over groups of pages aggregate; rules over
links join; rules over the crawl read its row of facts. Every rule is keyed by crawl_job_id, so that one job judges any number
of crawls of a site; findings of groups show their first addresses and count them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..plans.context import Context, failed, page_group, page_limit_reached
from ..plans.settings import FAILED_FETCHES
from .catalogue import ORDER, RULES
from .structured import ORGANISATIONS

FINDING = ["crawl_job_id", "rule_id", "severity", "scope", "subject", "affected_urls", "affected_page_count", "evidence"]
MAX_STORED = 200


def json(**fields) -> Column:
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def _c(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def page_rules(ctx: Context) -> list[tuple[str, Column, Column | str, Column]]:
    """(rule, condition, severity, evidence) of the rules that need one page and the job's facts ``limited``."""
    s = ctx.settings
    an, ix, imp = F.col("analysable"), F.col("indexable"), F.col("important")
    not_root = F.col("url") != s.root_url
    title, about, n = text.present(F.col("title")), text.present(F.col("meta_description")), F.length
    raised = lambda high, low: F.when(imp, F.lit(high)).otherwise(F.lit(low))
    status, links = F.col("status_code"), _c("internal_links_count") + _c("external_links_count")
    blocked = (F.col("fetch_status") == "blocked_by_robots") & (F.coalesce("in_sitemap", F.lit(False)) | (_c("inlinks_count") > 0) | imp)
    jumps = text.heading_jumps(F.col("headings"))
    named = F.concat_ws(" ", F.col("title"), text.first_h1(F.col("headings")))
    years = text.old_years(named, F.col("crawl_year") - 1)
    subs = F.size(F.filter("headings", lambda h: h["level"] >= 2))
    url_problems = urls.problems(F.col("url"), s.max_url)
    noimg = F.slice(F.transform(F.filter("images", lambda i: ~i["has_alt"]), lambda i: i["src"]), 1, 20)
    return [
        ("tech.http_client_error", status.between(400, 499), raised("critical", "high"), json(status_code=status)),
        ("tech.http_server_error", status >= 500, raised("critical", "high"), json(status_code=status)),
        ("tech.fetch_failed", F.col("fetch_status").isin(*FAILED_FETCHES), raised("high", "medium"), json(fetch_status=F.col("fetch_status"))),
        ("tech.redirect_chain", F.size("redirect_chain") >= 2, "medium", json(hops=F.size("redirect_chain"))),
        ("tech.internal_link_to_redirect", F.col("redirected") & (_c("inlinks_count") > 0), "low", json(inlinks=F.col("inlinks_count"))),
        ("tech.blocked_by_robots", blocked, F.when(imp | F.coalesce("in_sitemap", F.lit(False)), "high").otherwise("low"), json(in_sitemap=F.col("in_sitemap"))),
        ("tech.unexpected_noindex", an & F.coalesce("is_noindex", F.lit(False)) & (F.coalesce("in_sitemap", F.lit(False)) | imp), raised("critical", "high"), json(in_sitemap=F.col("in_sitemap"))),
        ("tech.canonical_multiple", an & (_c("canonical_count") > 1), "high", json(canonical_count=F.col("canonical_count"))),
        ("tech.slow_response", (_c("response_time_ms") >= s.slow_ms) & ~F.col("redirected"), F.when(F.col("response_time_ms") >= s.very_slow_ms, "high").otherwise("medium"), json(response_time_ms=F.col("response_time_ms"))),
        ("tech.deep_important_page", an & imp & not_root & (F.col("depth").isNull() | (F.col("depth") > s.max_depth)), "medium", json(depth=F.col("depth"))),
        ("onpage.title_missing", an & ~title, raised("critical", "high"), json(title=F.col("title"))),
        ("onpage.title_multiple", an & (_c("title_count") > 1), "medium", json(title_count=F.col("title_count"))),
        ("onpage.title_length", an & title & ~n("title").between(*s.title), "low", json(length=n("title"))),
        ("onpage.meta_description_missing", ix & ~about, "medium", json(meta_description=F.col("meta_description"))),
        ("onpage.meta_description_multiple", an & (_c("meta_description_count") > 1), "low", json(count=F.col("meta_description_count"))),
        ("onpage.meta_description_length", ix & about & ~n("meta_description").between(*s.description), "low", json(length=n("meta_description"))),
        ("onpage.h1_missing", an & (_c("h1_count") == 0), "medium", json(h1_count=_c("h1_count"))),
        ("onpage.h1_multiple", an & (_c("h1_count") > 1), "low", json(h1_count=F.col("h1_count"))),
        ("onpage.heading_hierarchy", an & (F.size(jumps) > 0), "low", json(jumps=jumps)),
        ("onpage.canonical_missing", ix & (_c("canonical_count") == 0), "low", json(canonical_count=_c("canonical_count"))),
        ("onpage.url_structure", ix & (F.size(url_problems) > 0), "low", json(problems=url_problems)),
        ("onpage.image_alt_missing", an & (_c("images_missing_alt") > 0), F.when(F.col("images_missing_alt") >= 5, "medium").otherwise("low"), json(images_without_alt=F.col("images_missing_alt"), examples=noimg)),
        ("onpage.lang_missing", an & ~text.present(F.col("lang")), "low", json(lang=F.col("lang"))),
        ("content.thin", ix & (_c("word_count") < s.thin_words), F.when(_c("word_count") < s.thin_words / 2, "medium").otherwise("low"), json(word_count=_c("word_count"))),
        ("content.weak_structure", ix & (_c("word_count") >= 400) & (subs < 2), "low", json(word_count=F.col("word_count"), subheadings=subs)),
        ("content.review_dated_reference", ix & (F.size(years) > 0), "informational", json(years=years)),
        ("links.orphan", F.coalesce("is_orphan", F.lit(False)) & ~F.col("limited"), raised("high", "medium"), json(in_sitemap=F.col("in_sitemap"))),
        ("links.important_few_inlinks", an & imp & not_root & (_c("inlinks_count") < s.min_inlinks) & ~F.col("limited"), "medium", json(inlinks=_c("inlinks_count"))),
        ("links.no_internal_outlinks", an & (_c("internal_links_count") == 0), "low", json(internal_links=_c("internal_links_count"))),
        ("links.excessive", an & (links > s.max_links), "low", json(links=links)),
    ]


def page_findings(ctx: Context, only: set[str] | None = None) -> DataFrame:
    """Findings of the one-page rules, in one pass."""
    rows = ctx.beside_job(ctx.pages, page_limit_reached().alias("limited"), F.year("finished_at").alias("crawl_year")).fillna({"limited": False})
    hits = []
    for rule, holds, severity, evidence in page_rules(ctx):
        if only is None or rule in only:
            found = F.struct(F.lit(rule).alias("rule_id"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), evidence.alias("evidence"))
            hits.append(F.when(F.coalesce(holds, F.lit(False)), found))
    rows = rows.select("crawl_job_id", "url", F.inline(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    return _pages(rows)


def _pages(rows: DataFrame, subject: Column | None = None) -> DataFrame:
    """Findings of scope page from (crawl_job_id, url, rule_id, severity, evidence)."""
    subject = urls.group_subject(F.col("url")) if subject is None else subject
    return rows.select("crawl_job_id", "rule_id", "severity", F.lit("page").alias("scope"), subject.alias("subject"), F.array("url").alias("affected_urls"), F.lit(1).alias("affected_page_count"), "evidence")


def group_findings(rows: DataFrame, rule: str, subject: Column, evidence: Column, severity: str | None = None) -> DataFrame:
    """Findings of scope group from rows of ``grouped``."""
    return rows.select("crawl_job_id", F.lit(rule).alias("rule_id"), F.lit(severity or RULES[rule].severity).alias("severity"), F.lit("group").alias("scope"), subject.alias("subject"), F.col("urls").alias("affected_urls"), F.col("n").alias("affected_page_count"), evidence.alias("evidence"))


def grouped(rows: DataFrame, keys: list[str], extra: Column | None = None, least: int = 1) -> DataFrame:
    """keys, ``n`` distinct addresses (``least`` or more), ``low`` and ``high`` of ``extra``, and the ``first`` MAX_STORED (url, extra).

    Only the first addresses come together in a row: ranks are limited before the shuffle, and all are only counted.
    """
    rows = rows.select(*keys, "url", (F.lit(None).cast("string") if extra is None else extra).alias("extra"))
    each = rows.groupBy(*keys, "url").agg(F.min("extra").alias("extra"))
    counts = each.groupBy(*keys).agg(F.count("*").cast("int").alias("n"), F.min("extra").alias("low"), F.max("extra").alias("high")).where(F.col("n") >= least)
    ranked = each.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("url"))).where(F.col("r") <= MAX_STORED)
    first = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("url", "extra"))).alias("first"))
    return counts.join(first, keys).withColumn("urls", F.transform("first", lambda x: x["url"]))


def digests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``subject``: equal for equal sets of addresses. A hash of the hashes of 4,096 parts, no part is a whole group."""
    part = F.substring(F.md5("url"), 1, 3).alias("part")
    each = rows.groupBy(*keys, part).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("url")), "\x1f"), 256).alias("hash"))
    return each.groupBy(*keys).agg(F.left(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "hash"))), lambda x: x["hash"]), "\x1f"), 256), F.lit(16)).alias("subject"))


def _site(ctx: Context, rows: DataFrame) -> DataFrame:
    """Findings of scope site from (crawl_job_id, rule, sev, ev)."""
    pages = ctx.pages.groupBy("crawl_job_id").agg(F.count("*").cast("int").alias("pages"))
    count = F.greatest(F.coalesce("pages", F.lit(0)), F.lit(1)).alias("affected_page_count")
    return rows.join(pages, "crawl_job_id", "left").select("crawl_job_id", F.col("rule").alias("rule_id"), F.col("sev").alias("severity"), F.lit("site").alias("scope"), F.lit("site").alias("subject"), F.array(F.lit(ctx.settings.root_url)).alias("affected_urls"), count, F.col("ev").alias("evidence"))


def insecure(ctx: Context) -> DataFrame:
    """The site itself is plain http: one finding for the site; else one for the crawled http pages."""
    rule = "tech.http_not_https"
    if urls_scheme(ctx.settings.root_url) == "http":
        return _site(ctx, ctx.job.select(F.col("id").alias("crawl_job_id"), F.lit(rule).alias("rule"), F.lit("high").alias("sev"), json(root=ctx.settings.root_url).alias("ev")))
    rows = grouped(ctx.pages.where(F.startswith("url", F.lit("http://")) & F.col("status_code").isNotNull()), ["crawl_job_id"])
    return group_findings(rows, rule, urls.group_subject(F.lit("http")), json(pages=F.col("n")), "medium")


def urls_scheme(url: str) -> str:
    return url.split(":", 1)[0].lower()


def broken_links(ctx: Context) -> DataFrame:
    """Pages with internal links to pages that fail."""
    bad = ctx.pages.where(failed()).select(F.col("id").alias("target_id"), F.col("url").alias("broken"), "status_code")
    links = ctx.links.where("is_internal AND target_id IS NOT NULL").select("source_id", "target_id").distinct()
    hits = links.join(bad, "target_id").groupBy("source_id").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("broken")), 1, 50).alias("broken"))
    rows = ctx.pages.select("crawl_job_id", F.col("id").alias("source_id"), "url").join(hits, "source_id")
    return _pages(rows.select("crawl_job_id", "url", F.lit("tech.broken_internal_links").alias("rule_id"), F.lit("medium").alias("severity"), json(count=F.col("n"), links=F.col("broken")).alias("evidence")))


def job_rules(ctx: Context) -> DataFrame:
    """Sitemap and robots findings from the crawl's facts."""
    ok = F.exists("sitemaps", lambda x: x["status"] == "ok")
    bad = F.exists("sitemaps", lambda x: x["status"] == "error")
    none = (~F.coalesce(ok, F.lit(False))) | (F.coalesce("sitemap_url_count", F.lit(0)) == 0)
    checks = [
        ("tech.sitemap_missing", none, json(sitemap_urls=F.col("sitemap_url_count"))),
        ("tech.sitemap_errors", F.coalesce(ok & bad, F.lit(False)), json(failed=F.transform(F.filter("sitemaps", lambda x: x["status"] == "error"), lambda x: x["url"]))),
        ("tech.robots_unreachable", F.col("robots_status") == "unreachable", json(robots_status=F.col("robots_status"))),
        ("tech.robots_missing", F.col("robots_status") == "not_found", json(robots_status=F.col("robots_status"))),
    ]
    hits = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(RULES[r].severity).alias("sev"), e.alias("ev"))) for r, c, e in checks]
    rows = ctx.job.select(F.col("id").alias("crawl_job_id"), F.inline(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    return _site(ctx, rows)


def sitemap_bad_urls(ctx: Context) -> DataFrame:
    """One finding of a crawl for all sitemap pages that should not be there, with a reason of each of the first."""
    reason = F.when(F.col("status_code") >= 400, "error").when(F.col("redirected"), "redirect").when(F.col("analysable") & F.coalesce("is_noindex", F.lit(False)), "noindex").when(F.col("analysable") & F.col("elsewhere"), "canonicalised elsewhere")
    bad = ctx.pages.where("in_sitemap").select("crawl_job_id", "url", reason.alias("reason")).where("reason IS NOT NULL")
    rows = grouped(bad, ["crawl_job_id"], F.col("reason")).join(digests(bad, ["crawl_job_id"]), "crawl_job_id")
    shown = F.transform(F.slice("first", 1, 50), lambda x: F.struct(x["url"].alias("url"), x["extra"].alias("reason")))
    return group_findings(rows, "tech.sitemap_bad_urls", F.col("subject"), json(pages=shown))


def canonical_targets(ctx: Context) -> DataFrame:
    """Pages whose canonical address is another page with a problem, or lies on another domain."""
    t = ctx.pages.select("crawl_job_id", F.col("url").alias("canonical_url"), F.lit(True).alias("known"), F.col("status_code").alias("t_status"), F.col("redirected").alias("t_redirected"), F.col("fetch_status").alias("t_fetch"), (F.col("analysable") & F.coalesce("is_noindex", F.lit(False))).alias("t_noindex"))
    rows = ctx.pages.where("analysable AND elsewhere").join(t, ["crawl_job_id", "canonical_url"], "left")
    away = F.col("known").isNull() & ~urls.host(F.col("canonical_url")).isin(list(ctx.settings.allowed_hosts))
    problem = F.when(away, "another domain").when(F.col("t_status") >= 400, "error").when(F.col("t_redirected"), "redirect").when(F.col("t_fetch") == "blocked_by_robots", "blocked").when(F.col("t_noindex"), "noindex")
    rows = rows.withColumn("problem", problem).where("problem IS NOT NULL")
    return _pages(rows.select("crawl_job_id", "url", F.lit("tech.canonical_target_problem").alias("rule_id"), F.when(F.col("problem") == "another domain", "informational").otherwise("high").alias("severity"), json(canonical=F.col("canonical_url"), problem=F.col("problem")).alias("evidence")))


def url_variants(ctx: Context) -> DataFrame:
    rows = ctx.pages.where("indexable AND content_hash IS NOT NULL").withColumn("key", urls.variant_key(F.col("url")))
    rows = grouped(rows, ["crawl_job_id", "key", "content_hash"], least=2)
    return group_findings(rows, "tech.duplicate_url_variants", urls.group_subject(F.col("key")), json(key=F.col("key")))


def shared_text(ctx: Context, column: str, rule: str, name: str) -> DataFrame:
    """Pages with one title or description, alike but for case and spaces."""
    value = text.normalised(F.col(column))
    rows = ctx.pages.where("indexable").select("crawl_job_id", "url", column, value.alias("value")).where("value <> ''")
    rows = grouped(rows, ["crawl_job_id", "value"], F.col(column), least=2)
    return group_findings(rows, rule, urls.group_subject(F.lit(name), F.col("value")), json(**{name: F.col("first")[0]["extra"]}))


def same_content(ctx: Context) -> DataFrame:
    rows = ctx.pages.where("indexable AND content_hash IS NOT NULL AND word_count > 0")
    rows = grouped(rows, ["crawl_job_id", "content_hash"], urls.variant_key(F.col("url")), least=2).where("low <> high")
    return group_findings(rows, "content.duplicate", urls.group_subject(F.lit("content"), F.col("content_hash")), json(pages=F.col("n")))


def missing_sections(ctx: Context) -> DataFrame:
    found = []
    joined = F.lower(F.array_join(F.transform("headings", lambda h: F.coalesce(h["text"], F.lit(""))), " \n "))
    for t in ctx.settings.content_types:
        if t.expected_sections:
            missing = F.filter(F.array(*[F.lit(x) for x in t.expected_sections]), lambda x: ~F.contains(joined, F.lower(x)))
            found.append(ctx.pages.where("analysable").where(urls.matches_any(urls.path(F.col("url")), t.patterns)).select("crawl_job_id", "url", F.lit(t.key).alias("key"), missing.alias("missing")).where(F.size("missing") > 0))
    if not found:
        return page_findings(ctx, {"onpage.lang_missing"}).limit(0)
    rows = reduce(DataFrame.unionByName, found)
    rows = rows.select("crawl_job_id", "url", "key", F.lit("content.missing_sections").alias("rule_id"), F.lit("low").alias("severity"), json(content_type=F.col("key"), missing_sections=F.col("missing")).alias("evidence"))
    return _pages(rows, urls.group_subject(F.col("url"), F.col("key")))


def nofollow(ctx: Context) -> DataFrame:
    targets = ctx.links.where("is_internal AND nofollow").groupBy("source_id").agg(F.array_sort(F.collect_set("target_url")).alias("t"))
    rows = ctx.pages.where("analysable").join(targets, F.col("id") == F.col("source_id"))
    return _pages(rows.select("crawl_job_id", "url", F.lit("links.nofollow_internal").alias("rule_id"), F.lit("low").alias("severity"), json(count=F.size("t"), targets=F.slice("t", 1, 30)).alias("evidence")))


def schema_rules(ctx: Context, checks: DataFrame) -> DataFrame:
    """Structured-data findings from ``checks`` (crawl_job_id, url, format, types, valid, errors, warnings); without crawl_job_id they hold for every crawl."""
    key = ["crawl_job_id", "url"]
    pages = ctx.pages.where("analysable").select(*key)
    own = checks.join(pages.distinct(), [k for k in key if k in checks.columns]).groupBy(*key).agg(F.flatten(F.collect_list("errors")).alias("errors"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("format") == "json_ld", F.col("warnings")))))).alias("warnings"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"))
    hints = F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.contains(w, F.lit("recommended")))
    invalid = F.exists("errors", lambda e: F.startswith(e, F.lit("Invalid JSON")))
    bad = own.where(F.size("errors") > 0).select(*key, F.lit("schema.invalid").alias("rule_id"), F.when(invalid, "high").otherwise("medium").alias("severity"), json(errors=F.slice("errors", 1, 20)).alias("evidence"))
    more = own.where(F.size(hints) > 0).select(*key, F.lit("schema.recommended_properties").alias("rule_id"), F.lit("informational").alias("severity"), json(suggestions=F.slice(hints, 1, 20)).alias("evidence"))
    home = pages.where(F.col("url") == ctx.settings.root_url).join(own.select(*key, "types"), key, "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
    home = home.where(~F.arrays_overlap("types", F.array(*[F.lit(x) for x in ORGANISATIONS])))
    home = home.select(*key, F.lit("schema.home_organisation_missing").alias("rule_id"), F.lit("low").alias("severity"), json(types_found=F.col("types")).alias("evidence"))
    out = _pages(bad.unionByName(more).unionByName(home))
    for t in ctx.settings.content_types:
        if t.schema_types:
            rows = ctx.pages.where("indexable").where(urls.matches_any(urls.path(F.col("url")), t.patterns)).select(*key).join(own.select(*key, "types"), key, "left")
            rows = rows.where(~F.coalesce(F.arrays_overlap("types", F.array(*[F.lit(x) for x in t.schema_types])), F.lit(False)))
            out = out.unionByName(group_findings(grouped(rows, ["crawl_job_id"]), "schema.content_type_opportunity", urls.group_subject(F.lit("schema-type"), F.lit(t.key)), json(content_type=t.label)))
    return out


def with_metadata(findings: DataFrame) -> DataFrame:
    """Adds catalogue columns, the issue key, the page of page findings and the rule's order. The catalogue has fifty rows."""
    spark = findings.sparkSession
    rows = [(r.id, r.category, r.confidence, r.effort, r.auto_fix, r.title, r.advice, ORDER[r.id]) for r in RULES.values()]
    dim = spark.createDataFrame(rows, "rule_id string, category string, confidence string, effort string, auto_fix_eligible boolean, title string, recommendation string, rule_order int")
    out = findings.join(F.broadcast(dim), "rule_id").withColumn("subject", F.left("subject", F.lit(120)))
    key = F.left(F.concat_ws(":", "rule_id", "subject"), F.lit(200))
    return out.withColumn("issue_key", key).withColumn("primary_url", F.when(F.col("scope") == "page", F.col("affected_urls")[0]))


def first_of_key(findings: DataFrame) -> DataFrame:
    """One finding of each issue key of a crawl: the first by rule order, then by its first URL."""
    by = Window.partitionBy("crawl_job_id", "issue_key").orderBy("rule_order", F.element_at("affected_urls", 1), "severity")
    return findings.withColumn("n", F.row_number().over(by)).where("n = 1").drop("n")


def run_rules(ctx: Context, checks: DataFrame | None = None, similar: DataFrame | None = None) -> DataFrame:
    """All findings of all crawls. ``checks``: structured-data checks; ``similar``: near-duplicate and topic findings."""
    parts = [page_findings(ctx), insecure(ctx), broken_links(ctx), job_rules(ctx), sitemap_bad_urls(ctx), canonical_targets(ctx), url_variants(ctx)]
    parts += [shared_text(ctx, "title", "onpage.title_duplicate", "title"), shared_text(ctx, "meta_description", "onpage.meta_description_duplicate", "description"), same_content(ctx), missing_sections(ctx), nofollow(ctx)]
    parts += [schema_rules(ctx, checks)] if checks is not None else []
    parts += [similar] if similar is not None else []
    return first_of_key(with_metadata(reduce(DataFrame.unionByName, parts)))


def problems_of(findings: DataFrame) -> DataFrame:
    """Findings that break the contract: no evidence, no URL, no page, or an empty name."""
    return findings.where((F.coalesce("evidence", F.lit("{}")) == "{}") | (F.size("affected_urls") < 1) | (F.col("affected_page_count") < 1) | (F.length("subject") < 1))


def groups_named(settings, findings: DataFrame) -> DataFrame:
    return findings.withColumn("group", page_group(settings, "primary_url"))
