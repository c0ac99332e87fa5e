"""The rules on a small healthy site, one changed field at a time."""

import datetime

import pytest
from pyspark.sql import functions as F

from sitescope.operators import duplicates, lifecycle, linking, reports, rules, schedule, score, search, structured
from sitescope.operators.catalogue import RULES, catalogue
from sitescope.plans.context import Context
from sitescope.plans.settings import ContentType, Settings

ROOT = "https://example.org/"
SCHEMA = """id string, crawl_job_id string, url string, fetch_status string, status_code int, depth int, content_type string, response_time_ms int, title string, title_count int,
meta_description string, meta_description_count int, canonical_url string, canonical_count int, lang string, headings array<struct<level: int, text: string>>, h1_count int, word_count int, content_hash string, text string,
images array<struct<src: string, alt: string, has_alt: boolean>>, images_missing_alt int, redirect_chain array<struct<url: string, status_code: int, elapsed_ms: int>>, is_noindex boolean, in_sitemap boolean, is_orphan boolean,
inlinks_count int, internal_links_count int, external_links_count int, structured_data struct<json_ld: array<struct<valid: boolean, error: string, types: array<string>, data: string>>, microdata: struct<count: int, types: array<string>>>"""
ORG = {"json_ld": [{"valid": True, "error": None, "types": ["Organization"], "data": '{"@type": "Organization", "name": "E", "url": "u", "logo": "l", "address": "a", "contactPoint": "c", "sameAs": "s"}'}], "microdata": {"count": 0, "types": []}}


def page(path, **change):
    name = path.strip("/") or "home"
    words = " ".join(f"{name}{i}" for i in range(300))
    row = {
        "id": path, "crawl_job_id": "c", "url": ROOT + path.lstrip("/"), "fetch_status": "fetched", "status_code": 200, "depth": 0 if path == "/" else 1, "content_type": "text/html", "response_time_ms": 120,
        "title": " ".join(f"{name}{x}" for x in ("one", "two", "three", "four"))[:55] + " overview", "title_count": 1, "meta_description": f"The page at {path} has a description that is long enough to be shown in full by search engines.", "meta_description_count": 1,
        "canonical_url": ROOT + path.lstrip("/"), "canonical_count": 1, "lang": "en", "headings": [{"level": 1, "text": f"Heading {path}"}, {"level": 2, "text": "Details"}, {"level": 2, "text": "More"}], "h1_count": 1, "word_count": 300,
        "content_hash": f"hash{path}", "text": words, "images": [], "images_missing_alt": 0, "redirect_chain": [], "is_noindex": False, "in_sitemap": True, "is_orphan": False, "inlinks_count": 3, "internal_links_count": 3, "external_links_count": 0,
        "structured_data": ORG if path == "/" else {"json_ld": [], "microdata": {"count": 0, "types": []}},
    }
    return row | change


def site(**change):
    """Changes by page: home, about, courses."""
    return [page("/", **change.get("home", {})), page("/about", **change.get("about", {})), page("/courses", **change.get("courses", {}))]


def context(spark, pages, links=(), job=None, settings=None):
    facts = {"id": "c", "finished_at": datetime.datetime(2026, 9, 1), "warnings": [], "robots_status": "found", "sitemaps": [("s", "ok")], "sitemap_url_count": 3} | (job or {})
    j = spark.createDataFrame([facts], "id string, finished_at timestamp, warnings array<string>, robots_status string, sitemaps array<struct<url: string, status: string>>, sitemap_url_count int")
    n = spark.createDataFrame(list(links), "source_id string, target_id string, target_url string, is_internal boolean, nofollow boolean")
    return Context.of(spark.createDataFrame(pages, SCHEMA), n, j, settings or Settings(important_pages=(ROOT + "courses",)))


def found(spark, *args, **kw):
    ctx = context(spark, *args, **kw)
    return {r["rule_id"]: r for r in rules.run_rules(ctx, structured.check_pages(ctx.pages), duplicates.findings(ctx.pages)).collect()}


def test_healthy_site_has_no_findings(spark):
    assert found(spark, site()) == {}


CASES = [
    ("tech.http_client_error", {"about": {"status_code": 404}}, "high"),
    ("tech.http_server_error", {"courses": {"status_code": 503}}, "critical"),
    ("tech.fetch_failed", {"about": {"fetch_status": "too_large", "status_code": None}}, "medium"),
    ("tech.redirect_chain", {"about": {"redirect_chain": [{"url": "a", "status_code": 301, "elapsed_ms": 1}] * 2}}, "medium"),
    ("tech.internal_link_to_redirect", {"about": {"status_code": 301}}, "low"),
    ("tech.sitemap_bad_urls", {"about": {"status_code": 301, "inlinks_count": 0}}, "medium"),
    ("tech.blocked_by_robots", {"about": {"fetch_status": "blocked_by_robots", "status_code": None}}, "high"),
    ("tech.unexpected_noindex", {"courses": {"is_noindex": True}}, "critical"),
    ("tech.canonical_multiple", {"about": {"canonical_count": 2}}, "high"),
    ("tech.canonical_target_problem", {"about": {"canonical_url": "https://away.org/"}}, "informational"),
    ("tech.slow_response", {"about": {"response_time_ms": 3000}}, "high"),
    ("tech.deep_important_page", {"courses": {"depth": 4}}, "medium"),
    ("onpage.title_missing", {"about": {"title": None}}, "high"),
    ("onpage.title_multiple", {"about": {"title_count": 2}}, "medium"),
    ("onpage.title_length", {"about": {"title": "Short"}}, "low"),
    ("onpage.title_duplicate", {"about": {"title": "the SAME title for two pages, long enough"}, "courses": {"title": "The same  title for two pages, long enough"}}, "medium"),
    ("onpage.meta_description_missing", {"about": {"meta_description": ""}}, "medium"),
    ("onpage.meta_description_multiple", {"about": {"meta_description_count": 2}}, "low"),
    ("onpage.meta_description_length", {"about": {"meta_description": "Short"}}, "low"),
    ("onpage.meta_description_duplicate", {k: {"meta_description": "One and the same description of more than seventy characters, on two pages."} for k in ("about", "courses")}, "low"),
    ("onpage.h1_missing", {"about": {"h1_count": 0}}, "medium"),
    ("onpage.h1_multiple", {"about": {"h1_count": 2}}, "low"),
    ("onpage.heading_hierarchy", {"about": {"headings": [{"level": 1, "text": "Heading about"}, {"level": 3, "text": "x"}, {"level": 3, "text": "y"}]}}, "low"),
    ("onpage.canonical_missing", {"about": {"canonical_url": None, "canonical_count": 0}}, "low"),
    ("onpage.url_structure", {"about": {"url": ROOT + "About_us", "canonical_url": ROOT + "About_us"}}, "low"),
    ("onpage.image_alt_missing", {"about": {"images_missing_alt": 5}}, "medium"),
    ("onpage.lang_missing", {"about": {"lang": None}}, "low"),
    ("content.thin", {"about": {"word_count": 99}}, "medium"),
    ("content.duplicate", {"about": {"content_hash": "x", "text": "short"}, "courses": {"content_hash": "x", "text": "short"}}, "medium"),
    ("content.weak_structure", {"about": {"word_count": 400, "headings": [{"level": 1, "text": "Heading about"}]}}, "low"),
    ("content.review_dated_reference", {"about": {"title": "Admissions of the year 2024 and what came"}}, "informational"),
    ("links.orphan", {"about": {"is_orphan": True}}, "medium"),
    ("links.important_few_inlinks", {"courses": {"inlinks_count": 2}}, "medium"),
    ("links.no_internal_outlinks", {"about": {"internal_links_count": 0}}, "low"),
    ("links.excessive", {"about": {"external_links_count": 148}}, "low"),
    ("schema.invalid", {"about": {"structured_data": {"json_ld": [{"valid": False, "error": "Invalid JSON at line 1: x", "types": [], "data": None}], "microdata": {"count": 0, "types": []}}}}, "high"),
    ("schema.recommended_properties", {"about": {"structured_data": {"json_ld": [{"valid": True, "error": None, "types": ["Course"], "data": '{"@type": "Course", "name": "n", "description": "d"}'}], "microdata": {"count": 0, "types": []}}}}, "informational"),
    ("schema.home_organisation_missing", {"home": {"structured_data": {"json_ld": [], "microdata": {"count": 0, "types": []}}}}, "low"),
]


def test_each_case(spark):
    """All cases as sites of their own would take a crawl each; a few are run, the rest through the one-page pass."""
    for rule, change, severity in CASES:
        own = context(spark, site(**change))
        if rule in {"tech.sitemap_bad_urls", "tech.canonical_target_problem", "onpage.title_duplicate", "onpage.meta_description_duplicate", "content.duplicate"} or rule.startswith("schema."):
            make = {"tech.sitemap_bad_urls": rules.sitemap_bad_urls, "tech.canonical_target_problem": rules.canonical_targets, "content.duplicate": rules.same_content, "onpage.title_duplicate": lambda c: rules.shared_text(c, "title", "onpage.title_duplicate", "title"), "onpage.meta_description_duplicate": lambda c: rules.shared_text(c, "meta_description", "onpage.meta_description_duplicate", "description")}
            rows = rules.schema_rules(own, structured.check_pages(own.pages)) if rule.startswith("schema.") else make[rule](own)
        else:
            rows = rules.page_findings(own)
        assert [(r["rule_id"], r["severity"]) for r in rows.collect()] == [(rule, severity)], rule


def test_site_rules(spark):
    got = found(spark, site(), job={"robots_status": "unreachable", "sitemaps": [("a", "ok"), ("b", "error")]})
    assert set(got) == {"tech.robots_unreachable", "tech.sitemap_errors"} and got["tech.robots_unreachable"]["severity"] == "critical"
    assert set(found(spark, site(), job={"robots_status": "not_found", "sitemaps": []})) == {"tech.robots_missing", "tech.sitemap_missing"}


def test_link_rules(spark):
    links = [("/", "/about", ROOT + "about", True, False), ("/courses", "/about", ROOT + "about", True, True), ("/", "/courses", ROOT + "courses", True, False)]
    got = found(spark, site(about={"status_code": 404, "in_sitemap": False}), links)
    assert set(got) == {"tech.http_client_error", "tech.broken_internal_links", "links.nofollow_internal"}


def test_groups_and_types(spark):
    types = (ContentType("course", "Course", ("/courses*",), ("Fees", "Entry"), ("Course",)),)
    base = "word " + " ".join(f"w{i}" for i in range(400))
    change = {"about": {"text": base, "title": "The history of the old library building"}, "courses": {"text": base + " extra", "title": "The history of the old library building!"}}
    got = found(spark, site(**change), settings=Settings(content_types=types))
    assert {"content.missing_sections", "schema.content_type_opportunity", "content.near_duplicate"} <= set(got)
    assert got["content.near_duplicate"]["affected_page_count"] == 2


def test_page_limit_silences_links(spark):
    assert found(spark, site(about={"is_orphan": True}), job={"warnings": ["Stopped at the page limit"]}) == {}


def test_catalogue(spark):
    assert len(RULES) == 50 and catalogue(spark).count() == 50
    covered = {c[0] for c in CASES} | {"tech.robots_unreachable", "tech.robots_missing", "tech.sitemap_missing", "tech.sitemap_errors", "tech.broken_internal_links", "links.nofollow_internal", "content.missing_sections", "schema.content_type_opportunity", "content.near_duplicate"}
    assert set(RULES) - covered == {"tech.http_not_https", "tech.duplicate_url_variants", "content.topic_overlap"}


def test_variants_http_topics(spark):
    own = context(spark, site(about={"url": ROOT + "courses/", "canonical_url": ROOT + "courses/", "content_hash": "hash/courses"}))
    assert rules.url_variants(own).first()["affected_page_count"] == 2
    http = context(spark, site(about={"url": "http://example.org/about"}))
    assert rules.insecure(http).first()["severity"] == "medium"
    words = spark.createDataFrame([("a", ["x", "y", "z", "w", "v"]), ("b", ["x", "y", "z", "w"]), ("c", ["q", "r"])], "k string, words array<string>")
    assert [tuple(r) for r in duplicates.topic_pairs(words).collect()] == [("a", "b", 0.8)]


def scores(spark, pages, **job):
    ctx = context(spark, pages, job=job or None)
    rows = rules.run_rules(ctx)
    by = score.category_scores(rows, score.denominators(ctx.pages))
    return {r["category"]: r["score"] for r in by.collect()}, score.overall(by).first()["overall"]


def test_scores(spark):
    assert scores(spark, site())[1] == 100.0
    got, total = scores(spark, site(), robots_status="unreachable")
    assert got["technical"] == 0.0 and total == 70.0
    ten = [page("/"), *[page(f"/p{i}") for i in range(8)], page("/bad", meta_description=None)]
    assert scores(spark, ten)[0]["on_page"] == 98.0
    none = [page("/", content_type="application/pdf")]
    assert scores(spark, none)[0]["on_page"] is None


def test_crawls_are_judged_apart(spark):
    """Two crawls in one job find what each finds alone: pages that only differ by crawl are no duplicates of each other."""
    bad = site(about={"title": None, "in_sitemap": True, "is_noindex": True}, courses={"content_hash": "hash/"})
    two = [*[p | {"crawl_job_id": "a", "id": f"a{p['id']}"} for p in site()], *[p | {"crawl_job_id": "b", "id": f"b{p['id']}"} for p in bad]]
    links = [("b/", "b/about", ROOT + "about", True, True)]
    ctx = context(spark, two, links, {"id": "a"})
    ctx.job = ctx.job.unionByName(ctx.job.withColumns({"id": F.lit("b"), "robots_status": F.lit("not_found")}))
    rows = rules.run_rules(ctx, structured.check_pages(ctx.pages), duplicates.findings(ctx.pages))
    got = sorted((r["crawl_job_id"], r["rule_id"]) for r in rows.collect())
    alone = {r["rule_id"] for r in rules.run_rules(context(spark, [p | {"id": f"b{p['id']}"} for p in bad], links, {"robots_status": "not_found"})).collect()}
    assert got == [("b", r) for r in sorted(alone)] and {"tech.sitemap_bad_urls", "content.duplicate", "links.nofollow_internal", "tech.robots_missing"} <= alone
    by = score.category_scores(rows, score.denominators(ctx.pages))
    total = {r["crawl_job_id"]: r["overall"] for r in score.overall(by).collect()}
    assert total["a"] == 100.0 > total["b"]


def test_groups_list_their_first_addresses(spark):
    pages = [page(f"/p{i:03}", content_hash="one") for i in range(230)]
    r = rules.same_content(context(spark, pages)).first()
    assert r["affected_page_count"] == 230 and r["affected_urls"] == [ROOT + f"p{i:03}" for i in range(200)]


def test_priority_prefers_severity(spark):
    rows = spark.createDataFrame([("page", 1, "critical", "high", "high"), ("page", 1, "low", "high", "high")], "scope string, affected_page_count int, severity string, effort string, confidence string")
    a, b = (r["priority"] for r in score.priority(rows, F.lit(100), F.col("severity") == "low", F.lit(False)).collect())
    assert a > b


def test_lifecycle(spark):
    t = datetime.datetime(2026, 1, 1)
    base = "issue_key string, scope string, status string, severity string, affected_urls array<string>, affected_page_count int, priority double, first_crawl string, last_crawl string, resolved_in string, first_detected_at timestamp, last_detected_at timestamp, resolved_at timestamp, recurrence_count int"
    old = [(k, s, st, "low", u, 1, 1.0, "c1", "c1", "c1" if st == "resolved" else None, t, t, None, 0) for k, s, st, u in [("again", "page", "open", ["u"]), ("ignored", "page", "ignored", ["u"]), ("back", "page", "resolved", ["u"]), ("gone", "page", "open", ["u"]), ("unseen", "group", "open", ["u", "x"]), ("site", "site", "open", ["r"]), ("done", "page", "resolved", ["u"])]]
    new = spark.createDataFrame([(k, "page", "high", ["u"], 2, 9.0) for k in ("again", "ignored", "back", "new")], "issue_key string, scope string, severity string, affected_urls array<string>, affected_page_count int, priority double")
    out = lifecycle.merge(spark.createDataFrame(old, base), new, spark.createDataFrame([("u",)], "url string"), F.lit("c2"), F.lit(datetime.datetime(2026, 2, 1)))
    got = {r["issue_key"]: (r["status"], r["recurrence_count"], r["last_crawl"], r["resolved_in"]) for r in out.collect()}
    assert got == {"again": ("open", 0, "c2", None), "ignored": ("ignored", 0, "c2", None), "back": ("open", 1, "c2", None), "new": ("open", 0, "c2", None), "gone": ("resolved", 0, "c1", "c2"), "unseen": ("open", 0, "c1", None), "site": ("resolved", 0, "c1", "c2"), "done": ("resolved", 0, "c1", "c1")}
    asked = spark.createDataFrame([("gone", "open"), ("again", "ignored")], "issue_key string, status string")
    assert {r["issue_key"]: r["status"] for r in lifecycle.triage(out, asked).where("issue_key IN ('gone', 'again')").collect()} == {"gone": "resolved", "again": "ignored"}


def test_opportunities(spark):
    rows = [("/", 100, 1000, 2.0), ("/fees", 8, 400, 2.5), ("/admissions", 25, 500, 6.0), ("/news", 3, 300, 8.0), ("/small", 0, 50, 5.0), ("/deep", 2, 2000, 25.0)]
    days = spark.createDataFrame([(p, datetime.date(2026, 1, 1), c, i, x) for p, c, i, x in rows], "page string, day date, clicks long, impressions long, position double")
    got = [(r["page"], r["band"], r["band_ctr"]) for r in search.opportunities(days).collect()]
    assert got == [("/fees", "top_3", round(108 / 1400, 4)), ("/news", "positions_4_10", round(28 / 850, 4))]


def test_suggestions(spark):
    pages = site(about={"text": "Learn of our Evening Courses, and more.", "title": "About", "headings": []}, courses={"headings": [{"level": 1, "text": "evening  courses"}], "inlinks_count": 1})
    ctx = context(spark, pages)
    got = [(r["source_url"], r["target_url"], r["anchor_text"]) for r in linking.suggest(ctx.pages, ctx.links, ROOT).collect()]
    assert got == [(ROOT + "about", ROOT + "courses", "Evening Courses")]
    linked = context(spark, pages, [("/about", "/courses", ROOT + "courses", True, False)])
    assert linking.suggest(linked.pages, linked.links, ROOT).count() == 0


def test_schedule(spark):
    row = spark.createDataFrame([(datetime.datetime(2026, 1, 31, 9, 30),)], "t timestamp")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    zone, hour = F.lit("Asia/Karachi"), F.lit(6)
    got = row.select(at(schedule.first_run(F.col("t"), hour, zone)), at(schedule.following_run(F.col("t"), F.lit(datetime.datetime(2026, 2, 1)), "monthly", hour, zone)), at(schedule.following_run(F.col("t"), F.lit(datetime.datetime(2026, 3, 3)), "weekly", hour, zone))).first()
    assert tuple(got) == ("2026-02-01 01:00", "2026-02-28 01:00", "2026-03-07 01:00")


def test_letters(spark):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in (0, 25, 26, 701, 702)], "n int").select(reports.letters(F.col("n"))).collect()]
    assert got == ["a", "z", "aa", "zz", "aaa"]


def test_report_html(spark):
    page_ = reports.render("A & B", ["One <b>"], {"Top": spark.createDataFrame([(1, "<x>")], "n int, t string")})
    assert "A &amp; B" in page_ and "&lt;x&gt;" in page_


@pytest.mark.parametrize(("text_", "want"), [("In 1,200 cases (1.50) or v2", ["1.5", "1200"]), ("1. first\n2) second 7", ["7"]), ("123e4567-e89b-12d3-a456-426614174000 3.0", ["3"])])
def test_numbers(spark, text_, want):
    from sitescope.operators import answers

    assert spark.createDataFrame([(text_,)], "t string").select(answers.numbers(F.col("t"))).first()[0] == want
