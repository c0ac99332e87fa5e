import datetime

import pytest
from pyspark.sql import functions as F

from sitescope.functions.sites import all_public, ipv4_first, public_ip, site_root
from sitescope.operators import answers, history, tools


@pytest.mark.parametrize(("raw", "want"), [("Example.com/path", "https://example.com/"), ("http://www.a-b.org:8080/x?y", "http://www.a-b.org:8080/"), ("localhost", None), ("https://10.0.0.1/", None), ("https://8.8.8.8/", "https://8.8.8.8/"), ("https://printer.local/", None), ("ftp://a.org", None), (None, None)])
def test_site_root(raw, want):
    assert site_root(raw) == want


def test_addresses(spark):
    assert public_ip("8.8.8.8") and not public_ip("::1") and not public_ip("::ffff:10.0.0.1") and not public_ip("x")
    df = spark.createDataFrame([(["8.8.8.8", "2001:4860:4860::8888"],), (["8.8.8.8", "127.0.0.1"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(all_public("a")).collect()] == [True, False, False]
    assert df.select(ipv4_first(F.array(F.lit("::1"), F.lit("1.1.1.1")))).first()[0] == ["1.1.1.1", "::1"]


@pytest.fixture(scope="module")
def project(spark):
    url = "https://example.org/a"
    pages = spark.createDataFrame([("p1", url, 200, "A", None, None, "en", 9, 1, [(1, "Head"), (2, "Sub")], "text"), ("p2", url + "b", 200, "B", None, None, "en", 9, 0, [], "text")], "id string, url string, status_code int, title string, meta_description string, canonical_url string, lang string, word_count int, inlinks_count int, headings array<struct<level: int, text: string>>, text string")
    links = spark.createDataFrame([("p2", "p1", url, "to a")], "source_id string, target_id string, target_url string, anchor_text string")
    issues = spark.createDataFrame([("k1", "onpage.title_length", "open", "high", "on_page", 50.0, [url]), ("k2", "tech.slow_response", "open", "low", "technical", 9.0, [url]), ("k3", "onpage.h1_missing", "resolved", "low", "on_page", 99.0, [url])], "issue_key string, rule_id string, status string, severity string, category string, priority double, affected_urls array<string>")
    checks = spark.createDataFrame([(url, "json_ld", ["Course"], False, ["e"] * 7, [])], "url string, format string, types array<string>, valid boolean, errors array<string>, warnings array<string>")
    more = spark.createDataFrame([(url + "b", url, "a")], "source_url string, target_url string, anchor_text string")
    day = datetime.date(2026, 1, 1)
    days = spark.createDataFrame([(url, day, 1, 500, 2.0), (url + "b", day, 50, 500, 2.5)], "page string, day date, clicks long, impressions long, position double")
    queries = spark.createDataFrame([("fees", 3, 9, 1.0)], "query string, clicks long, impressions long, position double")
    crawls = spark.createDataFrame([("c1", day, "completed")], "id string, created_at date, status string")
    return tools.Project(pages, links, issues, checks, more, days, queries, crawls)


def test_tools(project):
    url = "https://example.org/a"
    got = tools.run(project, "get_project_summary").first()
    assert (got["open"], got["high"], got["pages"], got["crawl"]) == (2, 1, 2, "c1")
    assert [r["issue_key"] for r in tools.run(project, "get_seo_issues", limit=1).collect()] == ["k1"]
    assert tools.run(project, "get_page_details", url=url).first()["issues"] == ["k1", "k2"]
    assert sorted((r["kind"], r["url"]) for r in tools.run(project, "get_internal_links", url=url).collect()) == [("inbound", url + "b"), ("suggested", url + "b")]
    assert len(tools.run(project, "get_schema_findings").first()["errors"]) == 5
    assert tools.run(project, "get_rule", rule_id="content.thin").count() == 1
    found = tools.run(project, "get_search_performance").first()
    assert found["ctr_percent"] == 5.1 and [o["page"] for o in found["opportunities"]] == [url]
    with pytest.raises(KeyError):
        tools.run(project, "drop_tables")
    with pytest.raises(TypeError):
        tools.run(project, "get_rule", name="x")
    with pytest.raises(ValueError):
        tools.run(project, "compare_latest_crawls")


def test_evidence(spark, project):
    asked = spark.createDataFrame([(1, "Which titles are too long?"), (2, "Is the site slow?"), (3, "hello")], "question_id int, question string")
    assert sorted((r["question_id"], r["issue_key"]) for r in tools.evidence_for(asked, project.issues).collect()) == [(1, "k1"), (2, "k2")]


@pytest.mark.parametrize(
    ("question", "topics", "missing", "page"),
    [
        ("Are there broken links on https://example.org/x/.", ["broken links and error pages", "indexing, robots.txt and sitemaps"], [], "https://example.org/x/"),
        ("How much traffic does /fees get?", [], ["visitor numbers and traffic"], "/fees"),
        ("titles, meta, headings, images", ["titles", "meta descriptions", "headings"], [], None),
    ],
)
def test_questions(spark, question, topics, missing, page):
    q = F.lit(question)
    row = spark.range(1).select(answers.topics(q), answers.missing_data(q), answers.page_named(q)).first()
    assert tuple(row) == (topics, missing, page)


def test_answers(spark):
    df = spark.createDataFrame([("We guarantee rank 1 with 80 clicks.", "80 clicks")], "answer string, evidence string")
    got = answers.unsupported(df).first()
    assert got["numbers"] == ["1"] and got["claims"] == ["promises a guaranteed outcome", "states a ranking position", "states traffic or backlink figures"]
    row = spark.range(1).select(answers.protected(F.lit("Fee: $50 in 2025"), F.lit("Tuition fees: $60 in 2025")).alias("p")).first()["p"]
    assert (row["added"], row["removed"], row["mentions"]) == (["$60"], ["$50"], ["fees", "tuition"])
    admitted = answers.admit(F.lit("Fix titles."), F.array(F.lit("backlinks")))
    assert spark.range(1).select(admitted).first()[0] == "This platform has no data on backlinks. Fix titles."


def test_duplicate_groups_list_all_addresses(spark):
    """A group of more than 200 pages is listed whole, unless a number is asked for."""
    rows = spark.range(450).selectExpr("IF(id = 7, NULL, concat('h', id % 2)) AS content_hash", "format_string('u%03d', id) AS url")
    want = {h: [f"u{i:03}" for i in range(h == "h1", 450, 2) if i != 7] for h in ("h0", "h1")}
    found = lambda **a: {r["content_hash"]: r["urls"] for r in history.duplicate_groups(rows, **a).collect()}
    assert found() == want and found(stored=200) == {h: x[:200] for h, x in want.items()}


def test_protected_words_in_one_pass(spark):
    """Words beside each other, in any case, as parts of others, and their fixed starts."""
    cases = [("Tuition FEES, fee-fee; feesible unranked", ["fee", "fees", "tuition"]), ("feeſ and elıgİble", ["eligible", "fees"]), ("admission requirements entry requirement last date", ["admission requirements", "entry requirement", "last date"]), ("é_fee stipend\u00e9 Refund", ["refund"]), ("", []), (None, [])]
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    old = F.filter(F.array(*[F.when(F.col("t").rlike(answers.whole_word(w)), F.lit(w)) for w in sorted(answers.FACT_WORDS)]), lambda x: x.isNotNull())
    got = [tuple(r) for r in rows.select("k", answers.protected(F.lit(""), F.col("t"))["mentions"], old).orderBy("k").collect()]
    assert got == [(k, w, w) for k, (_, w) in enumerate(cases)]
    assert len(answers.FACT_STARTS) == len(answers.FACTS)
    one = spark.range(1).select(answers.facts(F.lit("RS 5,000 Usd3 £7 12.5 Per Cent 1/2/25 2026-01-02 5TH May June 3 1999 2001x CGPA Mark")).alias("f")).first()["f"]
    assert one == sorted(["rs 5,000", "usd3", "£7", "12.5 per cent", "1/2/25", "2026-01-02", "5th may", "june 3", "2026", "1999", "cgpa", "mark"])
