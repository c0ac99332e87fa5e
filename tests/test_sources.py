import gzip

import pytest
from pyspark.sql import functions as F

from sitescope.functions.urls import glob_regex, normalise
from sitescope.sources import html, landing, robots, sitemaps

PAGE = """<!doctype html><html lang="en-GB"><head><title> Fees &amp; dates </title><title>Two</title>
<meta name="description" content="About  fees"><meta name="robots" content="NOINDEX, follow"><link rel="canonical" href="/fees">
<link rel="alternate" hreflang="de" href="/de"><base href="https://example.org/dir/"></head>
<body itemscope itemtype="https://schema.org/WebPage"><h1>Fees</h1><h3>When</h3><p>Ten words<script>var x = "</p>";</script> here</p>
<a href="next?b=2#top" rel="nofollow">Next <b>page</b></a><a href="mailto:x@y.z">mail</a><a href="/img"><img src="i.png" alt="Picture"></a><img src="j.png">
<script type="application/ld+json">{"@graph": [{"@type": ["Event", "Thing"]}]}</script><script type="application/ld+json">{oops</script></body></html>"""


def test_page_facts():
    f = html.page_facts(PAGE, "https://example.org/admissions/")
    assert (f["title"], f["title_count"], f["lang"]) == ("Fees & dates", 2, "en-GB")
    assert f["hreflang"] == [{"hreflang": "de", "href": "https://example.org/de"}]
    assert (f["meta_description"], f["meta_robots"], f["canonical_url"]) == ("About fees", "NOINDEX, follow", "https://example.org/fees")
    assert [(h["level"], h["text"]) for h in f["headings"]] == [(1, "Fees"), (3, "When")]
    assert (f["image_count"], f["images_missing_alt"]) == (2, 1)
    assert [(x["url"], x["anchor_text"], x["nofollow"]) for x in f["links"]] == [("https://example.org/dir/next?b=2", "Next page", True), ("https://example.org/img", "Picture", False)]
    valid, broken = f["structured_data"]["json_ld"]
    assert valid["valid"] and valid["types"] == ["Event", "Thing"]
    assert not broken["valid"] and broken["error"].startswith("Invalid JSON at line 1")
    assert f["structured_data"]["microdata"] == {"count": 1, "types": ["https://schema.org/WebPage"]}
    assert "var x" not in f["text"] and f["text"].startswith("Fees When Ten words here")


def test_page_facts_of_nothing():
    f = html.page_facts(None, None)
    assert f["title"] is None and f["word_count"] == 0 and f["content_hash"] is None


def test_content_hash_ignores_case_and_spaces():
    a, b = (html.page_facts(f"<body>{t}</body>", "https://e.org/")["content_hash"] for t in ("Some  Text", "some text\n"))
    assert a == b


@pytest.mark.parametrize(
    ("raw", "base", "want"),
    [
        ("HTTP://Example.ORG:80/a/../b?x=1#f", None, "http://example.org/b?x=1"),
        ("https://example.org:8443", None, "https://example.org:8443/"),
        ("//other.org/x", "https://example.org/", "https://other.org/x"),
        ("page", "https://example.org/a/b", "https://example.org/a/page"),
        ("https://münchen.de/", None, "https://xn--mnchen-3ya.de/"),
        ("mailto:a@b.c", "https://example.org/", None),
        ("javascript:void(0)", "https://example.org/", None),
        ("https://user:pw@example.org/", None, None),
        ("http://", "https://example.org/", None),
        ("https://example.org:99999/", None, None),
        ("", "https://example.org/", None),
        ("https://example.org/" + "x" * 2100, None, None),
    ],
)
def test_normalise(raw, base, want):
    assert normalise(raw, base) == want


def test_globs():
    import re

    assert re.match(glob_regex("/courses/*"), "/courses/a/b") and not re.match(glob_regex("/courses/*"), "/Courses/a")
    assert re.match(glob_regex("/[ab]?.html"), "/bx.html") and not re.match(glob_regex("/[!a]x"), "/ax")


ROBOTS = """# comment
Disallow: /ignored
User-agent: Auditor
User-agent: other
Disallow: /private
Allow: /private/open
Disallow: /*.pdf$
Crawl-delay: 90

User-agent: *
Disallow: /
Sitemap: https://example.org/s.xml
"""


def test_robots(spark):
    rules = robots.parse_rules(spark.createDataFrame([("h", ROBOTS)], "host string, body string"))
    paths = spark.createDataFrame([("h", p) for p in ("/", "/private/x", "/private/open/y", "/a.pdf", "/a.pdf?x", "/robots.txt")], "host string, path string")
    own = {r["path"]: r["allowed"] for r in robots.decide(paths, robots.rules_for(rules, "Auditor/2.0 (+x)")).collect()}
    assert own == {"/": True, "/private/x": False, "/private/open/y": True, "/a.pdf": False, "/a.pdf?x": True, "/robots.txt": True}
    rest = {r["path"]: r["allowed"] for r in robots.decide(paths, robots.rules_for(rules, "nobody")).collect()}
    assert not rest["/"] and rest["/robots.txt"]
    assert robots.crawl_delay(rules, "auditor").first()["crawl_delay"] == 30.0
    assert [r["value"] for r in rules.where("kind = 'sitemap'").collect()] == ["https://example.org/s.xml"]


def test_robots_with_thousands_of_rules(spark):
    """Decisions by prefixes are those of matching every rule."""
    import random
    import re

    rng = random.Random(5)
    part = lambda: "".join(rng.choices("ab/.", k=rng.randrange(1, 6)))
    lines, own = ["User-agent: *"], []
    for _ in range(3000):
        pattern = "/" + part() + rng.choice(["", "", "*" + part(), "$", "*" + part() + "$", "*", "$" + part()])
        kind = rng.choice(["Allow", "Disallow"])
        lines.append(f"{kind}: {pattern}")
        own.append((kind == "Allow", pattern))
    paths = ["/" + part() + part() for _ in range(300)] + ["/robots.txt", "/zz"]

    def allowed(path):
        best = None
        for ok, pattern in own:
            end = pattern.endswith("$")
            rx = ".*".join(map(re.escape, (pattern[:-1] if end else pattern).split("*"))) + ("$" if end else "")
            if re.match(rx, path):
                best = max(best or (-1, False), (len(pattern), ok))
        return path == "/robots.txt" or best is None or best[1]

    rules = robots.parse_rules(spark.createDataFrame([("h", "\n".join(lines))], "host string, body string"))
    asked = spark.createDataFrame([("h", p) for p in paths] + [("other", "/a")], "host string, path string")
    got = {(r["host"], r["path"]): r["allowed"] for r in robots.decide(asked, rules).collect()}
    assert got.pop(("other", "/a")) and got == {("h", p): allowed(p) for p in paths}
    assert 0 < sum(got.values()) < len(got)


def test_sitemaps(spark):
    one = b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://example.org/a </loc></url><url><loc>https://away.org/b</loc></url></urlset>'
    index = b"<sitemapindex><sitemap><loc>https://example.org/1.xml</loc></sitemap><sitemap><loc>https://example.org/none.xml</loc></sitemap></sitemapindex>"
    files = spark.createDataFrame([("https://example.org/i.xml", index), ("https://example.org/1.xml", gzip.compress(one)), ("https://example.org/x.xml", b"<html/>")], "url string, content binary")
    log, urls = sitemaps.expand(files, ["https://example.org/i.xml", "https://example.org/x.xml"], ["example.org"])
    assert {(r["url"][20:], r["status"], r["url_count"]) for r in log.collect()} == {("i.xml", "ok", 2), ("1.xml", "ok", 2), ("none.xml", "not_found", 0), ("x.xml", "error", 0)}
    assert [r["url"] for r in urls.collect()] == ["https://example.org/a"]


def test_landing(spark, tmp_path):
    (tmp_path / "sites.txt").write_text("# sites\n\nA, B, https://a.org/\nC,https://c.org/\n")
    assert sorted(tuple(r) for r in landing.site_list(spark, str(tmp_path / "sites.txt")).collect()) == [("A, B", "https://a.org/"), ("C", "https://c.org/")]
    (tmp_path / "cases.json").write_text('[{"name": "a", "kind": "k", "question": "q", "expect": {"answers": true}}, {"name": "a"}]')
    with pytest.raises(ValueError):
        landing.eval_cases(spark, str(tmp_path / "cases.json"))
    rows = spark.createDataFrame([(["https://E.org/x", "2026-01-02"], 1, 2, 3.0), (["https://e.org/x", "fees"], 1, 2, 3.0), (["only"], 1, 1, 1.0)], landing.SEARCH_ROW)
    days, queries = landing.search_rows(rows)
    assert [r["page_host"] for r in days.collect()] == ["e.org"] and [r["query"] for r in queries.collect()] == ["fees"]
    new = spark.createDataFrame([("u", 304, None), ("v", 200, "t2")], "url string, status_code int, title string")
    old = spark.createDataFrame([("u", "t1"), ("v", "t0")], "url string, title string")
    assert {r["url"]: r["title"] for r in landing.carried_over(new, old, ["title"]).collect()} == {"u": "t1", "v": "t2"}


def test_directives(spark):
    row = spark.createDataFrame([("googlebot: NoIndex, follow",), (None,)], "v string").select(html.is_noindex(F.col("v")).alias("n")).collect()
    assert [r["n"] for r in row] == [True, False]
