"""Queries on what pages and robots.txt files say: real pages, and built ones that show each rule of reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..sources import html, robots
from .base import read


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every page by the HTML parser, with internal and external links told apart."""
    pages = read(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("<body>"), F.lit('<body><a href="https://partner.example.org/">Partner</a>')))
    rows = html.split_links(html.parse_pages(pages), ["partner.example.org"])
    return rows.select(
        "page_id", "title", "title_count", "lang", "h1_count", "word_count", "content_hash", F.size("links").alias("n_links"), F.size("headings").alias("n_headings"), "canonical_count", "images_missing_alt",
        F.col("internal_links_count").alias("n_partner"), F.col("external_links_count").alias("n_other"), F.col("links")[0]["anchor_text"].alias("first_anchor"),
    )


_PLAIN = "replace(" * 7 + "{}" + "".join(f", '&{name};', '{c}')" for name, c in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("#x27", "''"), ("lt", "<"), ("gt", ">"), ("amp", "&")))
PAGE_FACTS = rf"""WITH p AS (SELECT page_id, regexp_replace(html, '<[a-zA-Z/!][^>]*$', '') AS html FROM pages),
b AS (SELECT page_id, html, 'Partner ' || trim(regexp_replace({_PLAIN.format("regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<[a-zA-Z/!][^>]*>', ' ', 'g')")}, '\s+', ' ', 'g')) AS body,
    regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM p)
SELECT page_id, trim(regexp_replace({_PLAIN.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\s+', ' ', 'g')) AS title, 1 AS title_count, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '<h1>'))::INT AS h1_count,
    len(regexp_extract_all(body, '[\p{{L}}\p{{N}}_]+'))::INT AS word_count, sha256(lower(body)) AS content_hash, (len(list_distinct(h)) + 1)::INT AS n_links, len(regexp_extract_all(html, '<h1>'))::INT AS n_headings, 0 AS canonical_count, 0 AS images_missing_alt,
    1 AS n_partner, len(list_distinct(h))::INT AS n_other, 'Partner' AS first_anchor FROM b"""

_LINKS = "array_join(transform(links, x -> concat_ws(' ', x.url, x.anchor_text, x.nofollow)), '; ')"
_HEADINGS = "array_join(transform(headings, x -> concat(x.level, ':', x.text)), '; ')"
_IMAGES = "array_join(transform(images, x -> concat_ws(' ', x.src, x.alt)), '; ')"
#: Pages that show one rule each: (HTML, what is read of it in Spark, what it is), from page_id n. All at https://example.org/dir/page.
CASES = (
    ("""'<a href="/a">One</a><a href="/a#x">Two</a><a href="/a" rel="x NoFollow">Three</a><a href="n' || n || '"> </a><a href="mailto:a@b.c">M</a><a>none</a>'""", _LINKS, "'https://example.org/a One false; https://example.org/a Three true; https://example.org/dir/n' || n || '  false'"),
    ("'<body>one<b>two</b>three<br>' || n", "concat_ws('|', text, word_count)", "'one two three ' || n || '|4'"),
    ("'<head><title> In  ' || n || '</title></head><body><title>Out</title><svg><title>Pic</title></svg>x'", "concat_ws('|', title, title_count, text)", "'In ' || n || '|1|Out x'"),
    ("'<html><title>A</title><title>' || n || '</title><h1>x<h1>y'", "concat_ws('|', title, title_count, h1_count)", "'A|2|2'"),
    ("""'<link rel="canonical"><link rel="Canonical" href=" mailto:' || n || '@y.z "><link rel="x canonical" href="/b">'""", "concat_ws('|', canonical_url, canonical_count)", "'mailto:' || n || '@y.z|2'"),
    ("""'<meta name=" Description " content="  A   b ' || n || ' "><meta name="description">'""", "concat_ws('|', meta_description, meta_description_count)", "'A b ' || n || '|2'"),
    ("""'<html lang=""><meta name="robots" content=""><body>' || n""", "concat_ws('|', coalesce(meta_robots, 'none'), coalesce(lang, 'none'), coalesce(title, 'none'), coalesce(canonical_url, 'none'))", "'none|none|none|none'"),
    ("""'<html lang=" en-GB "><meta name=robots content="NoIndex"><meta name="ROBOTS" content=" max-snippet:' || n || '">'""", "concat_ws('|', meta_robots, lang)", "'NoIndex, max-snippet:' || n || '|en-GB'"),
    ("""'<html lang="' || repeat('l', 40 + CAST(n AS INT) % 9) || '"><title>' || repeat('t', 1001 + CAST(n AS INT) % 9) || '</title><meta name="description" content="' || repeat('d', 2001 + CAST(n AS INT) % 9) || '"><meta name="robots" content="' || repeat('r', 301 + CAST(n AS INT) % 9) || '"><h2>' || repeat('h', 501 + CAST(n AS INT) % 9)""", "concat_ws('|', length(lang), length(title), length(meta_description), length(meta_robots), length(headings[0].text))", "'35|1000|2000|300|500'"),
    ("""'<img src="i.png" alt=" A  b "><img src="data:x"><img alt src="/j' || n || '.png"><base href="/base/">'""", f"concat_ws('|', {_IMAGES}, image_count, images_missing_alt)", "'https://example.org/base/i.png A b; data:x; https://example.org/j' || n || '.png |3|1'"),
    ("""'<link rel="alternate" hreflang=" de-' || repeat('x', 40) || '" href="d"><link rel="alternate" hreflang="" href="e"><link rel="alternate canonical" hreflang="fr" href="f' || n || '">'""", "concat_ws('|', size(hreflang), length(hreflang[0].hreflang), hreflang[0].href, canonical_url)", "'1|35|https://example.org/dir/d|https://example.org/dir/f' || n"),
    ("""'<a href="/p"><span> </span><img alt="Pic ' || n || '"><img alt="Other"></a><a href="/q">T<img alt="Pic"></a>'""", _LINKS, "'https://example.org/p Pic ' || n || ' false; https://example.org/q T false'"),
    ("""'<a href="#!/a' || n || '"><a HREF = ''#/b''><a href=#/c><a href="#!x"><a href="#/"><a href="#/ d"><a href="/#/e">'""", "concat_ws('|', hash_route_links, size(links))", "'2|2'"),
    ("""'<template><a href="/t">t</a><h2>t</h2><img></template>a<script>var x = "<p>y</p><a href=/z>";</script>b<noscript>no <a href="/n">n</a></noscript>' || n""", f"concat_ws('|', {_LINKS}, {_HEADINGS}, image_count, text)", "'https://example.org/n n false||0|a b ' || n"),
    ("""'<div itemscope itemtype="B A"><p itemscope></div><script type="Application/LD+JSON; x">{"@type": "T' || n || '", "a": [{"@type": ["U", 1]}]}</script>'""", "concat_ws('|', structured_data.microdata.count, array_join(structured_data.microdata.types, ' '), array_join(structured_data.json_ld[0].types, ' '))", "'2|A B|T' || n || ' U'"),
    ("'<p>a<!-- <b>c</b> -->b' || n || '</foo>c'", "concat_ws('|', text, word_count)", "'a b' || n || 'c|2'"),
    ("'<p>&lt;b&gt; &eacute;' || n || ' a&nbsp;b x < y &amp'", "concat_ws('|', text, word_count)", "'<b> é' || n || ' a b x < y &|6'"),
    ("'hello ' || n || '<title>Late</title>'", "concat_ws('|', coalesce(title, 'none'), title_count, text)", "'none|0|hello ' || n || ' Late'"),
    ("'<h2>How to<em>apply</em></h2><h3> ' || n || ' </h4><p>after<h7>no</h7>'", _HEADINGS, "'2:How toapply; 3:' || n"),
    ("'<a href=\"/x' || n || '\">a <b>bold<a href=\"/y\">second</b> end</a> out'", _LINKS, "'https://example.org/x' || n || ' a bold false; https://example.org/y second end false'"),
)


def _case(k: int) -> str:
    return "CASE CAST(n AS BIGINT) % " + str(len(CASES)) + " " + " ".join(f"WHEN {i} THEN {c[k]}" for i, c in enumerate(CASES)) + " END"


def page_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").selectExpr("CAST(page_id AS STRING) AS n").selectExpr("n", "'https://example.org/dir/page' AS url", f"{_case(0)} AS html".replace("''", "\\'"))
    return html.parse_pages(rows).selectExpr("CAST(n AS BIGINT) AS page_id", f"{_case(1)} AS facts")


PAGE_CASES = f"WITH p AS (SELECT page_id, page_id::VARCHAR AS n FROM pages) SELECT page_id, {_case(2)} AS facts FROM p"

#: robots.txt files that show one rule each: (lines, delay of the crawler "auditor", paths it may not fetch).
ROBOTS_CASES = (
    ("User-agent: auditor|Unknown: x|User-agent: other|Disallow: /a", None, ()),
    ("User-agent: auditor|Sitemap: https://e.org/s|no colon|User-agent: other|Disallow: /a", None, ("/a/1",)),
    ("User-agent: auditor|Crawl-delay: 9|Crawl-delay: 4|Crawl-delay: soon", 4.0, ()),
    ("User-agent: auditor|Crawl-delay: -3", 0.0, ()),
    ("User-agent: auditor|Crawl-delay: 2||User-agent: Auditor|Crawl-delay: 7|Crawl-delay: 3||User-agent: *|Crawl-delay: 20", 3.0, ()),
    ("User-agent: *|Crawl-delay: 1e2|Disallow: /|Allow: /b$", 30.0, ("/a/1", "/b/c.pdf")),
    ("Disallow: /|User-agent:\t*\t|Disallow:\ta # all|Disallow:|ALLOW : /a/1", None, ()),
    ("User-agent: *|Disallow: /*.pdf$|Disallow: /b*c|Allow: /b*c", None, ("/b/c.pdf",)),
    ("User-agent: *|Disallow: *1|Disallow: /b/c.pdf?", None, ("/a/1",)),
    ("User-agent: auditor|User-agent: *|Disallow: /b|Allow: /b/c.pdf$||User-agent: *|Disallow: /a", None, ("/b",)),
)
ROBOTS_PATHS = ("/a/1", "/b", "/b/c.pdf", "/robots.txt")


def robots_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = read(spark, sf_dir, "supplier").select(F.concat(F.lit("h"), F.col("s_suppkey").cast("string")).alias("host"), (F.col("s_suppkey") % len(ROBOTS_CASES)).alias("k"))
    bodies = F.array(*[F.lit(lines.replace("|", "\r\n")) for lines, _, _ in ROBOTS_CASES])
    rules = robots.parse_rules(hosts.select("host", F.get(bodies, F.col("k")).alias("body")))
    paths = hosts.select("host", F.explode(F.array(*[F.lit(p) for p in ROBOTS_PATHS])).alias("path"))
    decided = robots.decide(paths, robots.rules_for(rules, "Auditor/1.0"))
    return decided.join(robots.crawl_delay(rules, "auditor"), "host", "left").select("host", "path", "allowed", "crawl_delay")


_ROBOTS_ROWS = ", ".join(f"({k}, {'NULL' if delay is None else delay}::DOUBLE, [{', '.join(repr(p) for p in gone)}]::VARCHAR[])" for k, (_, delay, gone) in enumerate(ROBOTS_CASES))
ROBOTS = f"""WITH c(k, crawl_delay, gone) AS (VALUES {_ROBOTS_ROWS}), p AS (SELECT unnest({list(ROBOTS_PATHS)}) AS path)
SELECT 'h' || s_suppkey AS host, path, NOT list_contains(gone, path) AS allowed, crawl_delay FROM supplier JOIN c ON k = s_suppkey % {len(ROBOTS_CASES)}, p"""


def robots_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page's host lets be fetched: hosts without a file, with one that cannot be reached, and with rules."""
    pages = read(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("found", "not_found", "unreachable")]), (F.length("host") % 3 + 1).cast("int"))
    files = pages.select("host").distinct().withColumn("body", F.lit("User-agent: *\nDisallow: /*1\n"))
    decided = robots.decide(pages, robots.rules_for(robots.parse_rules(files), "auditor"))
    return decided.select("page_id", status.alias("status"), robots.policy(status, F.col("path"), F.col("allowed")).alias("allowed"))


ROBOTS_POLICY = r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, ['found', 'not_found', 'unreachable'][length(host) % 3 + 1] AS status, CASE length(host) % 3 WHEN 0 THEN NOT contains(path, '1') WHEN 1 THEN true ELSE path = '/robots.txt' END AS allowed FROM p"""

QUERIES = {"page_facts": page_facts, "page_cases": page_cases, "robots_cases": robots_cases, "robots_policy": robots_policy}
SQL = {"page_facts": PAGE_FACTS, "page_cases": PAGE_CASES, "robots_cases": ROBOTS, "robots_policy": ROBOTS_POLICY}
