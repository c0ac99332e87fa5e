"""Queries on pages, links and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import compare, duplicates, history, linking, rules, score
from ..plans import context
from ..sources import html, robots
from .base import LINKS, SIM_CTX, SIM_PAGES, read, sim_context, sim_links, sim_pages

HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1))"
PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
SUBJECT = "substr(sha256(url), 1, 16)"


def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    body = html.visible_text(h)
    return read(spark, sf_dir, "pages").select("page_id", html.tag_text(h, "title").alias("title"), html.language(h).alias("lang"), html.tag_text(h, "h1").alias("h1"), html.tag_count(h, "h1").alias("h1_count"), F.size(html.hrefs(h)).alias("n_links"), text.content_hash(body).alias("content_hash"), html.hash_route_links(h).alias("hash_routes"))


TAG = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{0}[^>]*>(.*?)</{0}>', 1), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
PAGE_EXTRACT = rf"""SELECT page_id, {TAG.format("title")} AS title, regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1) AS lang, {TAG.format("h1")} AS h1, len(regexp_extract_all(html, '(?i)<h1[\s>]'))::INT AS h1_count,
len(regexp_extract_all(html, '(?i)<a[^>]*\shref="([^"]*)"', 1))::INT AS n_links,
sha256(lower(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|template|svg|head)[\s>].*?</(script|style|noscript|template|svg|head)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))) AS content_hash,
len(regexp_extract_all(html, '(?i)href\s*=\s*["'']#!?/[^"''\s]'))::INT AS hash_routes FROM pages"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(html.hrefs(F.col("html"))).alias("n", "href"))
    return rows.select("page_id", "n", "href", urls.host(F.col("href")).alias("host"))


PAGE_LINKS = r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]*\shref="([^"]*)"', 1) AS h FROM pages), x AS (SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS n FROM l)
SELECT page_id, n::INT AS n, href, lower(regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host FROM x"""


def url_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", urls.variant_key(F.col("url")).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


URL_VARIANTS = rf"""WITH p AS (SELECT page_id, {HOST} AS host, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(lower({PATH}), '/+$', '') AS path FROM pages)
SELECT scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END AS key, count(*) AS pages, min(page_id) AS first_page FROM p GROUP BY 1"""


def url_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(urls.problems(F.col("url"), 40), "; ").alias("problems"), urls.port(F.col("url")).alias("port"), urls.path_with_query(F.col("url")).alias("target"))


URL_STRUCTURE = rf"""WITH p AS (SELECT page_id, url, CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END AS path, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/:?#]+:(\d+)', 1) AS port FROM pages)
SELECT page_id, array_to_string(list_filter([CASE WHEN length(url) > 40 THEN 'longer than 40 characters (' || length(url) || ')' END, CASE WHEN path <> lower(path) THEN 'contains upper-case letters' END, CASE WHEN contains(path, '_') THEN 'uses underscores instead of hyphens' END,
CASE WHEN contains(path, ' ') THEN 'contains spaces' END, CASE WHEN contains(path, '//') THEN 'contains repeated slashes' END, CASE WHEN len(string_split(query, '&')) > 3 THEN 'has more than three query parameters' END], lambda x: x IS NOT NULL), '; ') AS problems,
CASE WHEN port <> '' THEN port::INT WHEN url LIKE 'https://%' THEN 443 ELSE 80 END AS port, path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS target FROM p"""


def host_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("pages"))
    return rows.select("host", "pages", urls.www_twin(F.col("host")).alias("twin"))


HOST_TWINS = f"""SELECT {HOST} AS host, count(*) AS pages, CASE WHEN NOT contains(host, '.') OR regexp_full_match(host, '[0-9.]+') THEN NULL WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE 'www.' || host END AS twin FROM pages GROUP BY 1"""


#: Addresses as pages write them: (reference, base, result), from host h, path p and page_id; null: no page.
ADDRESSES = (
    ("concat('HTTPS://', upper(h), p, '#top')", "NULL", "concat('https://', h, p)"),
    ("concat('https://', h, ':443/a/./b/../c?x=1')", "NULL", "concat('https://', h, '/a/c?x=1')"),
    ("concat('https://', h, ':8443/', page_id)", "NULL", "concat('https://', h, ':8443/', page_id)"),
    ("concat('http://', h, ':443')", "NULL", "concat('http://', h, ':443/')"),
    ("concat('MailTo:a@', h)", "NULL", "NULL"),
    ("concat('../up/', page_id)", "concat('https://', h, '/x/y/z')", "concat('https://', h, '/x/up/', page_id)"),
    ("concat(' ?page=', page_id, ' ')", "concat('https://', h, '/x/y?old=1')", "concat('https://', h, '/x/y?page=', page_id)"),
    ("concat('https://user:pw@', h, '/')", "NULL", "NULL"),
    ("concat('https://BÜCHER.example/', page_id)", "NULL", "concat('https://xn--bcher-kva.example/', page_id)"),
    ("concat('//', h, './s')", "concat('http://', h, '/a')", "concat('http://', h, '/s')"),
    ("concat('https://', h, '/', repeat('x', 2100))", "NULL", "NULL"),
    ("url", "NULL", "regexp_replace(url, '#.*$', '')"),
)


def _address(k: int) -> str:
    return "CASE page_id % " + str(len(ADDRESSES)) + " " + " ".join(f"WHEN {i} THEN {a[k]}" for i, a in enumerate(ADDRESSES)) + " END"


def url_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", "url", urls.host(F.col("url")).alias("h"), urls.path(F.col("url")).alias("p"))
    rows = rows.selectExpr("page_id", f"CAST({_address(0)} AS STRING) AS raw", f"CAST({_address(1)} AS STRING) AS base")
    return rows.select("page_id", urls.normalise_url(F.col("raw"), F.col("base")).alias("normalised"))


URL_NORMALISED = f"""WITH q AS (SELECT page_id, url, {HOST} AS h, CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END AS p FROM pages) SELECT page_id, {_address(2)} AS normalised FROM q"""


def page_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.list_pages(sim_pages(spark, sf_dir), status="2xx", in_sitemap=True, q="EXAMPLE.ORG", sort="response_time_ms", descending=True, number=2, size=20)
    return rows.select("url", "status_code", "response_time_ms")


PAGE_LISTING = f"""WITH {SIM_PAGES} SELECT url, status_code, response_time_ms FROM sim WHERE status_code BETWEEN 200 AND 299 AND in_sitemap AND (url ILIKE '%example.org%' OR title ILIKE '%example.org%') ORDER BY response_time_ms DESC NULLS LAST, url LIMIT 20 OFFSET 20"""


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, _ = history.crawl_summary(sim_pages(spark, sf_dir))
    return counts


STATUS_SUMMARY = f"""WITH {SIM_PAGES} SELECT 'status' AS kind, CASE WHEN status_code IS NULL THEN 'none' ELSE (status_code // 100)::VARCHAR || 'xx' END AS name, count(*) AS pages FROM sim GROUP BY 2 UNION ALL SELECT 'fetch', fetch_status, count(*) FROM sim GROUP BY 2"""


def crawl_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.crawl_summary(sim_pages(spark, sf_dir))[1]


CRAWL_FACTS = f"""WITH {SIM_PAGES} SELECT count(response_time_ms) AS timed, floor(avg(response_time_ms) + 0.5)::INT AS avg_ms, max(response_time_ms) AS max_ms, count(*) FILTER (is_noindex) AS noindex, count(*) FILTER (in_sitemap) AS in_sitemap, count(*) FILTER (is_orphan) AS orphans, count(*) FILTER (status_code BETWEEN 300 AND 399) AS redirects FROM sim"""


def page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-page rules over the whole crawl."""
    rows = rules.page_findings(sim_context(spark, sf_dir))
    return rows.select("rule_id", "severity", F.col("affected_urls")[0].alias("url"), "subject")


def _page_rules() -> list[str]:
    imp = lambda a, b: f"CASE WHEN important THEN '{a}' ELSE '{b}' END"
    title, about = "coalesce(title <> '', false)", "coalesce(meta_description <> '', false)"
    path = f"(CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END)"
    bad_url = rf"(length(url) > 115 OR {path} <> lower({path}) OR contains({path}, '_') OR contains({path}, ' ') OR contains({path}, '//') OR len(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&')) > 3)"
    cases = [
        ("tech.http_client_error", "status_code BETWEEN 400 AND 499", imp("critical", "high")),
        ("tech.http_server_error", "status_code >= 500", imp("critical", "high")),
        ("tech.fetch_failed", "fetch_status IN ('error', 'too_large', 'blocked_destination')", imp("high", "medium")),
        ("tech.redirect_chain", "redirects >= 2", "'medium'"),
        ("tech.internal_link_to_redirect", "redirected AND inlinks_count > 0", "'low'"),
        ("tech.blocked_by_robots", "fetch_status = 'blocked_by_robots' AND (in_sitemap OR inlinks_count > 0 OR important)", "CASE WHEN important OR in_sitemap THEN 'high' ELSE 'low' END"),
        ("tech.unexpected_noindex", "analysable AND is_noindex AND (in_sitemap OR important)", imp("critical", "high")),
        ("tech.canonical_multiple", "analysable AND canonical_count > 1", "'high'"),
        ("tech.slow_response", "response_time_ms >= 1000 AND NOT redirected", "CASE WHEN response_time_ms >= 3000 THEN 'high' ELSE 'medium' END"),
        ("tech.deep_important_page", "analysable AND important AND (depth IS NULL OR depth > 3)", "'medium'"),
        ("onpage.title_missing", f"analysable AND NOT {title}", imp("critical", "high")),
        ("onpage.title_multiple", "analysable AND title_count > 1", "'medium'"),
        ("onpage.title_length", f"analysable AND {title} AND length(title) NOT BETWEEN 30 AND 60", "'low'"),
        ("onpage.meta_description_missing", f"indexable AND NOT {about}", "'medium'"),
        ("onpage.meta_description_multiple", "analysable AND meta_description_count > 1", "'low'"),
        ("onpage.meta_description_length", f"indexable AND {about} AND length(meta_description) NOT BETWEEN 70 AND 160", "'low'"),
        ("onpage.h1_missing", "analysable AND h1_count = 0", "'medium'"),
        ("onpage.h1_multiple", "analysable AND h1_count > 1", "'low'"),
        ("onpage.heading_hierarchy", "analysable AND skips_level", "'low'"),
        ("onpage.canonical_missing", "indexable AND canonical_count = 0", "'low'"),
        ("onpage.url_structure", f"indexable AND {bad_url}", "'low'"),
        ("onpage.image_alt_missing", "analysable AND images_missing_alt > 0", "CASE WHEN images_missing_alt >= 5 THEN 'medium' ELSE 'low' END"),
        ("onpage.lang_missing", "analysable AND coalesce(lang, '') = ''", "'low'"),
        ("content.thin", "indexable AND word_count < 200", "CASE WHEN word_count < 100 THEN 'medium' ELSE 'low' END"),
        ("content.weak_structure", "indexable AND word_count >= 400 AND skips_level", "'low'"),
        ("content.review_dated_reference", r"indexable AND len(list_filter(regexp_extract_all(title, '\b(19[5-9]\d|20\d\d)\b', 1), lambda y: y::INT < 2025)) > 0", "'informational'"),
        ("links.orphan", "is_orphan", imp("high", "medium")),
        ("links.important_few_inlinks", "analysable AND important AND inlinks_count < 3", "'medium'"),
        ("links.no_internal_outlinks", "analysable AND internal_links_count = 0", "'low'"),
        ("links.excessive", "analysable AND internal_links_count + external_links_count > 150", "'low'"),
    ]
    return [f"SELECT '{r}' AS rule_id, {s} AS severity, url, {SUBJECT} AS subject FROM ctx WHERE {c}" for r, c, s in cases]


def _found(rows: DataFrame) -> DataFrame:
    return rows.select("rule_id", "severity", "affected_page_count", F.array_join("affected_urls", " ").alias("urls"))


def title_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = sim_context(spark, sf_dir)
    return _found(rules.shared_text(ctx, "title", "onpage.title_duplicate", "title").unionByName(rules.shared_text(ctx, "meta_description", "onpage.meta_description_duplicate", "description")))


def _shared(column: str, rule: str, severity: str) -> str:
    norm = rf"lower(trim(regexp_replace(coalesce({column}, ''), '\s+', ' ', 'g')))"
    return f"SELECT '{rule}' AS rule_id, '{severity}' AS severity, count(DISTINCT url)::INT AS affected_page_count, array_to_string(list_sort(list_distinct(list(url)))[1:200], ' ') AS urls FROM ctx WHERE indexable AND {norm} <> '' GROUP BY {norm} HAVING count(DISTINCT url) > 1"


def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(rules.same_content(sim_context(spark, sf_dir)))


CONTENT_DUPLICATES = rf"""WITH {SIM_CTX}, k AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || {HOST} || coalesce(nullif(regexp_replace(lower({PATH}), '/+$', ''), ''), '/') AS key FROM ctx)
SELECT 'content.duplicate' AS rule_id, 'medium' AS severity, count(DISTINCT url)::INT AS affected_page_count, array_to_string(list_sort(list_distinct(list(url)))[1:200], ' ') AS urls FROM k WHERE indexable AND content_hash IS NOT NULL AND word_count > 0 GROUP BY content_hash HAVING count(DISTINCT url) > 1 AND count(DISTINCT key) > 1"""


def canonical_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.canonical_targets(sim_context(spark, sf_dir))
    return rows.select("severity", F.col("affected_urls")[0].alias("url"), F.get_json_object("evidence", "$.problem").alias("problem"))


CANONICAL_TARGETS = f"""WITH {SIM_CTX}, j AS (SELECT a.url, a.canonical_url, t.url AS t_url, t.status_code AS s, t.redirected AS r, t.fetch_status AS f, t.analysable AND t.is_noindex AS n FROM ctx a LEFT JOIN ctx t ON a.canonical_url = t.url WHERE a.analysable AND a.elsewhere),
p AS (SELECT url, CASE WHEN t_url IS NULL AND lower(regexp_extract(canonical_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) <> 'example.org' THEN 'another domain' WHEN s >= 400 THEN 'error' WHEN r THEN 'redirect' WHEN f = 'blocked_by_robots' THEN 'blocked' WHEN n THEN 'noindex' END AS problem FROM j)
SELECT CASE WHEN problem = 'another domain' THEN 'informational' ELSE 'high' END AS severity, url, problem FROM p WHERE problem IS NOT NULL"""


def sitemap_bad_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.sitemap_bad_urls(sim_context(spark, sf_dir)).select("rule_id", "subject", "affected_page_count", F.array_join("affected_urls", " ").alias("urls"))


SITEMAP_BAD = f"""WITH {SIM_CTX}, b AS (SELECT DISTINCT url FROM ctx WHERE in_sitemap AND (coalesce(status_code >= 400, false) OR redirected OR (analysable AND is_noindex) OR (analysable AND elsewhere))),
p AS (SELECT substr(md5(url), 1, 3) AS part, sha256(string_agg(url, chr(31) ORDER BY url)) AS hash FROM b GROUP BY 1)
SELECT 'tech.sitemap_bad_urls' AS rule_id, (SELECT substr(sha256(string_agg(hash, chr(31) ORDER BY part)), 1, 16) FROM p) AS subject, count(*)::INT AS affected_page_count, array_to_string(list_sort(list(url))[1:200], ' ') AS urls FROM b"""


def broken_link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = sim_context(spark, sf_dir)
    rows = rules.broken_links(ctx)
    return rows.select(F.col("affected_urls")[0].alias("url"), F.get_json_object("evidence", "$.count").cast("bigint").alias("broken"))


BAD = "(coalesce(status_code >= 400, false) OR fetch_status IN ('error', 'too_large', 'blocked_destination'))"
BROKEN_PAGES = f"""WITH {SIM_PAGES}, {LINKS}, l AS (SELECT DISTINCT source_id, target_id FROM links WHERE is_internal)
SELECT s.url, count(*) AS broken FROM l JOIN (SELECT id FROM sim WHERE {BAD}) t ON l.target_id = t.id JOIN sim s ON l.source_id = s.id GROUP BY s.id, s.url"""


def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linking.broken_links(sim_links(spark, sf_dir), sim_pages(spark, sf_dir))
    return rows.groupBy("target_url", "fetch_status").agg(F.count("*").alias("links"), F.count_distinct("source_url").alias("sources"))


BROKEN_LINKS = f"""WITH {SIM_PAGES}, {LINKS} SELECT t.url AS target_url, t.fetch_status, count(*) AS links, count(DISTINCT s.url) AS sources FROM links l JOIN sim t ON l.target_id = t.id JOIN sim s ON l.source_id = s.id WHERE l.is_internal AND (coalesce(t.status_code >= 400, false) OR t.fetch_status IN ('error', 'too_large', 'blocked_destination')) GROUP BY 1, 2"""


def inlinks_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.count_inlinks(sim_pages(spark, sf_dir).select("id", "url", "inlinks_count"), sim_links(spark, sf_dir)).select("id", "inlinks_count")


INLINKS = f"""WITH {SIM_PAGES}, {LINKS} SELECT s.id, count(DISTINCT l.source_id)::INT AS inlinks_count FROM sim s LEFT JOIN links l ON l.target_id = s.id AND l.is_internal AND l.source_id <> l.target_id GROUP BY s.id"""


def orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = sim_links(spark, sf_dir).where(~F.col("target_id").rlike("[37]$"))
    counted = context.count_inlinks(sim_pages(spark, sf_dir).select("id", "url", "inlinks_count", "in_sitemap", "fetch_status"), links)
    return context.mark_orphans(counted, "https://example.org/").where("is_orphan").select("url", "inlinks_count")


ORPHANS = f"""WITH {SIM_PAGES}, {LINKS} SELECT url, 0 AS inlinks_count FROM sim s WHERE in_sitemap AND fetch_status IN ('fetched', 'not_modified') AND NOT EXISTS (SELECT 1 FROM links l WHERE l.target_id = s.id AND l.is_internal AND l.source_id <> l.target_id AND NOT regexp_matches(l.target_id, '[37]$'))"""


def linking_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linking.linking_sources(sim_links(spark, sf_dir), sim_pages(spark, sf_dir))
    return rows.select("target_id", F.array_join("sources", " ").alias("sources"))


LINKING_SOURCES = f"""WITH {SIM_PAGES}, {LINKS}, d AS (SELECT DISTINCT l.target_id, s.url FROM links l JOIN sim s ON l.source_id = s.id WHERE l.target_id <> l.source_id),
r AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY url) AS n FROM d) SELECT target_id, string_agg(url, ' ' ORDER BY url) AS sources FROM r WHERE n <= 10 GROUP BY target_id"""


def nofollow_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.nofollow(sim_context(spark, sf_dir))
    return rows.select(F.col("affected_urls")[0].alias("url"), F.get_json_object("evidence", "$.count").cast("bigint").alias("targets"))


NOFOLLOW = f"""WITH {SIM_CTX}, {LINKS} SELECT c.url, count(DISTINCT l.target_url) AS targets FROM ctx c JOIN links l ON l.source_id = c.id WHERE c.analysable AND l.is_internal AND l.nofollow GROUP BY c.id, c.url"""

ROBOTS_TXT = "User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*.html$\n\nUser-agent: other\nDisallow: /\nSitemap: https://example.org/sitemap.xml\n"


def robots_longest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path"))
    files = pages.select("host").distinct().withColumn("body", F.lit(ROBOTS_TXT))
    own = robots.rules_for(robots.parse_rules(files), "site-auditor/1.0")
    return robots.decide(pages, own).select("page_id", "allowed")


ROBOTS = f"""WITH p AS (SELECT page_id, CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END AS path FROM pages), r(len, ok, rx) AS (VALUES (4, false, '^/en/'), (5, true, '^/en/1'), (8, false, '^/.*\\.html$')),
h AS (SELECT page_id, arg_max(ok, len * 2 + ok::INT) AS ok FROM p JOIN r ON regexp_matches(path, rx) GROUP BY page_id) SELECT p.page_id, coalesce(h.ok, true) AS allowed FROM p LEFT JOIN h ON p.page_id = h.page_id"""


def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = sim_links(spark, sf_dir).where("is_internal").select(F.col("source_id").alias("source"), F.col("target_id").alias("target")).distinct()
    return context.depths("p1", edges, 3)


BFS = f"""WITH {LINKS}, e AS MATERIALIZED (SELECT DISTINCT source_id, target_id FROM links WHERE is_internal), d1 AS (SELECT DISTINCT target_id AS url FROM e WHERE source_id = 'p1' AND target_id <> 'p1'),
d2 AS (SELECT DISTINCT target_id AS url FROM e JOIN d1 ON source_id = d1.url WHERE target_id <> 'p1' AND target_id NOT IN (SELECT url FROM d1)),
d3 AS (SELECT DISTINCT target_id AS url FROM e JOIN d2 ON source_id = d2.url WHERE target_id <> 'p1' AND target_id NOT IN (SELECT url FROM d1) AND target_id NOT IN (SELECT url FROM d2))
SELECT 'p1' AS url, 0 AS depth UNION ALL SELECT url, 1 FROM d1 UNION ALL SELECT url, 2 FROM d2 UNION ALL SELECT url, 3 FROM d3"""


def topic_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), text.tokens(html.tag_text(F.col("html"), "title")).alias("words"))
    return duplicates.topic_pairs(rows, 0.6).select("a", "b", F.round("overlap", 6).alias("overlap"))


TOPIC_OVERLAP = rf"""WITH w AS MATERIALIZED (SELECT page_id AS k, list_distinct(list_transform(regexp_extract_all({TAG.format("title")}, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x))) AS words FROM pages), u AS MATERIALIZED (SELECT * FROM w WHERE len(words) >= 2)
SELECT a.k AS a, b.k AS b, round(len(list_intersect(a.words, b.words))::DOUBLE / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))), 6) AS overlap FROM u a JOIN u b ON a.k < b.k WHERE len(list_intersect(a.words, b.words))::DOUBLE / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) >= 0.6"""


#: Ends of titles in four groups: one name, two names that share them, two separators, none alike.
ENDS = "CASE WHEN page_id % 4 = 0 THEN ' | Example Institute' WHEN page_id % 4 = 1 THEN (CASE WHEN page_id % 8 = 1 THEN ' | North' ELSE ' | South' END) WHEN page_id % 4 = 2 THEN ' - Guide | Site' ELSE concat(' :: ', page_id) END"


def title_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select((F.col("page_id") % 4).alias("grp"), F.concat(html.tag_text(F.col("html"), "title"), F.expr(ENDS)).alias("title"))
    out = rows.join(text.common_title_suffix(rows, keys=("grp",)), "grp", "left")
    return out.groupBy("grp", "suffix").agg(F.count("*").alias("titles"), F.sum(F.length(text.strip_suffix(F.col("title"), F.col("suffix")))).alias("left_chars"))


_LAST = ", ".join(f"CASE WHEN contains(title, '{s}') THEN '{s}' || list_last(string_split(title, '{s}')) END" for s in text.SEPARATORS)
TITLE_SUFFIX = rf"""WITH t AS MATERIALIZED (SELECT page_id % 4 AS grp, {TAG.format("title")} || {ENDS} AS title FROM pages), c AS (SELECT grp, unnest(list_filter([{_LAST}], lambda x: x IS NOT NULL)) AS suffix FROM t),
h AS (SELECT grp, suffix, count(*) AS hits FROM c GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY hits DESC, suffix) AS r FROM h), n AS (SELECT grp, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT n.grp, CASE WHEN n >= 2 AND hits >= greatest(2.0, n / 2.0) THEN suffix END AS suffix FROM n LEFT JOIN b ON n.grp = b.grp AND r = 1)
SELECT t.grp, s.suffix, count(*) AS titles, sum(length(CASE WHEN s.suffix IS NOT NULL AND ends_with(trim(title), s.suffix) THEN trim(left(trim(title), length(trim(title)) - length(s.suffix))) ELSE trim(title) END))::BIGINT AS left_chars FROM t JOIN s ON t.grp = s.grp GROUP BY 1, 2"""


def rule_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of the simulated crawl but those on texts and structured data, deduplicated by issue key, counted by rule."""
    rows = rules.run_rules(sim_context(spark, sf_dir))
    return rows.groupBy("category", "rule_id").agg(F.count("*").alias("findings"), F.sum("affected_page_count").alias("affected"))


def _rule_union_sql() -> str:
    """Findings (rule_id, subject, first address, affected); the first of a subject counts."""
    value = r"lower(trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g')))"
    shared = lambda c, r: f"SELECT '{r}', {value.format(c)}, min(url), count(DISTINCT url) FROM ctx WHERE indexable AND {value.format(c)} <> '' GROUP BY 2 HAVING count(DISTINCT url) > 1"
    key = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || " + HOST + f" || coalesce(nullif(regexp_replace(lower({PATH}), '/+$', ''), ''), '/')"
    parts = [
        *[f"SELECT rule_id, subject, url, 1 FROM ({p})" for p in _page_rules()],
        f"SELECT 'tech.broken_internal_links', url, url, 1 FROM (SELECT DISTINCT s.url FROM links l JOIN sim t ON l.target_id = t.id JOIN sim s ON l.source_id = s.id WHERE l.is_internal AND (coalesce(t.status_code >= 400, false) OR t.fetch_status IN ('error', 'too_large', 'blocked_destination')))",
        "SELECT r, 'site', '', (SELECT count(*) FROM ctx) FROM (VALUES ('tech.sitemap_missing'), ('tech.sitemap_errors'), ('tech.robots_missing')) v(r)",
        "SELECT 'tech.sitemap_bad_urls', 'all', '', n FROM (SELECT count(DISTINCT url) AS n FROM ctx WHERE in_sitemap AND (coalesce(status_code >= 400, false) OR redirected OR (analysable AND is_noindex) OR (analysable AND elsewhere))) WHERE n > 0",
        "SELECT 'tech.http_not_https', 'http', '', n FROM (SELECT count(DISTINCT url) AS n FROM ctx WHERE starts_with(url, 'http://') AND status_code IS NOT NULL) WHERE n > 0",
        f"SELECT 'tech.canonical_target_problem', url, url, 1 FROM ({CANONICAL_TARGETS})",
        f"SELECT 'tech.duplicate_url_variants', key, min(url), count(DISTINCT url) FROM (SELECT *, {key} AS key FROM ctx WHERE indexable) GROUP BY key, content_hash HAVING count(DISTINCT url) > 1",
        shared("title", "onpage.title_duplicate"),
        shared("meta_description", "onpage.meta_description_duplicate"),
        f"SELECT 'content.duplicate', content_hash, min(url), count(DISTINCT url) FROM (SELECT *, {key} AS key FROM ctx WHERE indexable AND word_count > 0) GROUP BY content_hash HAVING count(DISTINCT url) > 1 AND count(DISTINCT key) > 1",
        "SELECT DISTINCT 'links.nofollow_internal', c.url, c.url, 1 FROM ctx c JOIN links l ON l.source_id = c.id WHERE c.analysable AND l.is_internal AND l.nofollow",
    ]
    names = ", ".join(f"('{r.id}', '{r.category}')" for r in rules.RULES.values())
    return f"""WITH {SIM_CTX}, {LINKS}, f(rule_id, subject, url, n) AS ({" UNION ALL ".join(parts)}), k AS (SELECT rule_id, subject, arg_min(n, url) AS n FROM f GROUP BY 1, 2), c(rule_id, category) AS (VALUES {names})
SELECT category, rule_id, count(*) AS findings, sum(n)::BIGINT AS affected FROM k JOIN c USING (rule_id) GROUP BY 1, 2"""


def similar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate and topic findings over the pages' own texts; a test holds both rules against plain cases."""
    own = read(spark, sf_dir, "pages").select("page_id", html.visible_text(F.col("html")).alias("text"))
    pages = sim_context(spark, sf_dir).pages.join(own, "page_id")
    rows = duplicates.findings(pages)
    return rows.groupBy("rule_id").agg(F.count("*").alias("findings"), F.sum("affected_page_count").alias("affected"))


def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = sim_context(spark, sf_dir)
    found = rules.first_of_key(rules.with_metadata(rules.page_findings(ctx)))
    return score.category_scores(found, score.denominators(ctx.pages)).select("category", "pages_considered", F.round("penalty", 6).alias("penalty"), "score")


def _category_scores_sql() -> str:
    rules_sql = " UNION ALL ".join(_page_rules())
    return f"""WITH {SIM_CTX}, f0 AS ({rules_sql}),
f AS (SELECT rule_id, arg_min(severity, severity) AS severity, subject FROM f0 GROUP BY rule_id, subject),
c(prefix, category, k) AS (VALUES ('tech', 'technical', 0), ('onpage', 'on_page', 1), ('content', 'content', 2), ('links', 'internal_linking', 3), ('schema', 'structured_data', 4)),
n AS (SELECT category, prefix, CASE WHEN category = 'technical' THEN (SELECT count(*) FROM ctx) ELSE (SELECT count(*) FROM ctx WHERE analysable) END AS n FROM c),
p AS (SELECT n.category, rule_id, floor(least(1.0::DOUBLE, sum((CASE severity WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.5::DOUBLE WHEN 'medium' THEN 0.2::DOUBLE WHEN 'low' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END) * least(1.0::DOUBLE, 1.0::DOUBLE / n))) * 10000 + 0.5) / 10000 AS penalty FROM f JOIN n ON split_part(rule_id, '.', 1) = n.prefix GROUP BY 1, 2),
s AS (SELECT n.category, n.n, least(1.0::DOUBLE, coalesce(sum(penalty), 0)) AS penalty FROM n LEFT JOIN p ON n.category = p.category GROUP BY 1, 2)
SELECT category, n AS pages_considered, round(penalty, 6) AS penalty, CASE WHEN n > 0 THEN floor(100.0::DOUBLE * (1.0::DOUBLE - penalty) * 10 + 0.5) / 10 END AS score FROM s"""


def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = sim_context(spark, sf_dir)
    found = rules.with_metadata(rules.page_findings(ctx, {"tech.slow_response", "content.thin", "tech.http_client_error"}))
    flags = ctx.pages.select(F.col("url").alias("primary_url"), "important").distinct()
    total = ctx.pages.agg(F.count("*").alias("total"))
    rows = found.join(flags, "primary_url").join(F.broadcast(total), F.lit(True))
    return score.priority(rows, F.col("total"), F.col("important"), F.lit(False)).select("rule_id", F.col("primary_url").alias("url"), "priority")


def _priorities_sql() -> str:
    wanted = ("tech.slow_response", "content.thin", "tech.http_client_error")
    parts = [p for p in _page_rules() if any(f"'{w}'" in p for w in wanted)]
    return f"""WITH {SIM_CTX}, f AS ({" UNION ALL ".join(parts)}), t AS (SELECT count(*) AS total FROM ctx), i AS (SELECT DISTINCT url, important FROM ctx)
SELECT rule_id, f.url, floor(least(100.0::DOUBLE, (CASE severity WHEN 'critical' THEN 55.0 WHEN 'high' THEN 40.0 WHEN 'medium' THEN 25.0 WHEN 'low' THEN 10.0 ELSE 2.0 END::DOUBLE + floor(20.0::DOUBLE * log10(2.0::DOUBLE) / log10(1.0::DOUBLE + total) * 10 + 0.5) / 10
+ CASE WHEN important THEN 12.0 ELSE 0.0 END::DOUBLE + CASE WHEN rule_id IN ('tech.http_client_error') THEN 8.0 ELSE 4.0 END::DOUBLE) * CASE WHEN rule_id = 'tech.http_client_error' THEN 1.0 ELSE 0.85 END::DOUBLE) * 10 + 0.5) / 10 AS priority FROM f JOIN i ON f.url = i.url, t"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = read(spark, sf_dir, "documents").withColumn("url", F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")))
    def snap(rows: DataFrame, k: int) -> DataFrame:
        i = F.col("doc_id")
        return rows.select("url", F.when(i % (5 + k) == 0, 404).otherwise(200).alias("status_code"), F.concat(F.lit("Title "), F.floor(i / (2 + k)).cast("string")).alias("title"), F.col("source").alias("meta_description"), F.concat(F.col("url"), F.lit("/new")).alias("final_url"), (i % (3 + k)).cast("int").alias("redirects"), F.md5(F.concat(F.col("text"), F.when(i % 7 == k, "x").otherwise(""))).alias("content_hash"), (i % (4 + k)).cast("int").alias("inlinks_count"), (i % 10 != 9).alias("analysable"))
    return snap(base.where("doc_id % 11 <> 1"), 0), snap(base.where("doc_id % 13 <> 1"), 1)


def crawl_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.changes(*_snapshots(spark, sf_dir))


def crawl_compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.summary(compare.changes(*_snapshots(spark, sf_dir))).select("change", "total", F.array_join("first", " ").alias("first"))


def _snap_sql(k: int, skip: int) -> str:
    return f"""SELECT 'https://example.org/' || doc_id AS url, CASE WHEN doc_id % {5 + k} = 0 THEN 404 ELSE 200 END AS status_code, 'Title ' || (doc_id // {2 + k}) AS title, 'https://example.org/' || doc_id || '/new' AS final_url, doc_id % {3 + k} AS redirects,
md5(text || CASE WHEN doc_id % 7 = {k} THEN 'x' ELSE '' END) AS content_hash, doc_id % {4 + k} AS inlinks_count, doc_id % 10 <> 9 AS analysable FROM documents WHERE doc_id % {skip} <> 1"""


COMPARE = f"""o AS ({_snap_sql(0, 11)}), n AS ({_snap_sql(1, 13)}), j AS (SELECT coalesce(o.url, n.url) AS url, o.url AS ou, n.url AS nu, o.status_code AS os, n.status_code AS ns, o.title AS ot, n.title AS nt, CASE WHEN o.redirects > 0 THEN o.final_url END AS orr, CASE WHEN n.redirects > 0 THEN n.final_url END AS nr, o.content_hash AS oh, n.content_hash AS nh, o.inlinks_count AS oi, n.inlinks_count AS ni, n.analysable AS na FROM o FULL JOIN n ON o.url = n.url),
c AS (SELECT 'added' AS change, url, NULL AS before, NULL AS after FROM j WHERE ou IS NULL UNION ALL SELECT 'removed', url, NULL, NULL FROM j WHERE nu IS NULL UNION ALL SELECT 'status', url, os::VARCHAR, ns::VARCHAR FROM j WHERE ou IS NOT NULL AND nu IS NOT NULL AND os <> ns
UNION ALL SELECT 'title', url, ot, nt FROM j WHERE ou IS NOT NULL AND nu IS NOT NULL AND na AND ot <> nt UNION ALL SELECT 'redirect', url, orr, nr FROM j WHERE ou IS NOT NULL AND nu IS NOT NULL AND orr IS DISTINCT FROM nr
UNION ALL SELECT 'content', url, NULL, NULL FROM j WHERE ou IS NOT NULL AND nu IS NOT NULL AND oh <> nh UNION ALL SELECT 'inbound_links', url, oi::VARCHAR, ni::VARCHAR FROM j WHERE ou IS NOT NULL AND nu IS NOT NULL AND oi <> ni)"""
COMPARE_SUMMARY = f"""WITH {COMPARE}, k(change) AS (VALUES ('added'), ('removed'), ('status'), ('title'), ('meta_description'), ('redirect'), ('content'), ('inbound_links')), r AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY url) AS n FROM c)
SELECT k.change, count(r.url) AS total, coalesce(string_agg(r.url, ' ' ORDER BY r.url) FILTER (n <= 50), '') AS first FROM k LEFT JOIN r ON k.change = r.change GROUP BY k.change"""

QUERIES = {
    "page_extract": page_extract,
    "page_links_explode": page_links,
    "url_variants": url_variants,
    "url_structure": url_structure,
    "host_twin_scope": host_twins,
    "url_normalised": url_normalised,
    "page_listing_filters": page_listing,
    "sim_status_class_summary": status_summary,
    "sim_crawl_facts": crawl_facts,
    "sim_page_rules": page_rules,
    "sim_shared_titles": title_duplicates,
    "sim_content_duplicate": content_duplicates,
    "sim_canonical_target": canonical_targets,
    "sim_sitemap_bad_urls": sitemap_bad_urls,
    "sim_broken_link_pages": broken_link_pages,
    "broken_links": broken_links,
    "inlinks_distinct": inlinks_distinct,
    "orphan_pages": orphan_pages,
    "linking_sources_top10": linking_sources,
    "nofollow_targets": nofollow_targets,
    "robots_longest_match": robots_longest_match,
    "bfs_depth": bfs_depth,
    "topic_overlap": topic_overlap,
    "title_suffix": title_suffix,
    "rule_union_dedup": rule_union,
    "sim_similar_pages": similar_pages,
    "category_scores": category_scores,
    "priority_rank": priorities,
    "crawl_compare": crawl_compare,
    "crawl_compare_summary": crawl_compare_summary,
}
SQL = {
    "page_extract": PAGE_EXTRACT,
    "page_links_explode": PAGE_LINKS,
    "url_variants": URL_VARIANTS,
    "url_structure": URL_STRUCTURE,
    "host_twin_scope": HOST_TWINS,
    "url_normalised": URL_NORMALISED,
    "page_listing_filters": PAGE_LISTING,
    "sim_status_class_summary": STATUS_SUMMARY,
    "sim_crawl_facts": CRAWL_FACTS,
    "sim_page_rules": f"WITH {SIM_CTX} " + " UNION ALL ".join(_page_rules()),
    "sim_shared_titles": f"WITH {SIM_CTX} " + _shared("title", "onpage.title_duplicate", "medium") + " UNION ALL " + _shared("meta_description", "onpage.meta_description_duplicate", "low"),
    "sim_content_duplicate": CONTENT_DUPLICATES,
    "sim_canonical_target": CANONICAL_TARGETS,
    "sim_sitemap_bad_urls": SITEMAP_BAD,
    "sim_broken_link_pages": BROKEN_PAGES,
    "broken_links": BROKEN_LINKS,
    "inlinks_distinct": INLINKS,
    "orphan_pages": ORPHANS,
    "linking_sources_top10": LINKING_SOURCES,
    "nofollow_targets": NOFOLLOW,
    "robots_longest_match": ROBOTS,
    "bfs_depth": BFS,
    "topic_overlap": TOPIC_OVERLAP,
    "title_suffix": TITLE_SUFFIX,
    "rule_union_dedup": _rule_union_sql(),
    "category_scores": _category_scores_sql(),
    "priority_rank": _priorities_sql(),
    "crawl_compare": f"WITH {COMPARE} SELECT change, url, before, after FROM c",
    "crawl_compare_summary": COMPARE_SUMMARY,
}
