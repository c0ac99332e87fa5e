"""Queries of structured-data rules, and of links, groups and scores that other queries do not reach, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare, rules, search, structured
from ..plans import context
from ..plans.settings import ContentType, Settings
from .base import ISSUES, SIM_CTX, read, sim_context, sim_issues, sim_links, sim_pages

TYPES = ("Thing", *structured.REQUIREMENTS)
PROPERTIES = tuple(dict.fromkeys(p for needed, better in structured.REQUIREMENTS.values() for p in (*needed, *better)))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with one JSON-LD block each: every type in turn, with three in four of all properties; some are no JSON."""
    page = F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (page % len(TYPES) + 1).cast("int"))
    props = [F.when(page * (j + 3) % 4 > 0, F.lit(f', "{p}": "x"')).otherwise("") for j, p in enumerate(PROPERTIES)]
    block = F.struct(
        F.array(kind).alias("types"), (page % 13 != 4).alias("valid"), F.when(page % 13 == 4, "Invalid JSON: line 1").alias("error"),
        F.when(page % 13 != 4, F.concat(F.lit('{"@type": "'), kind, F.lit('"'), *props, F.lit("}"))).alias("data"),
    )
    micro = F.struct(F.lit(0).alias("count"), F.array().cast("array<string>").alias("types"))
    return read(spark, sf_dir, "pages").select("page_id", "url", F.struct(F.array(block).alias("json_ld"), micro.alias("microdata")).alias("structured_data"))


def jsonld_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required and recommended properties of every known type."""
    rows = structured.check_pages(_blocks(spark, sf_dir))
    return rows.select("url", F.array_join("types", ",").alias("types"), "valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


_TYPES = ", ".join(f"({k}, '{t}', {_list(structured.REQUIREMENTS.get(t, ((), ()))[0])}, {_list(structured.REQUIREMENTS.get(t, ((), ()))[1])})" for k, t in enumerate(TYPES))
_ABSENT = f"page_id * (list_position({_list(PROPERTIES)}, p) + 2) % 4 = 0"
CHECKS = f"""types(k, t, needed, better) AS (VALUES {_TYPES}),
found AS MATERIALIZED (SELECT page_id, url, t, page_id % 13 = 4 AS bad, list_transform(list_filter(needed, lambda p: {_ABSENT}), lambda p: t || ' is missing required property ''' || p || '''') AS errors,
    list_transform(list_filter(better, lambda p: {_ABSENT}), lambda p: t || ' could add recommended property ''' || p || '''') AS warnings FROM pages JOIN types ON page_id % {len(TYPES)} = k),
checks AS MATERIALIZED (SELECT page_id, url, CASE WHEN bad THEN [] ELSE [t] END AS types, NOT bad AND len(errors) = 0 AS valid, CASE WHEN bad THEN ['Invalid JSON: line 1'] ELSE errors END AS errors, CASE WHEN bad THEN [] ELSE warnings END AS warnings FROM found)"""
REQUIREMENTS_SQL = f"WITH {CHECKS} SELECT url, array_to_string(types, ',') AS types, valid, array_to_string(errors, '; ') AS errors, array_to_string(warnings, '; ') AS warnings FROM checks"


def sim_schema_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invalid blocks, recommended properties, a home page without an organisation, and types that pages could have."""
    ctx = sim_context(spark, sf_dir)
    root = ctx.pages.where(f"analysable AND page_id % {len(TYPES)} = 0").agg(F.min("url")).first()[0]
    own = ContentType("course", "Course", ("/**",), schema_types=("Course",))
    ctx.settings = Settings(root_url=root, allowed_hosts=("example.org",), content_types=(own,))
    found = rules.schema_rules(ctx, structured.check_pages(_blocks(spark, sf_dir)))
    return found.select("rule_id", "severity", "scope", F.element_at("affected_urls", 1).alias("first_url"), "affected_page_count")


SCHEMA_SQL = f"""WITH {SIM_CTX}, {CHECKS},
c AS (SELECT checks.*, indexable FROM checks JOIN ctx ON checks.page_id = ctx.page_id WHERE analysable),
home AS (SELECT min(url) AS url FROM ctx WHERE analysable AND page_id % {len(TYPES)} = 0)
SELECT 'schema.invalid' AS rule_id, CASE WHEN errors[1] LIKE 'Invalid JSON%' THEN 'high' ELSE 'medium' END AS severity, 'page' AS scope, url AS first_url, 1 AS affected_page_count FROM c WHERE len(errors) > 0
UNION ALL SELECT 'schema.recommended_properties', 'informational', 'page', url, 1 FROM c WHERE len(warnings) > 0
UNION ALL SELECT 'schema.home_organisation_missing', 'low', 'page', c.url, 1 FROM c JOIN home ON c.url = home.url WHERE NOT list_has_any(types, {_list(structured.ORGANISATIONS)})
UNION ALL SELECT 'schema.content_type_opportunity', '{rules.RULES['schema.content_type_opportunity'].severity}', 'group', min(ctx.url), count(*)::INT FROM ctx LEFT JOIN c ON ctx.page_id = c.page_id WHERE ctx.indexable AND NOT coalesce(list_contains(c.types, 'Course'), false) HAVING count(*) > 0"""


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to pages of the same crawl by address: how many go to each page, and how many to none."""
    pages = sim_pages(spark, sf_dir).select("crawl_job_id", F.concat(F.lit("https://example.org/"), (F.col("page_id") % 37).cast("string"), F.lit("/"), F.col("page_id").cast("string")).alias("url"), "id")
    links = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 7, "c2").otherwise("c1").alias("crawl_job_id"), F.concat(F.lit("https://example.org/"), (F.col("l_partkey") % 37).cast("string"), F.lit("/"), F.col("l_partkey").cast("string")).alias("target_url"), F.lit("old").alias("target_id"))
    return context.resolve_links(links, pages).groupBy("target_id").agg(F.count("*").alias("links"))


RESOLVED_SQL = "SELECT CASE WHEN l_linenumber <> 7 AND page_id IS NOT NULL THEN concat('p', page_id) END AS target_id, count(*) AS links FROM lineitem LEFT JOIN pages ON l_partkey = page_id GROUP BY 1"


def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first group and all content types that match a page's path."""
    s = Settings(
        page_groups=(("news", ("/news/*", "/blog/*")), ("fifth", ("/*/*5",)), ("rest", ("/c*/*",))),
        content_types=(ContentType("course", "Course", ("/courses/*",)), ContentType("fifth", "Fifth", ("/*/*5",))),
    )
    part = F.element_at(F.array(*map(F.lit, ("news", "blog", "courses", "about"))), (F.col("page_id") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://example.org/"), part, F.lit("/"), F.col("page_id").cast("string")).alias("url"))
    return rows.select("page_id", context.page_group(s).alias("page_group"), F.array_join(context.content_types(s), ",").alias("content_types"))


GROUPS_SQL = """SELECT page_id, CASE WHEN page_id % 4 < 2 THEN 'news' WHEN page_id % 10 = 5 THEN 'fifth' WHEN page_id % 4 = 2 THEN 'rest' END AS page_group,
    concat_ws(',', CASE WHEN page_id % 4 = 2 THEN 'course' END, CASE WHEN page_id % 10 = 5 THEN 'fifth' END) AS content_types FROM pages"""


def opportunity_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search pages, as the engine writes them, with their crawled page and its open issues of title and description."""
    address = lambda c: F.concat(F.lit("https://example.org/"), c.cast("string"))
    key = F.col("c_custkey") % 60
    written = F.when(key % 3 == 0, F.concat(F.lit("HTTPS://Example.org:443/x/../"), key.cast("string"), F.lit("#top"))).otherwise(address(key))
    found = read(spark, sf_dir, "customer").select(written.alias("page")).distinct()
    key = F.col("n_nationkey")
    pages = read(spark, sf_dir, "nation").select(address(key).alias("url"), key.alias("id"), F.lit("c1").alias("crawl_job_id"), F.col("n_name").alias("title"), F.when(key % 2 == 0, F.lower("n_name")).alias("meta_description"))
    return search.attach_pages(found, pages, sim_issues(spark, sf_dir))


OPPORTUNITY_SQL = f"""WITH {ISSUES}, f AS (SELECT DISTINCT c_custkey % 60 AS k FROM customer),
m AS (SELECT primary_url AS url, count(*) AS n FROM issues WHERE status = 'open' AND (starts_with(rule_id, 'onpage.title_') OR starts_with(rule_id, 'onpage.meta_description_')) GROUP BY 1)
SELECT CASE WHEN k % 3 = 0 THEN 'HTTPS://Example.org:443/x/../' || k || '#top' ELSE 'https://example.org/' || k END AS page, CASE WHEN n_nationkey IS NOT NULL THEN 'c1' END AS crawl_id, n_nationkey AS page_id, n_name AS title,
CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) END AS meta_description, CASE WHEN n_nationkey IS NULL THEN 0 ELSE coalesce(n, 0) END::BIGINT AS metadata_issues FROM f LEFT JOIN nation ON k = n_nationkey LEFT JOIN m ON m.url = 'https://example.org/' || n_nationkey"""


def score_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category scores of two crawls side by side; a category may be in one only."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), "o_orderstatus", (F.col("o_orderkey") % 1009).alias("n"))
    own = lambda status, out: rows.where((F.col("o_orderstatus") == status) & ~F.startswith("category", F.lit(out))).groupBy("category").agg((F.sum("n") % 1009 / 16.0).alias("score"))
    return compare.score_changes(own("O", "1"), own("F", "2"))


_SCORE = "SELECT o_orderpriority AS category, sum(o_orderkey % 1009) % 1009 / 16.0::DOUBLE AS score FROM orders WHERE o_orderstatus = '{}' AND o_orderpriority NOT LIKE '{}%' GROUP BY 1"
SCORES_SQL = f"""WITH a AS ({_SCORE.format('O', '1')}), b AS ({_SCORE.format('F', '2')}), d AS (SELECT coalesce(a.category, b.category) AS category, a.score AS before, b.score AS after, b.score - a.score AS diff FROM a FULL JOIN b ON a.category = b.category)
SELECT category, before, after, CASE WHEN diff < 0 THEN -floor(-diff * 10 + 0.5) / 10 ELSE floor(diff * 10 + 0.5) / 10 END AS change FROM d"""


def links_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages marked as orphans, with their inlinks counted from links."""
    pages = context.count_inlinks(sim_pages(spark, sf_dir).drop("is_orphan"), sim_links(spark, sf_dir))
    return context.mark_orphans(pages, "https://example.org/").select("id", "inlinks_count", "is_orphan")


ORPHANS_SQL = f"""WITH {SIM_CTX}, links AS (SELECT concat('p', l_suppkey % n) AS s, concat('p', l_partkey % n) AS t FROM lineitem CROSS JOIN (SELECT count(*) AS n FROM pages) WHERE l_returnflag <> 'R'),
k AS (SELECT t, count(DISTINCT s) AS n FROM links WHERE s <> t GROUP BY t)
SELECT id, coalesce(n, 0)::INT AS inlinks_count, in_sitemap AND coalesce(n, 0) = 0 AND url <> 'https://example.org/' AND fetch_status IN ('fetched', 'not_modified') AS is_orphan FROM ctx LEFT JOIN k ON id = t"""

QUERIES = {
    "jsonld_requirements": jsonld_requirements,
    "sim_schema_rules": sim_schema_rules,
    "resolved_links": resolved_links,
    "page_groups": page_groups,
    "opportunity_pages": opportunity_pages,
    "score_changes": score_changes,
    "orphan_pages": links_by_page,
}
SQL = {
    "jsonld_requirements": REQUIREMENTS_SQL,
    "sim_schema_rules": SCHEMA_SQL,
    "resolved_links": RESOLVED_SQL,
    "page_groups": GROUPS_SQL,
    "opportunity_pages": OPPORTUNITY_SQL,
    "score_changes": SCORES_SQL,
    "orphan_pages": ORPHANS_SQL,
}
