"""Queries on projects, members, plans, drafts and further rules and scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import answers, history, lifecycle, linking, records, reports, rules, search, tools, usage
from ..plans.settings import ContentType, Settings
from ..sources import robots
from ..streaming import limits
from .base import DAYS, ISSUES, LINKS, ROOT, SIM_CTX, SIM_PAGES, job, read, sim_context, sim_days, sim_issues, sim_links, sim_pages
from .issues import CRAWLS, crawls
from .textual import QUESTIONS, questions

NOW = "TIMESTAMP '1998-01-15 12:00:00'"


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lower("c_mktsegment"), F.lit(".example.org")).alias("domain"), F.when(F.col("c_custkey") % 10 == 0, "1998-01-01").alias("deleted_at"))


PROJECTS = "projects AS MATERIALIZED (SELECT c_custkey AS id, c_name AS name, lower(c_mktsegment) || '.example.org' AS domain, CASE WHEN c_custkey % 10 = 0 THEN '1998-01-01' END AS deleted_at FROM customer)"


def project_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.list_projects(_projects(spark, sf_dir), q="Build", sort="domain", descending=True, number=2, size=10).select("id", "name", "domain")


def crawl_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.list_crawls(crawls(spark, sf_dir), _projects(spark, sf_dir), status="completed", analysed=True, size=50).select("id", "project_id", "project_name")


def analysis_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("subject_id"), F.col("ts").alias("created_at"), F.to_json(F.struct(F.get_json_object("props", "$.k").alias("page_url"))).alias("params"))
    return records.list_analyses(rows, kind="click", page_url="7").select("id", "kind")


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = read(spark, sf_dir, "supplier")
    members = s.select(F.col("s_nationkey").alias("organisation_id"), (F.col("s_suppkey") % 7).alias("user_id"), F.when(F.col("s_suppkey") % 3 == 0, "owner").otherwise("editor").alias("role")).distinct()
    users = s.where("s_suppkey < 7").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("full_name"))
    orgs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 4 != 0).alias("is_active"))
    return members, users, orgs


MEMBERS = "members AS MATERIALIZED (SELECT DISTINCT s_nationkey AS organisation_id, s_suppkey % 7 AS user_id, CASE WHEN s_suppkey % 3 = 0 THEN 'owner' ELSE 'editor' END AS role FROM supplier)"


def organisations_for_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _, orgs = _members(spark, sf_dir)
    return records.organisations_of(orgs, members, 3).select("id", "name", "role")


def member_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, users, _ = _members(spark, sf_dir)
    return records.members_of(members, users, 1).select("user_id", "full_name", "role")


def owner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.owners(_members(spark, sf_dir)[0])


def pending_invitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    rows = read(spark, sf_dir, "orders").select(k.alias("id"), at.alias("created_at"), F.when(k % 3 == 0, at).alias("accepted_at"), F.when(k % 5 == 0, at).alias("revoked_at"), (at + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))
    return records.pending_invitations(rows, F.expr(NOW)).select("id")


def connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    integrations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))
    syncs = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 25).cast("int").alias("integration_id"), F.when(F.col("o_orderkey") % 4 > 0, "succeeded").otherwise("failed").alias("status"), F.col("o_orderdate").alias("finished_at"))
    return records.connection_state(integrations, syncs).select("connected", F.date_format("last_synced_at", "yyyy-MM-dd HH:mm:ss").alias("last_synced_at"))


def plan_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), (F.col("r_regionkey") == 2).alias("is_default"), (F.col("r_regionkey") * 10).alias("crawls_per_month"))
    orgs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("organisation_id"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_regionkey")).alias("plan_id"))
    return records.plan_limits(orgs, plans)


def start_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"))
    accepted, refused = records.start_crawls(wanted, crawls(spark, sf_dir))
    return accepted.select("project_id", F.coalesce("previous_id", F.lit(-1)).alias("previous_id"), "status").unionByName(refused.select("project_id", F.lit(0).cast("bigint").alias("previous_id"), F.lit("refused").alias("status")))


def cancel_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawls(spark, sf_dir).withColumn("status", F.when(F.col("id") % 7 == 0, "queued").otherwise(F.col("status")))
    return records.cancel(rows, rows.where("project_id % 2 = 0")).groupBy("status").agg(F.count("*").alias("crawls"))


def analysable_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.analysable_crawls(crawls(spark, sf_dir)).select("project_id", "id")


def revoked_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("token"), F.col("l_orderkey").alias("family_id"), (F.col("l_linestatus") == "F").alias("revoked"), "l_returnflag")
    out = records.revoked_families(rows.drop("l_returnflag"), rows.where("l_returnflag = 'R'").select("token").distinct())
    return out.groupBy("family_id").agg(F.count_if("revoked").alias("revoked"), F.count("*").alias("tokens"))


def search_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = records.search_preview(F.col("text"), F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.col("text")).select("doc_id", shown["title"].alias("title"), F.length(shown["description"]).alias("description_chars"))


PREVIEW = """SELECT doc_id, CASE WHEN length(text) > 60 THEN rtrim(left(text, 59), ' ') || '…' ELSE text END AS title, (CASE WHEN length(text) > 158 THEN length(rtrim(left(text, 157), ' ')) + 1 ELSE length(text) END)::INT AS description_chars FROM documents"""


def refs_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = reports.action_plan(sim_issues(spark, sf_dir), 100)
    refs = reports.references(plan, [F.col("section"), F.col("rank")])
    texts = plan.select(F.concat("section", "rank").alias("id"), F.concat(F.lit("See "), F.col("issue_key"), F.lit(", then i0.")).alias("text"))
    return records.with_refs(texts, refs)


REF_TEXTS = f"""WITH {ISSUES}, o AS (SELECT * FROM issues WHERE status = 'open' AND severity <> 'informational'), a AS (SELECT issue_key FROM o WHERE severity IN ('critical', 'high') ORDER BY priority DESC, issue_key LIMIT 100),
b AS (SELECT issue_key FROM o WHERE effort = 'low' AND issue_key NOT IN (SELECT issue_key FROM a) ORDER BY priority DESC, issue_key LIMIT 100), c AS (SELECT issue_key FROM o WHERE issue_key NOT IN (SELECT issue_key FROM a) AND issue_key NOT IN (SELECT issue_key FROM b) ORDER BY priority DESC, issue_key LIMIT 100),
u AS (SELECT 'fix_first' AS s, 0 AS k, issue_key FROM a UNION ALL SELECT 'quick_wins', 2, issue_key FROM b UNION ALL SELECT 'plan_next', 1, issue_key FROM c), p AS (SELECT u.*, priority FROM u JOIN issues USING (issue_key)),
r AS (SELECT s, issue_key, row_number() OVER (PARTITION BY s ORDER BY priority DESC, issue_key) AS rank, row_number() OVER (ORDER BY k, priority DESC, issue_key) AS n FROM p),
l AS (SELECT *, 'issue-' || CASE WHEN n > 26 THEN chr((96 + (n - 1) // 26)::INT) ELSE '' END || chr((97 + (n - 1) % 26)::INT) AS ref FROM r)
SELECT s || rank AS id, 'See ' || ref || ', then ' || coalesce((SELECT ref FROM l WHERE issue_key = 'i0'), 'i0') || '.' AS text FROM l"""


def issue_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sim_issues(spark, sf_dir)
    asked = rows.where("page_no < 9").select("issue_key", F.when(F.col("page_no") % 2 == 0, "ignored").otherwise("open").alias("status"))
    return lifecycle.triage(rows, asked).groupBy("status").agg(F.count("*").alias("issues"))


def current_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("draft_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("to_status"))
    return lifecycle.current_drafts(log)


def draft_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    made = rows.select((F.col("l_orderkey") % 100).alias("draft_id"), F.when(F.col("l_suppkey") % 5 > 0, F.col("l_suppkey")).alias("user_id"))
    edits = rows.select((F.col("l_orderkey") % 100).alias("draft_id"), (F.col("l_partkey") % 10).alias("user_id"))
    return lifecycle.contributors(made, edits)


def latest_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("task_id"), (F.col("o_orderkey") % 3).alias("user_id"), F.struct("o_orderdate", "o_orderkey").alias("created_at"), F.col("o_orderstatus").alias("rating"))
    return usage.latest_feedback(rows.where("task_id % 2 = 0"), rows.where("task_id % 2 = 1")).select("task_id", "user_id", "rating")


def heading_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by their size as a list of heading levels."""
    levels = F.array(*[(F.floor(F.col("p_size") / k) % 4 + 1).cast("int") for k in (1, 3, 7, 11)])
    heads = F.transform(levels, lambda x: F.struct(x.alias("level"), F.lit("t").alias("text")))
    rows = read(spark, sf_dir, "part").select("p_partkey", heads.alias("h")).select("p_partkey", F.array_join(text.heading_jumps(F.col("h")), "; ").alias("jumps"), F.coalesce(text.first_h1(F.col("h")), F.lit("none")).alias("h1"))
    return rows.where("jumps <> ''")


HEADINGS = """WITH l AS (SELECT p_partkey, [p_size % 4 + 1, p_size // 3 % 4 + 1, p_size // 7 % 4 + 1, p_size // 11 % 4 + 1] AS l FROM part),
j AS (SELECT p_partkey, array_to_string(list_filter([CASE WHEN l[i + 1] > l[i] + 1 THEN 'H' || l[i] || ' → H' || l[i + 1] || ': t' END FOR i IN [1, 2, 3]], lambda x: x IS NOT NULL), '; ') AS jumps, CASE WHEN list_contains(l, 1) THEN 't' ELSE 'none' END AS h1 FROM l) SELECT * FROM j WHERE jumps <> ''"""


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", urls.slug(F.concat("p_name", F.lit(" & "), "p_type", F.lit("!"))).alias("slug"))


def url_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", F.col("url"), F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.host(F.col("url")), F.lit("/en")).alias("source"))
    return rows.select("page_id", urls.under(F.col("url"), F.col("source")).alias("inside"))


def insecure_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.insecure(sim_context(spark, sf_dir)).select("rule_id", "severity", "affected_page_count", "subject")


def job_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = sim_context(spark, sf_dir)
    ctx.job = job(spark, robots="unreachable")
    return rules.job_rules(ctx).select("rule_id", "severity", "affected_page_count")


JOB_RULES = """WITH n AS (SELECT count(*)::INT AS affected_page_count FROM pages) SELECT rule_id, severity, affected_page_count FROM (VALUES ('tech.sitemap_missing', 'medium'), ('tech.sitemap_errors', 'medium'), ('tech.robots_unreachable', 'critical')) v(rule_id, severity), n"""


def variant_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = sim_context(spark, sf_dir)
    ctx.pages = ctx.pages.withColumn("content_hash", F.lit("same")).withColumn("url", F.regexp_replace("url", "[0-9]+", "1"))
    return rules.url_variants(ctx).select("subject", "affected_page_count")


VARIANTS = f"""WITH {SIM_CTX}, v AS (SELECT DISTINCT regexp_replace(url, '[0-9]+', '1', 'g') AS url FROM ctx WHERE indexable),
k AS (SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) || coalesce(nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)), '/+$', ''), ''), '/') AS key FROM v)
SELECT substr(sha256(key), 1, 16) AS subject, count(*)::INT AS affected_page_count FROM k GROUP BY key HAVING count(*) > 1"""

TYPES = Settings(root_url=ROOT, content_types=(ContentType("lesson", "Lesson", ("/en/*",), ("Heading 2", "Fees"), ("Course",)), ContentType("item", "Item", ("/*/1*",), ("heading 3",))))


def missing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.missing_sections(sim_context(spark, sf_dir, TYPES))
    return rows.select(F.col("affected_urls")[0].alias("url"), "subject", F.get_json_object("evidence", "$.missing_sections").alias("missing"))


PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
SECTIONS = f"""WITH {SIM_CTX}, p AS (SELECT *, {PATH} AS path FROM ctx WHERE analysable) SELECT url, substr(sha256(url || chr(31) || 'lesson'), 1, 16) AS subject, CASE WHEN skips_level THEN '["Heading 2","Fees"]' ELSE '["Fees"]' END AS missing FROM p WHERE starts_with(path, '/en/')"""


def page_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, pages = sim_links(spark, sf_dir).withColumn("anchor_text", F.lit("")), sim_pages(spark, sf_dir)
    out = linking.outlinks(links, pages, F.lit("p3")).select(F.lit("out").alias("kind"), F.col("target_url").alias("url"), F.coalesce("status_code", F.lit(0)).alias("status_code"))
    return out.unionByName(linking.inlinks(links, pages, F.lit("p3")).select(F.lit("in").alias("kind"), F.col("source_url").alias("url"), F.lit(0).alias("status_code")))


DETAIL = f"""WITH {SIM_PAGES}, {LINKS} (SELECT 'out' AS kind, l.target_url AS url, coalesce(t.status_code, 0)::INT AS status_code FROM links l LEFT JOIN sim t ON l.target_id = t.id WHERE l.source_id = 'p3' ORDER BY l.target_url LIMIT 500)
UNION ALL (SELECT 'in', s.url, 0 FROM links l JOIN sim s ON l.source_id = s.id WHERE l.target_id = 'p3' ORDER BY s.url LIMIT 500)"""


def rank_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.previous_rank(sim_days(spark, sf_dir), "page")
    return rows.select(F.col("day").cast("string").alias("day"), "page", "rank", F.coalesce("before", F.lit(0)).alias("before"))


RANKS = f"""WITH {DAYS}, r AS (SELECT day, page, (row_number() OVER (PARTITION BY day ORDER BY clicks DESC, page))::INT AS rank FROM days) SELECT day::VARCHAR AS day, page, rank, coalesce(lag(rank) OVER (PARTITION BY page ORDER BY day), 0)::INT AS before FROM r"""


def report_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = crawls(spark, sf_dir).select("id", "overall", (F.col("overall") + F.col("id") % 3 - 1).alias("before"), (F.col("id") % 3).alias("critical"), (F.col("id") % 5).alias("open"))
    said = reports.summary_sentences(F.col("overall").cast("decimal(6,1)"), F.col("before").cast("decimal(6,1)"), F.col("critical"), F.col("open"))
    return rows.select("id", F.array_join(said, " ").alias("summary"))


SENTENCES = f"""WITH {CRAWLS}, s AS (SELECT id, overall::DECIMAL(6,1) AS o, (overall + id % 3 - 1)::DECIMAL(6,1) AS b, id % 3 AS c, id % 5 AS n FROM crawls)
SELECT id, 'The overall score is ' || o || ' of 100' || CASE WHEN o > b THEN ', up from ' || b || '.' WHEN o < b THEN ', down from ' || b || '.' ELSE ', unchanged.' END || ' ' || n || CASE WHEN n = 1 THEN ' issue' ELSE ' issues' END || ' open, ' || c || CASE WHEN c = 1 THEN ' critical one.' ELSE ' critical ones.' END AS summary FROM s"""


def duplicate_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.duplicate_groups(sim_pages(spark, sf_dir))
    return rows.select("content_hash", F.array_join("urls", " ").alias("urls"))


DUPLICATES = f"""WITH {SIM_PAGES} SELECT content_hash, string_agg(url, ' ' ORDER BY url) AS urls FROM sim WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1 ORDER BY content_hash LIMIT 50"""


def question_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(read(spark, sf_dir, "conversations")).select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"))
    return tools.evidence_for(asked, sim_issues(spark, sf_dir)).groupBy("topic", "issue_key", "rank").agg(F.count("*").alias("questions"))


def _evidence_sql() -> str:
    pairs = ", ".join(f"('{t}', '{x}')" for t, _, ps in answers.TOPICS for x in ps)
    labels = ", ".join("CASE WHEN regexp_matches(text, '(?i){}') THEN '{}' END".format(p.replace("'", "''"), n) for n, p, _ in answers.TOPICS)
    return f"""WITH {ISSUES}, {QUESTIONS}, dim(topic, prefix) AS (VALUES {pairs}), t AS (SELECT unnest(list_filter([{labels}], lambda x: x IS NOT NULL)[1:3]) AS topic FROM q),
r AS (SELECT topic, issue_key, row_number() OVER (PARTITION BY topic ORDER BY priority DESC, issue_key)::INT AS rank FROM issues JOIN dim ON starts_with(rule_id, prefix) WHERE status = 'open')
SELECT r.topic, issue_key, rank, count(*) AS questions FROM t JOIN r ON t.topic = r.topic WHERE rank <= 8 GROUP BY 1, 2, 3"""


def robots_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("User-agent: *\nCrawl-delay: "), (F.col("n_nationkey") * 2).cast("string"), F.lit("\n\nUser-agent: auditor\nUser-agent: b\nCrawl-delay: "), F.col("n_nationkey").cast("string"), F.lit("\nDisallow: /x # all\n"))
    files = read(spark, sf_dir, "nation").select(F.col("n_name").alias("host"), body.alias("body"))
    return robots.crawl_delay(robots.parse_rules(files), "Auditor/1.0")


def due_syncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    integrations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))
    syncs = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 25).cast("int").alias("integration_id"), F.when(F.col("c_custkey") % 50 == 6, "queued").otherwise("done").alias("status"), (F.expr(NOW) - F.make_dt_interval(F.lit(0), (F.col("c_custkey") % 25).cast("int") + 10)).alias("created_at"))
    return limits.due_syncs(integrations, syncs, F.expr(NOW)).select("id")


DUE = f"""WITH s AS (SELECT c_custkey % 25 AS i FROM customer WHERE c_custkey % 50 = 6 OR {NOW} - to_hours((c_custkey % 25 + 10)::INT) > {NOW} - INTERVAL 20 HOUR) SELECT n_nationkey AS id FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey NOT IN (SELECT i FROM s)"""

QUERIES = {
    "project_listing": project_listing,
    "crawl_listing": crawl_listing,
    "analysis_listing": analysis_listing,
    "organisations_for_user": organisations_for_user,
    "member_listing": member_listing,
    "owner_counts": owner_counts,
    "pending_invitations": pending_invitations,
    "connection_state": connection,
    "plan_limits": plan_limits,
    "start_crawls": start_crawls,
    "cancel_crawls": cancel_crawls,
    "analysable_crawls": analysable_crawls,
    "revoked_families": revoked_families,
    "search_preview": search_preview,
    "refs_in_texts": refs_in_texts,
    "issue_triage": issue_triage,
    "current_drafts": current_drafts,
    "draft_contributors": draft_contributors,
    "latest_feedback": latest_feedback,
    "heading_hierarchy": heading_hierarchy,
    "slugs": slugs,
    "url_under": url_under,
    "sim_insecure_pages": insecure_pages,
    "sim_job_rules": job_rules,
    "sim_url_variants": variant_rule,
    "sim_missing_sections": missing_sections,
    "page_detail_links": page_detail,
    "search_rank_changes": rank_changes,
    "report_sentences": report_sentences,
    "duplicate_listing": duplicate_listing,
    "question_evidence": question_evidence,
    "robots_crawl_delay": robots_delay,
    "due_syncs": due_syncs,
}
SQL = {
    "project_listing": f"WITH {PROJECTS} SELECT id, name, domain FROM projects WHERE deleted_at IS NULL AND (name ILIKE '%build%' OR domain ILIKE '%build%') ORDER BY domain DESC, id LIMIT 10 OFFSET 10",
    "crawl_listing": f"WITH {PROJECTS}, {CRAWLS} SELECT c.id, project_id, name AS project_name FROM crawls c JOIN projects p ON c.project_id = p.id WHERE deleted_at IS NULL AND status = 'completed' AND analysis_status = 'completed' ORDER BY created_at DESC, c.id DESC LIMIT 50",
    "analysis_listing": "SELECT event_id AS id, event_type AS kind FROM events WHERE event_type = 'click' AND json_extract_string(props, '$.k') = '7' ORDER BY ts DESC, event_id DESC LIMIT 25",
    "organisations_for_user": f"WITH {MEMBERS} SELECT n_nationkey AS id, n_name AS name, role FROM nation JOIN members ON organisation_id = n_nationkey WHERE user_id = 3 AND n_nationkey % 4 <> 0",
    "member_listing": f"WITH {MEMBERS} SELECT user_id, s_name AS full_name, role FROM members JOIN supplier ON s_suppkey = user_id WHERE organisation_id = 1 AND s_suppkey < 7",
    "owner_counts": f"WITH {MEMBERS} SELECT organisation_id, count(*) AS owners FROM members WHERE role = 'owner' GROUP BY 1",
    "pending_invitations": f"SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderdate + INTERVAL 30 DAY > {NOW}",
    "connection_state": "SELECT true AS connected, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_synced_at FROM orders WHERE o_orderkey % 4 > 0 AND (o_custkey % 25) % 2 = 0",
    "plan_limits": "SELECT n_nationkey AS organisation_id, r_name AS plan, (r_regionkey * 10)::INT AS crawls_per_month FROM nation JOIN region ON r_regionkey = CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey ELSE 2 END",
    "start_crawls": f"WITH {CRAWLS}, w AS (SELECT c_custkey AS project_id FROM customer), a AS (SELECT DISTINCT project_id FROM crawls WHERE status = 'running'), l AS (SELECT project_id, arg_max(id, (created_at, id)) AS p FROM crawls WHERE status = 'completed' GROUP BY 1) SELECT w.project_id, CASE WHEN a.project_id IS NOT NULL THEN 0 ELSE coalesce(p, -1) END AS previous_id, CASE WHEN a.project_id IS NULL THEN 'queued' ELSE 'refused' END AS status FROM w LEFT JOIN a ON w.project_id = a.project_id LEFT JOIN l ON w.project_id = l.project_id",
    "cancel_crawls": f"WITH {CRAWLS}, s AS (SELECT CASE WHEN id % 7 = 0 THEN 'queued' ELSE status END AS status, project_id FROM crawls) SELECT CASE WHEN project_id % 2 = 0 AND status = 'queued' THEN 'cancelled' WHEN project_id % 2 = 0 AND status = 'running' THEN 'cancelling' ELSE status END AS status, count(*) AS crawls FROM s GROUP BY 1",
    "analysable_crawls": f"WITH {CRAWLS}, k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS k FROM crawls WHERE status = 'completed') SELECT project_id, id FROM k WHERE k = 1 AND analysis_status <> 'queued'",
    "revoked_families": "WITH b AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F') SELECT l.l_orderkey AS family_id, count(*) FILTER (l_linestatus = 'F' OR b.l_orderkey IS NOT NULL) AS revoked, count(*) AS tokens FROM lineitem l LEFT JOIN b ON l.l_orderkey = b.l_orderkey GROUP BY 1",
    "search_preview": PREVIEW,
    "refs_in_texts": REF_TEXTS,
    "issue_triage": f"WITH {ISSUES} SELECT CASE WHEN status IN ('open', 'ignored') AND page_no < 9 THEN CASE WHEN page_no % 2 = 0 THEN 'ignored' ELSE 'open' END ELSE status END AS status, count(*) AS issues FROM issues GROUP BY 1",
    "current_drafts": "SELECT o_custkey AS draft_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status, count(*) AS steps FROM orders GROUP BY 1",
    "draft_contributors": "SELECT DISTINCT l_orderkey % 100 AS draft_id, l_suppkey AS user_id FROM lineitem WHERE l_suppkey % 5 > 0 UNION SELECT l_orderkey % 100, l_partkey % 10 FROM lineitem",
    "latest_feedback": "SELECT o_custkey % 200 AS task_id, o_orderkey % 3 AS user_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS rating FROM orders GROUP BY 1, 2",
    "heading_hierarchy": HEADINGS,
    "slugs": "SELECT p_partkey, left(trim(regexp_replace(lower(p_name || ' & ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '-'), 60) AS slug FROM part",
    "url_under": f"SELECT page_id, url LIKE 'https://%' AND ({PATH} = '/en' OR starts_with({PATH}, '/en/')) AS inside FROM pages",
    "sim_insecure_pages": f"WITH {SIM_CTX} SELECT 'tech.http_not_https' AS rule_id, 'medium' AS severity, count(DISTINCT url)::INT AS affected_page_count, substr(sha256('http'), 1, 16) AS subject FROM ctx WHERE starts_with(url, 'http://') AND status_code IS NOT NULL",
    "sim_job_rules": JOB_RULES,
    "sim_url_variants": VARIANTS,
    "sim_missing_sections": SECTIONS,
    "page_detail_links": DETAIL,
    "search_rank_changes": RANKS,
    "report_sentences": SENTENCES,
    "duplicate_listing": DUPLICATES,
    "question_evidence": _evidence_sql(),
    "robots_crawl_delay": "SELECT n_name AS host, least(n_nationkey, 30)::DOUBLE AS crawl_delay FROM nation",
    "due_syncs": DUE,
}
