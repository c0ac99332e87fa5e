"""Queries on texts: content rules, fingerprints, questions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answers, duplicates, linking, structured, usage
from ..sources import html
from .base import read


def thin_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("word_count"))
    return rows.where("word_count < 200").withColumn("severity", F.when(F.col("word_count") < 100, "medium").otherwise("low"))


TOKENS = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')"
THIN = f"""WITH w AS (SELECT doc_id, len({TOKENS})::INT AS word_count FROM documents) SELECT doc_id, word_count, CASE WHEN word_count < 100 THEN 'medium' ELSE 'low' END AS severity FROM w WHERE word_count < 200"""


def content_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").groupBy(text.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    return rows.where("docs > 1")


DUPLICATE = "SELECT sha256(lower(text)) AS content_hash, count(*) AS docs, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1 HAVING count(*) > 1"


def dated_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.old_years(F.concat_ws(" ", F.col("text"), (F.col("doc_id") + 1900).cast("string")), F.lit(2025)), ",").alias("years"))
    return rows.where("years <> ''")


DATED = r"""WITH y AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text || ' ' || (doc_id + 1900), '\b(19[5-9]\d|20\d\d)\b', 1), lambda x: x::INT), lambda x: x < 2025))) AS y FROM documents) SELECT doc_id, array_to_string(y, ',') AS years FROM y WHERE len(y) > 0"""


def simhash_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.md5_simhash(read(spark, sf_dir, "documents"), "doc_id", "text")


SHINGLES = f"""w AS MATERIALIZED (SELECT doc_id, list_transform({TOKENS}, lambda x: lower(x)) AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 15),
v AS MATERIALIZED (SELECT doc_id, ('0x' || substr(md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), 1, 15))::BIGINT AS v FROM s),
h AS MATERIALIZED (SELECT doc_id, {" + ".join(f"CASE WHEN 2 * sum((v >> {b}) & 1) > count(*) THEN {1 << b}::BIGINT ELSE 0 END" for b in range(60))} AS simhash FROM v GROUP BY doc_id)"""


def near_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.md5_simhash(read(spark, sf_dir, "documents"), "doc_id", "text")
    return duplicates.near_pairs(rows, "doc_id", "simhash", bits=60)


NEAR = f"WITH {SHINGLES} SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.simhash, y.simhash))::INT AS distance FROM h x JOIN h y ON x.doc_id < y.doc_id WHERE bit_count(xor(x.simhash, y.simhash)) <= 3"


def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.md5_simhash(read(spark, sf_dir, "documents"), "doc_id", "text")
    found = duplicates.near_groups(rows, "doc_id", "simhash", bits=60)
    return found.select("label", F.col("k").alias("doc_id"), F.col("n").alias("members"))


NEAR_GROUPS = f"""WITH RECURSIVE {SHINGLES}, p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM h x JOIN h y ON x.doc_id <> y.doc_id WHERE bit_count(xor(x.simhash, y.simhash)) <= 3),
r(node, seen) AS (SELECT DISTINCT a, a FROM p UNION SELECT p.b, r.seen FROM r JOIN p ON p.a = r.node), l AS (SELECT node, min(seen) AS label FROM r GROUP BY node)
SELECT label, node AS doc_id, count(*) OVER (PARTITION BY label) AS members FROM l"""


def simhash_blake2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.simhash("text").alias("simhash"))


def _pages_of_texts(spark: SparkSession, sf_dir: str, crawl: str, headed: str) -> tuple[DataFrame, DataFrame]:
    """Documents as pages: each is about its first five words, which copies and other texts repeat; where ``headed``, also
    about its next four. Each links to the page after it."""
    words = F.split(F.col("text"), r"\s+", 10)
    head = F.struct(F.lit(1).alias("level"), F.array_join(F.slice(words, 6, 4), " ").alias("text"))
    rows = read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.expr(crawl).alias("crawl_job_id"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("url"),
        F.array_join(F.slice(words, 1, 5), " ").alias("title"),
        F.when(F.expr(headed), F.array(head)).otherwise(F.array().cast("array<struct<level: int, text: string>>")).alias("headings"),
        F.col("text"),
        (F.col("doc_id") % 4).cast("int").alias("inlinks_count"),
        (F.col("doc_id") % 6).cast("int").alias("depth"),
        F.lit(False).alias("is_orphan"),
        (F.col("doc_id") % 23 == 0).alias("important"),
        F.lit(True).alias("indexable"),
    )
    return rows, rows.select(F.col("id").alias("source_id"), (F.col("id") + 1).alias("target_id"))


def link_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of one crawl that name what another page is about."""
    rows, links = _pages_of_texts(spark, sf_dir, "'c'", "false")
    return linking.suggest(rows, links, "https://example.org/0").select("source_url", "target_url", "anchor_text", "relevance")


def link_suggestions_of_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three crawls, one with half of the pages, in one job: the list of each with titles and snippets."""
    rows, links = _pages_of_texts(spark, sf_dir, "CASE WHEN doc_id % 2 = 0 THEN 'c0' ELSE concat('c', doc_id % 3) END", "doc_id % 5 < 2")
    out = linking.listing(linking.suggest(rows, links, "https://example.org/0"), rows)
    return out.select("crawl_job_id", "place", "source_url", "target_url", "source_title", "target_title", "anchor_text", "snippet", "relevance")


def _suggestions(crawl: str, headed: str, columns: str) -> str:
    """Every phrase against every text of its crawl, by its letters and then by its borders."""
    words = r"regexp_split_to_array(text, '[ \t\n\x0B\f\r]+')"
    return rf"""WITH p AS MATERIALIZED (SELECT doc_id AS id, {crawl} AS c, 'https://example.org/' || doc_id AS url, text AS t, lower(text) AS low, array_to_string({words}[1:5], ' ') AS title,
    CASE WHEN {headed} THEN array_to_string({words}[6:9], ' ') END AS head, doc_id % 4 AS n, doc_id % 6 AS d, doc_id % 23 = 0 AS important FROM documents WHERE text IS NOT NULL),
a AS (SELECT id, c, url, important, n, unnest([{{'no': 0, 'p': head}}, {{'no': 1, 'p': title}}], recursive := true) FROM p WHERE doc_id_is_target),
b AS MATERIALIZED (SELECT id, c, url, important, n, min(no) AS no, p FROM (SELECT id, c, url, important, n, no, lower(trim(regexp_replace(p, '\s+', ' ', 'g'))) AS p FROM a WHERE p IS NOT NULL) WHERE length(p) >= 8 AND len(regexp_extract_all(p, '[\p{{L}}\p{{N}}_]+')) >= 2 GROUP BY ALL),
f AS MATERIALIZED (SELECT DISTINCT c, p FROM b),
h AS MATERIALIZED (SELECT f.c, f.p, p.id AS sid, string_split(p.low, f.p) AS parts FROM f JOIN p ON p.c = f.c AND contains(p.low, f.p)),
i AS (SELECT c, p, sid, parts, list_filter(range(1, len(parts)), lambda i: NOT regexp_matches(CASE WHEN parts[i] <> '' THEN right(parts[i], 1) WHEN i > 1 THEN right(p, 1) ELSE '' END || CASE WHEN parts[i + 1] <> '' THEN left(parts[i + 1], 1) WHEN i + 1 < len(parts) THEN left(p, 1) ELSE '' END, '[\p{{L}}\p{{N}}_]'))[1] AS i FROM h),
g AS (SELECT c, p, sid, list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT + (i - 1) * length(p) + 1 AS s, s + length(p) - 1 AS e FROM i WHERE i IS NOT NULL),
k AS (SELECT b.c, b.url, b.no, b.p, b.important, g.sid, g.s, g.e, p.url AS surl, p.d, p.n AS sn, p.t, row_number() OVER (PARTITION BY b.id, g.sid ORDER BY b.no) AS k FROM b JOIN g ON b.c = g.c AND b.p = g.p JOIN p ON p.id = g.sid WHERE g.sid <> b.id AND b.id <> g.sid + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY no, d, sn DESC, surl) AS r FROM k WHERE k = 1),
v AS (SELECT *, floor((least(1.0, len(regexp_extract_all(p, '[\p{{L}}\p{{N}}_]+')) / 6.0)::DOUBLE * 0.8::DOUBLE + CASE WHEN important THEN 0.2 ELSE 0 END::DOUBLE) * 100 + 0.5) / 100 AS relevance FROM r WHERE r <= 3),
o AS (SELECT c AS crawl_job_id, surl AS source_url, url AS target_url, t[s:e] AS anchor_text, CASE WHEN s - 80 > 1 THEN '…' ELSE '' END || trim(t[greatest(s - 80, 1):e + 80]) || CASE WHEN e + 80 < length(t) THEN '…' ELSE '' END AS snippet, relevance,
    row_number() OVER (PARTITION BY c ORDER BY relevance DESC, url, surl) AS place FROM v)
SELECT {columns} FROM o {{titles}} WHERE place <= 500""".replace("doc_id_is_target", "url <> 'https://example.org/0' AND (n <= 1 OR important AND n < 3)")


SUGGESTIONS = _suggestions("'c'", "false", "source_url, target_url, anchor_text, relevance").replace("{titles}", "")
SUGGESTIONS_OF_CRAWLS = _suggestions(
    "CASE WHEN doc_id % 2 = 0 THEN 'c0' ELSE 'c' || (doc_id % 3) END", "doc_id % 5 < 2", "crawl_job_id, place::INT AS place, source_url, target_url, x.title AS source_title, y.title AS target_title, anchor_text, snippet, relevance"
).replace("{titles}", "JOIN p x ON x.url = source_url JOIN p y ON y.url = target_url")


def topic_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("text")
    rows = questions(read(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", F.array_join(answers.topics(q), "; ").alias("topics"), F.array_join(answers.missing_data(q), "; ").alias("missing"), answers.about_priorities(q).alias("priority"))


EXTRA = ("", " any broken links or slow pages?", " which titles and meta descriptions first?", " our traffic against other universities", " duplicate content and redirects, 404")


def questions(rows: DataFrame) -> DataFrame:
    add = F.element_at(F.array(*[F.lit(x) for x in EXTRA]), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    return rows.where("role = 'user'").withColumn("text", F.concat(F.coalesce("text", F.lit("")), add))


QUESTIONS = "q AS MATERIALIZED (SELECT conv_id, turn, coalesce(text, '') || CASE (conv_id + turn) % 5 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(EXTRA)) + " END AS text FROM conversations WHERE role = 'user')"


def _labels(pairs) -> str:
    cases = ", ".join("CASE WHEN regexp_matches(text, '(?i){}') THEN '{}' END".format(p.replace("'", "''"), n) for n, p in pairs)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


CLASSIFY = f"""WITH {QUESTIONS} SELECT conv_id, turn, array_to_string({_labels([(n, p) for n, p, _ in answers.TOPICS])}[1:3], '; ') AS topics, array_to_string({_labels(answers.UNAVAILABLE)}, '; ') AS missing, regexp_matches(text, '(?i){answers.FIRST}') AS priority FROM q"""


def grounding_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and claims of documents, against the numbers of the document before as evidence."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" In "), (F.col("doc_id") % 50).cast("string"), F.lit(".50 of 1,200 clicks, rank 3")).alias("answer"), F.concat((F.col("doc_id") % 20).cast("string"), F.lit(".5 and 1200 or 3")).alias("evidence"))
    out = answers.unsupported(rows)
    return out.select("doc_id", F.array_join("numbers", ",").alias("numbers"), F.array_join("claims", "; ").alias("claims"))


def protected_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    a = F.concat(F.col("text"), F.lit(" The fee is $"), (doc % 90).cast("string"), F.lit(" until 5 May 2026, 20% off; CGPA 3, marks by 12/"), (doc % 12 + 1).cast("string"), F.lit("/2025"))
    b = F.concat(F.replace("text", F.lit("e"), F.lit("7")), F.when(doc % 3 == 0, " Tuition fees are PKR 5,000").otherwise(" The fee is $50"), F.lit(" until May 5, "), (doc % 30).cast("string"), F.lit(" percent off by 2026-01-0"), (doc % 9 + 1).cast("string"), F.when(doc % 4 == 0, "; ranked, not unranked, on merit.").otherwise("; feesible"))
    rows = read(spark, sf_dir, "documents").select("doc_id", a.alias("a"), b.alias("b"))
    p = answers.protected(F.col("a"), F.col("b"))
    return rows.select("doc_id", F.array_join(p["added"], "; ").alias("added"), F.array_join(p["removed"], "; ").alias("removed"), F.array_join(p["mentions"], "; ").alias("mentions"))


def _facts(text: str) -> str:
    found = ", ".join("regexp_extract_all({}, '(?i){}')".format(text, p) for p in answers.FACTS)
    return f"list_sort(list_distinct(list_transform(flatten([{found}]), lambda x: lower(trim(x)))))"


_WORDS = ", ".join(rf"CASE WHEN regexp_matches(b, '(?i)\b{w}\b') THEN '{w}' END" for w in sorted(answers.FACT_WORDS))
PROTECTED = f"""WITH d AS (SELECT doc_id, text || ' The fee is $' || (doc_id % 90) || ' until 5 May 2026, 20% off; CGPA 3, marks by 12/' || (doc_id % 12 + 1) || '/2025' AS a,
replace(text, 'e', '7') || CASE WHEN doc_id % 3 = 0 THEN ' Tuition fees are PKR 5,000' ELSE ' The fee is $50' END || ' until May 5, ' || (doc_id % 30) || ' percent off by 2026-01-0' || (doc_id % 9 + 1) || CASE WHEN doc_id % 4 = 0 THEN '; ranked, not unranked, on merit.' ELSE '; feesible' END AS b FROM documents),
f AS MATERIALIZED (SELECT doc_id, {_facts("a")} AS x, {_facts("b")} AS y, list_filter([{_WORDS}], lambda w: w IS NOT NULL) AS words FROM d)
SELECT doc_id, array_to_string(list_filter(y, lambda v: NOT list_contains(x, v)), '; ') AS added, array_to_string(list_filter(x, lambda v: NOT list_contains(y, v)), '; ') AS removed, array_to_string(words, '; ') AS mentions FROM f"""


def terminology(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", answers.terms_used(F.col("text"), {"the and": "both", "license": "licence"}).alias("w"))
    return rows.where(F.size("w") > 0).select("doc_id", F.array_join("w", "; ").alias("warnings"))


TERMS = """WITH d AS (SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])the and($|[^\\p{L}\\p{N}_])') AS a, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])license($|[^\\p{L}\\p{N}_])') AS b FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN a THEN 'Uses ''the and''; the approved term is ''both''' END, CASE WHEN b THEN 'Uses ''license''; the approved term is ''licence''' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM d WHERE a OR b"""

BLOCKS = (
    '{"@context": "https://schema.org", "@type": "Course", "name": "A"}',
    '{"@graph": [{"@type": "https://schema.org/Event", "name": "E", "startDate": "2026-01-01", "location": {"@type": "Place"}}]}',
    '{"name": "no type"}',
    "{broken",
    '[{"@type": ["Article", "Thing"], "headline": ""}]',
)


def jsonld_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with one of five JSON-LD blocks put into it, parsed and checked."""
    block = F.element_at(F.array(*[F.lit(b) for b in BLOCKS]), (F.col("page_id") % 5 + 1).cast("int"))
    pages = read(spark, sf_dir, "pages").select("url", F.concat("html", F.lit('<script type="application/ld+json">'), block, F.lit("</script>")).alias("html"))
    rows = structured.check_pages(html.parse_pages(pages))
    return rows.select("url", "format", F.array_join("types", ",").alias("types"), "valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


def feedback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), F.col("source").alias("kind"))
    ratings = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_id"), (F.col("quality") == 1).alias("helpful"))
    return usage.feedback(ratings, tasks)


FEEDBACK = "SELECT d.source AS kind, count(*) AS ratings, count(*) FILTER (quality = 1) AS helpful FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1"


def ai_usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(
        k.alias("id"), F.col("o_orderpriority").alias("kind"), F.when(k % 9 == 0, "failed").when(k % 10 == 3, "queued").otherwise("completed").alias("status"), F.col("o_orderdate").alias("created_at"),
        (k % 3).alias("calls"), F.lit(1).cast("bigint").alias("attempts"), (F.col("o_custkey") * 7 % 20000).alias("duration_ms"), (k % 4000).alias("prompt_tokens"), (k % 1500).alias("load_ms"),
    )
    return usage.usage_report(rows)


USAGE = """WITH t AS (SELECT o_orderkey AS id, o_orderpriority AS kind, CASE WHEN o_orderkey % 9 = 0 THEN 'failed' WHEN o_orderkey % 10 = 3 THEN 'queued' ELSE 'completed' END AS status, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 ELSE 1 END AS tries,
o_custkey * 7 % 20000 AS ms, o_orderkey % 4000 AS tokens, o_orderkey % 1500 AS load FROM orders), n AS (SELECT * FROM t WHERE status <> 'queued' ORDER BY created_at DESC, id DESC LIMIT 5000)
SELECT kind, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, floor(avg(tries) * 100 + 0.5) / 100 AS avg_tries, floor(quantile_cont(ms / 1000.0::DOUBLE, 0.5) * 10 + 0.5) / 10 AS median_seconds,
floor(sum(tokens)::DOUBLE / sum(tries)::DOUBLE + 0.5) AS tokens_per_call, count(*) FILTER (load > 1000) AS cold_starts FROM n GROUP BY kind"""


def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 3 == 0, F.array(F.concat(F.lit("Uses numbers that are not in the project data: "), F.col("user_id").cast("string")), F.concat(F.lit("Makes an unsupported claim: kind "), (F.col("event_id") % 4).cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = read(spark, sf_dir, "events").where("event_type = 'error'").select(F.lit("failed").alias("status"), v.alias("violations"), F.concat(F.lit("Timed out after "), (F.col("event_id") % 5).cast("string"), F.lit(" s (try "), F.col("user_id").cast("string"), F.lit(").")).alias("error"))
    return usage.failure_reasons(rows)


REASONS = """WITH r AS (SELECT 'Uses numbers that are not in the project data' AS reason FROM events WHERE event_type = 'error' AND event_id % 3 = 0 UNION ALL SELECT 'Makes an unsupported claim: kind ' || (event_id % 4) FROM events WHERE event_type = 'error' AND event_id % 3 = 0
UNION ALL SELECT 'Timed out after ' || (event_id % 5) || ' s' FROM events WHERE event_type = 'error' AND event_id % 3 <> 0) SELECT reason, count(*) AS tasks FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""


def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    rows = read(spark, sf_dir, "conversations").select((t % 3 > 0).alias("passed"), (t % 5 > 0).alias("completed"), (t % 2 > 0).alias("grounded"), F.length("text").alias("seconds"), F.length("text").alias("prompt_tokens"))
    return usage.evaluation_summary(rows)


EVALUATION = """SELECT count(*) AS cases, count(*) FILTER (turn % 3 > 0) AS passed, count(*) FILTER (turn % 5 > 0) AS completed, count(*) FILTER (turn % 2 > 0) AS grounded, floor(quantile_cont(length(text), 0.5) * 10 + 0.5) / 10 AS median_seconds, floor(avg(length(text)) FILTER (turn % 5 > 0) + 0.5) AS avg_prompt_tokens FROM conversations"""

QUERIES = {
    "thin_content": thin_content,
    "content_duplicate": content_duplicate,
    "dated_reference": dated_reference,
    "simhash_md5": simhash_md5,
    "near_duplicate_pairs": near_duplicate_pairs,
    "near_duplicate_groups": near_duplicate_groups,
    "simhash_blake2b": simhash_blake2b,
    "link_suggestions": link_suggestions,
    "link_suggestions_of_crawls": link_suggestions_of_crawls,
    "topic_classify": topic_classify,
    "grounding_numbers": grounding_numbers,
    "protected_facts": protected_facts,
    "terminology_hits": terminology,
    "jsonld_checks": jsonld_checks,
    "feedback_join": feedback_join,
    "ai_usage_report": ai_usage_report,
    "failure_reasons_topk": failure_reasons,
    "evaluation_summary": evaluation_summary,
}
SQL = {
    "thin_content": THIN,
    "content_duplicate": DUPLICATE,
    "dated_reference": DATED,
    "simhash_md5": f"WITH {SHINGLES} SELECT doc_id, simhash FROM h",
    "near_duplicate_pairs": NEAR,
    "near_duplicate_groups": NEAR_GROUPS,
    "link_suggestions": SUGGESTIONS,
    "link_suggestions_of_crawls": SUGGESTIONS_OF_CRAWLS,
    "topic_classify": CLASSIFY,
    "protected_facts": PROTECTED,
    "terminology_hits": TERMS,
    "feedback_join": FEEDBACK,
    "ai_usage_report": USAGE,
    "failure_reasons_topk": REASONS,
    "evaluation_summary": EVALUATION,
}
