"""Queries on answers and their evidence, with SQL that takes JSON apart by DuckDB's own walker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers, grounding
from .base import read
from .textual import QUESTIONS, _labels, questions

#: What is added to a text, by doc_id % 6.
ADDED = (
    " In all 1,200 clicks. More will come.",
    " It holds position 3.5\nand could gain 7.",
    " This will bring 1200 clicks. Done.",
    " Results are guaranteed; 40 pages of 2.50",
    "\n1. Add titles.\n2) See 0b7c1e7e-8a55-4c55-9a55-1f2b3c4d5e6f",
    " The search volume is high, rank 9 and 1.5x",
)
OUTPUT = """to_json(named_struct('answer', concat(coalesce(text, ''), added), 'findings', array(named_struct('statement', concat(CAST(doc_id % 30 AS STRING), ' pages'), 'issue_ids', array(concat('i', CAST(doc_id % 5 AS STRING)), 'i9')),
    named_struct('statement', 'none', 'issue_ids', array('i1'))), 'issue_ids', array(concat('i', CAST(doc_id % 3 AS STRING)))))"""
EVIDENCE = """concat('{"issues": [{"id": "i1", "rule_id": "r", "count": ', doc_id % 20, ', "priority": 71.50}, {"id": "i', doc_id % 4, '", "rule_id": "q"}], "pages": [{"id": "i9"}], "score": {"overall": 64.0, "whole": true}',
    CASE WHEN doc_id % 2 = 0 THEN ', "more": [{"search_performance": {"clicks": 1200, "position": "3.5 or 1"}}]' ELSE '' END, '}')"""


def answer_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers in nested JSON, each with evidence of issues, and half of them with search figures."""
    rows = read(spark, sf_dir, "documents").withColumn("added", F.element_at(F.array(*[F.lit(a) for a in ADDED]), (F.col("doc_id") % 6 + 1).cast("int")))
    rows = rows.selectExpr("doc_id", f"{OUTPUT} AS output", f"{EVIDENCE} AS evidence")
    return grounding.check(rows, "doc_id").select("doc_id", F.array_join("violations", "; ").alias("violations"), "passed")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _numbers(text: str) -> str:
    """Without look-behind: everything but letters, digits, points and commas is doubled, so that each match has its own neighbours."""
    bare = rf"regexp_replace({text}, '(?i)\b[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}\b', ' ', 'g')"
    bare = rf"regexp_replace(regexp_replace({bare}, '(?m)^\s*\d{{1,2}}[.)]\s+', ' ', 'g'), '([^\w.,])', '\1\1', 'g')"
    plain = "CASE WHEN contains(n, '.') THEN coalesce(nullif(rtrim(rtrim(replace(n, ',', ''), '0'), '.'), ''), '0') ELSE replace(n, ',', '') END"
    return rf"list_sort(list_distinct(list_transform(regexp_extract_all({bare}, '(?:^|[^\w.])(\d+(?:[.,]\d+)*)(?:\W|$)', 1), lambda n: {plain})))"


def _claim(pattern: str, name: str) -> str:
    hit = f"regexp_matches(t, '(?i){pattern}')"
    if name in grounding.REPORTED:
        part = lambda k: f"regexp_extract(t, '(?is)^(.*?)({pattern})(.*)$', {k})"
        around = rf"regexp_replace({part(1)}, '(?s)^.*(\. |\n)', '') || {part(2)} || regexp_extract({part(3)}, '(?s)^(.*?)(?:\. |\n|\z)', 1)"
        hit += f" AND NOT (search AND list_has_all(allowed, {_numbers(part(2))}) AND NOT regexp_matches({around}, '(?i){grounding.PREDICTS}'))"
    return f"CASE WHEN len(list_filter(texts, lambda t: {hit})) > 0 THEN '{name}' END"


GROUNDING = f"""WITH d AS MATERIALIZED (SELECT doc_id, json_object('answer', coalesce(text, '') || CASE doc_id % 6 {" ".join(f"WHEN {k} THEN {_quoted(a)}" for k, a in enumerate(ADDED))} END,
    'findings', json_array(json_object('statement', (doc_id % 30) || ' pages', 'issue_ids', json_array('i' || (doc_id % 5), 'i9')), json_object('statement', 'none', 'issue_ids', json_array('i1'))), 'issue_ids', json_array('i' || (doc_id % 3))) AS output,
    {EVIDENCE} AS evidence FROM documents),
o AS MATERIALIZED (SELECT doc_id, fullkey, path, key, type, json_extract_string(value, '$') AS s FROM d, json_tree(d.output)),
e AS MATERIALIZED (SELECT doc_id, fullkey, path, key, type, json_extract_string(value, '$') AS s FROM d, json_tree(d.evidence)),
texts AS (SELECT doc_id, list(s) AS texts FROM o WHERE type = 'VARCHAR' AND NOT contains(fullkey, 'issue_ids') GROUP BY doc_id),
cited AS (SELECT doc_id, list(DISTINCT s) AS cited FROM o WHERE path LIKE '%issue_ids' AND type = 'VARCHAR' GROUP BY doc_id),
known AS (SELECT a.doc_id, list(a.s) AS known FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.path = b.path AND a.key = 'id' AND b.key = 'rule_id' GROUP BY a.doc_id),
allowed AS (SELECT doc_id, bool_or(key = '{grounding.SEARCH}') AS search, flatten(list({_numbers("s")}) FILTER (type NOT IN ('OBJECT', 'ARRAY', 'BOOLEAN'))) AS allowed FROM e GROUP BY doc_id),
a AS MATERIALIZED (SELECT * FROM texts JOIN cited USING (doc_id) JOIN known USING (doc_id) JOIN (SELECT doc_id, coalesce(search, false) AS search, allowed FROM allowed) USING (doc_id)),
n AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY length(n), n) AS r FROM (SELECT DISTINCT doc_id, unnest(list_filter(flatten(list_transform(texts, lambda t: {_numbers("t")})), lambda x: NOT list_contains(allowed, x))) AS n FROM a)),
nn AS (SELECT doc_id, string_agg(n, ', ' ORDER BY r) AS n FROM n WHERE r <= 10 GROUP BY doc_id),
v AS (SELECT doc_id, nn.n, list_sort(list_filter(cited, lambda x: NOT list_contains(known, x)))[1:5] AS u, list_filter([{", ".join(_claim(p, n) for p, n in answers.CLAIMS)}], lambda c: c IS NOT NULL) AS c FROM a LEFT JOIN nn USING (doc_id)),
w AS (SELECT doc_id, list_concat(CASE WHEN n IS NULL THEN [] ELSE ['{grounding.NUMBERS}' || n] END, CASE WHEN len(u) = 0 THEN [] ELSE ['{grounding.ISSUES}' || array_to_string(u, ', ')] END, list_transform(c, lambda x: '{grounding.CLAIM}' || x)) AS w FROM v)
SELECT doc_id, array_to_string(w, '; ') AS violations, len(w) = 0 AS passed FROM w"""


def missing_with_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What questions ask for that there is no data on, where every other conversation has imported search figures."""
    rows = questions(read(spark, sf_dir, "conversations"))
    q = F.concat("text", F.when(F.col("turn") % 3 == 0, " how do we rank").otherwise(""))
    return rows.select("conv_id", "turn", F.array_join(grounding.missing_data(q, F.col("conv_id") % 2 == 0), "; ").alias("missing"))


MISSING = f"""WITH {QUESTIONS}, r AS (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN ' how do we rank' ELSE '' END AS text FROM q), m AS (SELECT conv_id, turn, {_labels(answers.UNAVAILABLE)} AS m, conv_id % 2 = 0 AND regexp_matches(text, '(?i){grounding.ASKS_SEARCH}') AS there FROM r)
SELECT conv_id, turn, array_to_string(list_filter(m, lambda x: NOT (there AND x IN ({", ".join(f"'{c}'" for c in grounding.COVERED)}))), '; ') AS missing FROM m"""

#: grounding_numbers of ``textual``: a document's numbers and claims against the evidence made for it.
NUMBERS = rf"""WITH d AS (SELECT doc_id, text || ' In ' || (doc_id % 50) || '.50 of 1,200 clicks, rank 3' AS text, (doc_id % 20) || '.5 and 1200 or 3' AS evidence FROM documents)
SELECT doc_id, array_to_string(list_filter({_numbers("text")}, lambda x: NOT list_contains({_numbers("evidence")}, x)), ',') AS numbers, array_to_string({_labels([(n, p) for p, n in answers.CLAIMS])}, '; ') AS claims FROM d"""

QUERIES = {"answer_grounding": answer_grounding, "missing_with_search": missing_with_search}
SQL = {"answer_grounding": GROUNDING, "missing_with_search": MISSING, "grounding_numbers": NUMBERS}
