"""Reports: action plan, top issues by category, issue references, page of a report."""

from __future__ import annotations

import html
from string import Template

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.settings import SEVERITIES

SECTION = 10


def action_plan(issues: DataFrame, limit: int = SECTION) -> DataFrame:
    """(section, rank, issue_key): what to fix first, quick wins, and what to plan next.

    What does not fit into a section may still be in a later one. Each section is a top-k of what the earlier ones left, so
    ``3 * limit`` issues of each kind decide; no full sort.
    """
    rows = issues.where("status = 'open' AND severity <> 'informational'").select("issue_key", "priority", "severity", F.coalesce("effort", F.lit("")).alias("effort"))
    order = [F.desc("priority"), F.asc("issue_key")]
    severe = F.col("severity").isin("critical", "high")
    first = rows.where(severe).orderBy(*order).limit(limit)
    rest = rows.join(first.select("issue_key"), "issue_key", "left_anti")
    quick = rest.where("effort = 'low'").orderBy(*order).limit(limit)
    later = rest.join(quick.select("issue_key"), "issue_key", "left_anti").orderBy(*order).limit(limit)
    parts = [d.select(F.lit(n).alias("section"), "issue_key", "priority") for n, d in (("fix_first", first), ("quick_wins", quick), ("plan_next", later))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    by = Window.partitionBy("section").orderBy(F.desc("priority"), "issue_key")
    return out.select("section", F.row_number().over(by).alias("rank"), "issue_key")


def by_category(issues: DataFrame, limit: int = SECTION) -> DataFrame:
    """Each category's open issues: how many, by severity, and the first by priority."""
    by = Window.partitionBy("category").orderBy(F.desc("priority"), "issue_key")
    rows = issues.where("status = 'open'")
    counts = rows.groupBy("category").agg(F.count("*").alias("open"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    top = rows.withColumn("k", F.row_number().over(by)).where(F.col("k") <= limit).groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "issue_key"))), lambda x: x["issue_key"]).alias("top"))
    return counts.join(top, "category")


def type_histogram(checks: DataFrame, limit: int = 15) -> DataFrame:
    return checks.select(F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("blocks")).orderBy(F.desc("blocks"), "type").limit(limit)


def letters(n: Column, most: int = 6) -> Column:
    """0 -> a, 25 -> z, 26 -> aa: numbers as letters, without a zero."""
    out, left = F.lit(""), n + 1
    for _ in range(most):
        digit = (left - 1) % 26
        out = F.when(left > 0, F.concat(F.char(digit + 97), out)).otherwise(out)
        left = F.when(left > 0, F.floor((left - 1) / 26)).otherwise(F.lit(0))
    return out


def references(issues: DataFrame, order: list, report: list | None = None) -> DataFrame:
    """(issue_key, ref): short names in the order in which issues are first shown, for each ``report`` by itself.

    A report shows at most three sections of issues, so a window over one report is small.
    """
    by = Window.partitionBy(*(report or [F.lit(1)])).orderBy(*order)
    return issues.withColumn("ref", F.concat(F.lit("issue-"), letters(F.row_number().over(by) - 1)))


# How words of labels are written, and how much of a value is shown.
ACRONYMS = {"url": "URL", "urls": "URLs", "http": "HTTP", "https": "HTTPS", "h1": "H1", "id": "ID", "ms": "ms"}
SHOWN, TEXT, PAIRS = 10, 300, 8


def label(key: Column) -> Column:
    """A key as a label: its words, the first with a capital, abbreviations as they are written."""
    word = lambda w: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ACRONYMS.items() for x in kv]), w), w)
    first = lambda w: F.when(w.isin(*ACRONYMS), word(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))))
    return F.array_join(F.transform(F.split(F.lower(key), "_"), lambda w, i: F.when(i == 0, first(w)).otherwise(word(w))), " ")


def _shown(value: Column, depth: int) -> Column:
    """A variant as text: lists with at most SHOWN entries, maps with PAIRS, yes and no, long texts with an ellipsis."""
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    cut = F.when(F.length(text) > TEXT, F.concat(F.left(text, F.lit(TEXT - 1)), F.lit("…"))).otherwise(text)
    plain = F.when(kind.isNull() | (kind == "VOID"), "none").when(kind == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), "yes").otherwise("no")).otherwise(cut)
    if not depth:
        return plain
    items, fields = F.try_variant_get(value, "$", "array<variant>"), F.map_entries(F.try_variant_get(value, "$", "map<string, variant>"))
    more = F.when(F.size(items) > SHOWN, F.concat(F.lit(" (and "), (F.size(items) - SHOWN).cast("string"), F.lit(" more)"))).otherwise("")
    listed = F.concat(F.array_join(F.transform(F.slice(items, 1, SHOWN), lambda x: _shown(x, depth - 1)), ", "), more)
    named = F.array_join(F.transform(F.slice(fields, 1, PAIRS), lambda e: F.concat(F.replace(e["key"], F.lit("_"), F.lit(" ")), F.lit(": "), _shown(e["value"], depth - 1))), "; ")
    return F.when(F.startswith(kind, F.lit("ARRAY")), listed).when(F.startswith(kind, F.lit("OBJECT")), named).otherwise(plain)


def evidence_pairs(evidence: Column, limit: int = PAIRS, depth: int = 3) -> Column:
    """The first (label, value) pairs of evidence, a JSON object, in its order; values nest ``depth`` deep at most."""
    pairs = F.map_entries(F.from_json(evidence, "map<string, variant>"))
    return F.transform(F.slice(pairs, 1, limit), lambda e: F.struct(label(e["key"]).alias("label"), _shown(e["value"], depth).alias("value")))


def summary_sentences(score: Column, before: Column, critical: Column, open_: Column) -> Column:
    many = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    first = F.concat(F.lit("The overall score is "), score.cast("string"), F.lit(" of 100"))
    change = F.when(before.isNull(), F.lit(".")).when(score > before, F.concat(F.lit(", up from "), before.cast("string"), F.lit("."))).when(score < before, F.concat(F.lit(", down from "), before.cast("string"), F.lit("."))).otherwise(F.lit(", unchanged."))
    return F.array(F.concat(first, change), F.concat(many(open_, "issue"), F.lit(" open, "), many(critical, "critical one"), F.lit(".")))


def render(title: str, sentences: list[str], sections: dict[str, DataFrame]) -> str:
    """A report as HTML. The tables are those of a report: top-k results, already small."""
    page = Template("<!doctype html><html lang='en'><meta charset='utf-8'><title>$title</title><h1>$title</h1>$body</html>")
    body = "".join(f"<p>{html.escape(s)}</p>" for s in sentences)
    for name, df in sections.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        rows = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.collect())
        body += f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{rows}</table>"
    return page.substitute(title=html.escape(title), body=body)
