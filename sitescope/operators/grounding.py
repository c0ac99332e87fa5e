"""Answers held against their evidence: numbers, cited issues and claims of whole JSON outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import walk
from . import answers

# Claims that imported search figures may support, and words by which a sentence predicts.
REPORTED = ("states a ranking position", "states traffic or backlink figures")
PREDICTS = r"\b(will|would|could|can|might|expect\w*|reach\w*|gain\w*|more|increase\w*|boost\w*|grow\w*|achiev\w*|improv\w*|get you)\b"
SEARCH = "search_performance"
# What is said of each violation; stored tasks are compared by them.
NUMBERS, ISSUES, CLAIM = "Uses numbers that are not in the project data: ", "Refers to issues that were not provided: ", "Makes an unsupported claim: "
MOST_NUMBERS, MOST_ISSUES = 10, 5
# What search figures answer once they are imported, and questions that ask for them.
COVERED = ("search rankings and positions", "Google Search clicks and impressions")
ASKS_SEARCH = r"search console|\bgoogle\b|\bsearch (results?|performance|queries|terms)\b|\bqueries\b|\bclicks?\b|\bimpressions?\b|\bctr\b|click-?through|\bposition\b|\brank|\bkeywords?\b|\bvisit(s|ors?)\b|\btraffic\b"


def missing_data(question: Column, imported: Column) -> Column:
    """What a question asks for that there is no data on; search figures count where they are imported and asked for."""
    there = F.coalesce(imported & question.rlike("(?i)" + ASKS_SEARCH), F.lit(False))
    return F.filter(answers.missing_data(question), lambda m: ~(there & m.isin(*COVERED)))


def first_match(value: Column, pattern: str) -> Column:
    """(before, match, after) of the first match; the pattern has no groups of its own that capture."""
    rx = rf"(?is)^(.*?)({pattern})(.*)$"
    return F.struct(*[F.regexp_extract(value, rx, k).alias(n) for k, n in ((1, "before"), (2, "match"), (3, "after"))])


def sentence(found: Column) -> Column:
    """The sentence around a match: from the last full stop with a space, or line feed, to the next."""
    left = F.regexp_replace(found["before"], r"(?s)^.*(\. |\n)", "")
    right = F.regexp_extract(found["after"], r"(?s)^(.*?)(?:\. |\n|\z)", 1)
    return F.concat(left, found["match"], right)


def _unsupported(t: Column, pattern: str, name: str, allowed: Column, search: Column) -> Column:
    hit = t.rlike("(?i)" + pattern)
    if name not in REPORTED:
        return hit
    m = first_match(t, pattern)
    reported = search & (F.size(F.array_except(answers.numbers(m["match"]), allowed)) == 0) & ~sentence(m).rlike("(?i)" + PREDICTS)
    return hit & ~reported


def _claims(texts: Column, allowed: Column, search: Column) -> Column:
    wrong = lambda pattern, name: F.exists(texts, lambda t: _unsupported(t, pattern, name, allowed, search))
    return F.filter(F.array(*[F.when(wrong(p, n), F.lit(n)) for p, n in answers.CLAIMS]), lambda c: c.isNotNull())


def numbers_of(value: Column) -> Column:
    """Numbers of a leaf: those in its text, or itself; truth values have none."""
    kind = walk.kind(value)
    plain = F.try_variant_get(value, "$", "string")
    return F.when(kind == "string", answers.numbers(plain)).when(kind == "number", F.array(answers.plain_number(plain))).otherwise(F.array().cast("array<string>"))


def check(rows: DataFrame, key: str = "id", output: str = "output", evidence: str = "evidence") -> DataFrame:
    """(key, numbers, unknown_issues, claims, violations, passed) of JSON outputs with the JSON evidence they were given.

    Every text of an output counts except what is under ``issue_ids``; every number and text of the evidence is allowed.
    Cited are the elements of lists named ``issue_ids``; known are the ``id`` of objects that also have a ``rule_id``. The
    figures of a ranking or of traffic are allowed where the evidence has search figures, all numbers of the claim come from
    it and its sentence does not predict. Unsupported numbers are the shortest ten (ties by code point), unknown issues the
    first five, claims in the order of ``answers.CLAIMS``.

    Keys are unique. Both documents are taken apart in one pass and one shuffle by key; only numbers, ids and texts move.
    Null or broken output passes; null evidence allows nothing.
    """
    both = rows.select(F.col(key).alias("k"), F.posexplode(F.array(output, evidence)).alias("side", "doc"))
    leaf = walk.leaves(both, "doc", "k", "side")
    plain = F.try_variant_get("value", "$", "string")
    told, last = F.col("side") == 0, F.try_element_at("path", F.lit(-1))
    in_ids = F.array_contains("path", "issue_ids")
    holder = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    cited = told & (F.size("path") >= 2) & (F.try_element_at(holder, F.lit(-1)) == "issue_ids")
    leaf = leaf.select(
        "k",
        F.when(told & ~in_ids & (walk.kind(F.col("value")) == "string"), plain).alias("text"),
        F.when(~told, numbers_of(F.col("value"))).alias("allowed"),
        F.when(~told, F.array_contains("path", SEARCH)).alias("search"),
        F.when(cited, plain).alias("cited"),
        F.when(~told & (last == "rule_id"), holder).alias("ruled"),
        F.when(~told & (last == "id"), F.struct(holder.alias("holder"), plain.alias("id"))).alias("named"),
    )
    by = leaf.groupBy("k").agg(
        F.collect_list("text").alias("texts"),
        F.array_distinct(F.flatten(F.collect_list("allowed"))).alias("allowed"),
        F.coalesce(F.bool_or("search"), F.lit(False)).alias("search"),
        F.collect_set("cited").alias("cited"),
        F.collect_set("ruled").alias("ruled"),
        F.collect_list("named").alias("named"),
    )
    said = F.array_distinct(F.flatten(F.transform("texts", answers.numbers)))
    extra = F.transform(F.array_sort(F.transform(F.array_except(said, "allowed"), lambda n: F.struct(F.length(n).alias("l"), n.alias("n")))), lambda x: x["n"])
    known = F.transform(F.filter("named", lambda x: F.array_contains(F.col("ruled"), x["holder"])), lambda x: x["id"])
    by = by.select("k", F.slice(extra, 1, MOST_NUMBERS).alias("numbers"), F.slice(F.array_sort(F.array_except("cited", known)), 1, MOST_ISSUES).alias("unknown_issues"), _claims(F.col("texts"), F.col("allowed"), F.col("search")).alias("claims"))
    out = rows.select(F.col(key).alias("k")).join(by, "k", "left")
    none = F.array().cast("array<string>")
    out = out.select("k", *[F.coalesce(F.col(c), none).alias(c) for c in ("numbers", "unknown_issues", "claims")])
    listed = lambda c, words: F.when(F.size(c) > 0, F.array(F.concat(F.lit(words), F.array_join(c, ", ")))).otherwise(none)
    wrong = F.concat(listed("numbers", NUMBERS), listed("unknown_issues", ISSUES), F.transform("claims", lambda c: F.concat(F.lit(CLAIM), c)))
    return out.select(F.col("k").alias(key), "numbers", "unknown_issues", "claims", wrong.alias("violations"), (F.size(wrong) == 0).alias("passed"))
