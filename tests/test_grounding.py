"""JSON taken apart, and answers held against their evidence."""

import json

import pytest
from pyspark.sql import functions as F

from sitescope.functions import walk
from sitescope.operators import grounding

ISSUE = "0b7c1e7e-8a55-4c55-9a55-1f2b3c4d5e6f"
OTHER = "11111111-2222-3333-4444-555555555555"
SEEN = {"issues": [{"id": ISSUE, "rule_id": "onpage.title_missing", "affected_page_count": 12, "priority": 71.5}], "score": {"overall": 64.0}}
FOUND = SEEN | {"search_performance": {"clicks": 80, "position": 3.5, "note": "3,000 impressions and 4.0"}}


def told(text, ids=(ISSUE,), **more):
    return {"explanation": text, "steps": ["Add a unique title to each page."], "issue_ids": list(ids), **more}


CASES = {
    "grounded": (told("12 pages have no title. The site health score is 64."), SEEN, []),
    "number": (told("40 pages have no title."), SEEN, ["Uses numbers that are not in the project data: 40"]),
    "shortest first": (told("100 and 41 and 40 and 7"), SEEN, ["Uses numbers that are not in the project data: 7, 40, 41, 100"]),
    "unknown issue": (told("Pages have no title.", [OTHER]), SEEN, [f"Refers to issues that were not provided: {OTHER}"]),
    "id is no number": (told(f"see {ISSUE}"), SEEN, []),
    "list numbers": ({"answer": "Next steps:\n1. Add titles.\n2. Fix canonicals.\n3) Recrawl."}, {"pages": 110}, []),
    "counted": ({"answer": "Fix the 7 pages without titles."}, {"pages": 110}, ["Uses numbers that are not in the project data: 7"]),
    "deep": ({"a": [{"b": [{"c": "Affects 99 pages."}]}], "priorities": [{"issue_ids": ["77"]}]}, SEEN, ["Uses numbers that are not in the project data: 99", "Refers to issues that were not provided: 77"]),
    "an id without a rule": (told("x"), {"pages": [{"id": ISSUE}]}, [f"Refers to issues that were not provided: {ISSUE}"]),
    "guarantee": (told("Fixing this guarantees better results."), SEEN, ["Makes an unsupported claim: promises a guaranteed outcome"]),
    "reported clicks": (told("The site had 80 clicks. It will improve."), FOUND, []),
    "no search data": (told("The site had 12 clicks."), SEEN, ["Makes an unsupported claim: states traffic or backlink figures"]),
    "predicted": (told("You could get 80 clicks.\nGood."), FOUND, ["Makes an unsupported claim: states traffic or backlink figures"]),
    "predicted elsewhere": (told("It will grow. Average position 3.5\nmore later"), FOUND, []),
    "foreign figure": (told("At position 4.5 now"), FOUND, ["Uses numbers that are not in the project data: 4.5", "Makes an unsupported claim: states a ranking position"]),
    "numbers in texts of the evidence": (told("3000 impressions, 4 of them"), FOUND, []),
    "search data does not cover promises": (told("Traffic will increase."), FOUND, ["Makes an unsupported claim: predicts traffic"]),
    "true is no number": ({"a": "1 page"}, {"b": True}, ["Uses numbers that are not in the project data: 1"]),
    "empty search data": (told("80 clicks", []), {"n": 80, "x": {"search_performance": {}}}, []),
    "nothing": ({}, {}, []),
}


def test_check(spark):
    rows = [(k, json.dumps(o), json.dumps(e)) for k, (o, e, _) in CASES.items()] + [("null", None, None), ("broken", "{", "["), ("no evidence", '{"a": "5"}', None)]
    got = {r["id"]: r for r in grounding.check(spark.createDataFrame(rows, "id string, output string, evidence string")).collect()}
    want = {k: v for k, (_, _, v) in CASES.items()} | {"null": [], "broken": [], "no evidence": ["Uses numbers that are not in the project data: 5"]}
    assert {k: r["violations"] for k, r in got.items()} == want
    assert all(r["passed"] == (not r["violations"]) for r in got.values())


def test_check_empty(spark):
    assert grounding.check(spark.createDataFrame([], "id string, output string, evidence string")).count() == 0


@pytest.mark.parametrize("imported,want", [(True, ["visitor numbers and traffic"]), (False, ["visitor numbers and traffic", "search rankings and positions"]), (None, ["visitor numbers and traffic", "search rankings and positions"])])
def test_search_data_answers(spark, imported, want):
    row = spark.createDataFrame([("what traffic do we get and how do we rank", imported)], "q string, i boolean")
    assert row.select(grounding.missing_data(F.col("q"), F.col("i")).alias("m")).first()["m"] == want


def flat(v, path=()):
    inner = {**v}.items() if isinstance(v, dict) else [(f"[{i}]", x) for i, x in enumerate(v)] if isinstance(v, list) else ()
    return [(path, v)] if not inner else [leaf for k, x in inner for leaf in flat(x, (*path, k))]


def test_leaves(spark):
    docs = [FOUND, [[[["deep"]]], {"value": -5, "e": {"pos": 1, "k": None}}], "text", {"a": 'x{["', "b": [], "c": {}, "d.e": False}, {"path": {"place": 2.5}}]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9, None), (10, "{bad")], "id int, j string")
    out = walk.leaves(rows, "j", "id").select("id", "path", F.to_json("value").alias("v"), walk.kind(F.col("value")).alias("kind")).collect()
    got = {(r["id"], tuple(r["path"])): json.loads(r["v"] or "null") for r in out}
    assert got == {(i, p): v for i, d in enumerate(docs) for p, v in flat(d)} and len(got) == len(out)
    assert {r["kind"] for r in out} == {"string", "number", "boolean", "null", "list", "object"}
