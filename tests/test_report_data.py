"""Data of stored reports on small cases."""

import datetime

from sitescope.operators import report_data


def day(n):
    return datetime.datetime(2026, 1, n)


def test_health(spark):
    crawls = spark.createDataFrame([(1, 1, c, day(c)) for c in (1, 2, 3, 4, 5)] + [(1, 2, 9, day(1))], "organisation_id int, project_id int, id int, created_at timestamp")
    scores = [(1, 1, 1, day(1), 50.0), (1, 1, 2, day(2), 60.25), (1, 1, 3, day(2), 70.0), (1, 1, 4, day(4), None), (1, 2, 9, day(1), 10.0)]
    scores = spark.createDataFrame(scores, "organisation_id int, project_id int, crawl_job_id int, created_at timestamp, overall double")
    asks = [("first", 1, 1, 1), ("same day", 1, 1, 2), ("largest of a day", 1, 1, 4), ("no score", 1, 1, 5), ("foreign", 1, 2, 1), ("gone", 1, 1, 77), ("none", 1, 1, None), ("again", 1, 1, 2)]
    got = {r["report_id"]: tuple(r)[1:] for r in report_data.health(spark.createDataFrame(asks, "report_id string, organisation_id int, project_id int, crawl_job_id int"), scores, crawls).collect()}
    assert got == {"first": (50.0, None, None), "same day": (60.25, 50.0, 10.3), "again": (60.25, 50.0, 10.3), "largest of a day": (None, 70.0, None), "no score": (None, None, None)}


def test_first_rows_in_parts(spark):
    """One group of many rows: the parts give what one window gives."""
    rows = spark.range(5000).selectExpr("id", "id % 7 AS p", "CASE WHEN id % 3 = 0 THEN 'b' ELSE 'a' END AS g")
    got = sorted(tuple(r) for r in report_data.first_rows(rows, ["g"], [rows.p.desc(), rows.id.asc()], 12, "id").select("g", "rank", "id").collect())
    want = [(g, k + 1, i) for g, rest in (("a", (1, 2)), ("b", (0,))) for k, i in enumerate(sorted((i for i in range(5000) if i % 3 in rest), key=lambda i: (-(i % 7), i))[:12])]
    assert got == want


def test_written(spark):
    asks = spark.createDataFrame([("r1", 1, 1, 5, True), ("r2", 1, 1, 6, True), ("r3", 1, 1, 5, False), ("r4", 2, 1, 5, None)], "report_id string, organisation_id int, project_id int, crawl_job_id int, include_ai boolean")
    kind = "management_summary"
    done = [(1, 1, 5, 1, kind, "completed", "old", "m", day(1)), (1, 1, 5, 2, kind, "completed", "new", "m", day(2)), (1, 1, 5, 3, kind, "failed", "bad", "m", day(3)), (1, 1, 6, 4, kind, "completed", "x", "m", day(1)), (1, 1, 6, 5, kind, "completed", None, "m", day(2)), (1, 1, 5, 6, "other", "completed", "y", "m", day(9))]
    done = spark.createDataFrame(done, "organisation_id int, project_id int, crawl_job_id int, id int, kind string, status string, output string, model string, finished_at timestamp")
    advice = [(1, 1, i, "accepted" if i != 3 else "dismissed", day(1 + i // 2), f"t{i}", "b", ["s"], None) for i in range(14)]
    advice = spark.createDataFrame(advice, "organisation_id int, project_id int, id int, status string, created_at timestamp, title string, body string, steps array<string>, page_url string")
    got = {r["report_id"]: (r["included"], r["summary"] and r["summary"]["output"], [x["title"] for x in r["recommendations"]]) for r in report_data.written(asks, done, advice).collect()}
    newest = [f"t{i}" for i in range(13, 3, -1)]
    assert got == {"r1": (True, "new", newest), "r2": (True, None, newest), "r3": (False, None, []), "r4": (False, None, [])}


def test_written_of_repeated_ids(spark):
    """Which of two summaries with one id and one time counts does not depend on their order."""
    asks = spark.createDataFrame([("r1", 1, 1, 5, True)], "report_id string, organisation_id int, project_id int, crawl_job_id int, include_ai boolean")
    advice = spark.createDataFrame([], "organisation_id int, project_id int, id int, status string, created_at timestamp, title string, body string, steps array<string>, page_url string")
    done = [(1, 1, 5, 1, "management_summary", "completed", x, "m", day(1)) for x in ("a", "b", None)]
    for rows in (done, done[::-1], done[1:] + done[:1]):
        rows = spark.createDataFrame(rows, "organisation_id int, project_id int, crawl_job_id int, id int, kind string, status string, output string, model string, finished_at timestamp").coalesce(1)
        assert [r["summary"]["output"] for r in report_data.written(asks, rows, advice).collect()] == ["b"]


def test_empty(spark):
    issues = spark.createDataFrame([], "organisation_id int, project_id int, issue_key string, priority double, status string, severity string, category string")
    assert report_data.counts(issues).count() == 0 and report_data.first_issues(issues).count() == 0
