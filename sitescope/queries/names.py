"""Queries that place new names among those in use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import names
from .base import read

#: Names in use: suppliers in seven bases, with numbers that leave gaps; some have leading zeros or none.
TAKEN = "CASE s_suppkey % 6 WHEN 0 THEN 'team-x{b}' WHEN 1 THEN 'team-x{b}-02' ELSE concat('team-x{b}-', s_suppkey * s_suppkey % 90) END"


def placed_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = read(spark, sf_dir, "supplier").select(F.expr(TAKEN.replace("'team-x{b}'", "concat('team-x', s_suppkey % 7)").replace("'team-x{b}-02'", "concat('team-x', s_suppkey % 7, '-02')").replace("'team-x{b}-'", "'team-x', s_suppkey % 7, '-'")).alias("slug"))
    new = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 == 9, "?!").otherwise(F.concat(F.lit(" Team: X"), (F.col("c_custkey") % 10).cast("string"))).alias("name"))
    return names.place(new, taken, ["c_custkey"]).select("c_custkey", "slug")


SQL = {
    "placed_slugs": """WITH t AS (SELECT DISTINCT CASE s_suppkey % 6 WHEN 0 THEN 'team-x' || s_suppkey % 7 WHEN 1 THEN 'team-x' || s_suppkey % 7 || '-02' ELSE 'team-x' || s_suppkey % 7 || '-' || s_suppkey * s_suppkey % 90 END AS slug FROM supplier),
c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 9 THEN 'organisation' ELSE 'team-x' || c_custkey % 10 END AS base FROM customer),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY c_custkey) AS k FROM c),
free AS (SELECT base, slug, row_number() OVER (PARTITION BY base ORDER BY n) AS k FROM (SELECT base, n, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (SELECT DISTINCT base FROM c), (SELECT unnest(range(1, (SELECT count(*) FROM c) + 200)) AS n)) WHERE slug NOT IN (SELECT slug FROM t))
SELECT c_custkey, slug FROM k JOIN free ON k.base = free.base AND k.k = free.k"""
}
QUERIES = {"placed_slugs": placed_slugs}
