"""JSON documents taken apart level by level: one row for each leaf, with its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nesting(json: Column) -> Column:
    """How many brackets are open at once, at most: strings are removed first, then brackets are counted."""
    bare = F.regexp_replace(json, r'"(?:[^"\\]|\\.)*+"', "")
    steps = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.coalesce(F.aggregate(steps, start, step, lambda acc: acc["most"]), F.lit(0))


def leaves(rows: DataFrame, json: str, *keep: str) -> DataFrame:
    """(*keep, path, place, value): every scalar and every empty list or object of a JSON column.

    ``path`` holds the keys from the root, positions of lists as ``[n]``; ``place`` the positions, which order the leaves of
    a document (keys of an object in the order of their code points); ``value`` is a VARIANT. The depth of the deepest
    document is measured first (one number), and each level is one narrow step in which scalars stay as they are: the input
    is read once and nothing is shuffled. Null or broken JSON has no leaves; a document that is a scalar is one leaf with an
    empty path.
    """
    depth = rows.agg(F.max(nesting(F.col(json)))).first()[0] or 0
    out = rows.select(*keep, F.array().cast("array<string>").alias("path"), F.array().cast("array<int>").alias("place"), F.try_parse_json(json).alias("value")).where("value IS NOT NULL")
    for _ in range(depth):
        down = out.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("value").outer()).alias("e"))
        inner = F.col("e.pos").isNotNull()
        name = F.coalesce(F.col("e.key"), F.concat(F.lit("["), F.col("e.pos").cast("string"), F.lit("]")))
        out = down.select(
            *keep,
            F.when(inner, F.array_append("path", name)).otherwise(F.col("path")).alias("path"),
            F.when(inner, F.array_append("place", F.col("e.pos"))).otherwise(F.col("place")).alias("place"),
            F.when(inner, F.col("e.value")).otherwise(out["value"]).alias("value"),
        )
    return out


def kind(value: Column) -> Column:
    """string, number, boolean, null, list or object."""
    s = F.schema_of_variant(value)
    by = F.when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.startswith("ARRAY"), "list").when(s.startswith("OBJECT"), "object")
    return by.otherwise("number")
