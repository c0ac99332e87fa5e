"""Helpers shared by the pipeline operators: words, hashes, skew-safe joins; scratch tables come from the library."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import scratch_path, shared_dir, table

__all__ = ["scratch_path", "shared_dir", "table"]

#: A word is a run of characters other than space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Texts that a task holds as Python objects at a time.
SLICE_ROWS = 512

#: A side is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 50_000
#: Copies of the other side when it is larger.
SALTS = 64


def sliced(batches: Iterable, rows: int = SLICE_ROWS) -> Iterator:
    """Arrow batches cut into slices (views, not copies), so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def hash_unit(*cols: Column, seed: str = "") -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5, the same in any engine."""
    joined = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    bits = F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def join_small(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left", spread: str | None = None, salts: int = SALTS) -> DataFrame:
    """Join with a table of one row per key, null-safe, without moving a hot key to one task.

    The small side is counted first. Up to BROADCAST_ROWS rows it is broadcast; beyond, every key of it is copied
    SALTS times and the rows of ``df`` are dealt over the copies by a hash of ``spread`` (all columns by default).
    The copies are merged: Spark judges them by the file they were read from, and would broadcast millions of them.
    Where ``df`` has few rows of a key (``salts`` is 1), the keys are not copied.
    """
    right = small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    if small.count() <= BROADCAST_ROWS:
        joined = df.join(F.broadcast(right), on, how)
    elif salts == 1:
        joined = df.join(right.hint("merge"), on, how)
    else:
        salt = F.pmod(F.xxhash64(*([F.col(spread)] if spread else [F.col(c) for c in df.columns])), F.lit(salts))
        right = right.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = df.withColumn("__salt", salt).join(right.hint("merge"), on & (F.col("__salt") == F.col("__copy")), how).drop("__salt", "__copy")
    return joined.drop(*[f"__{k}" for k in keys])


def numbered(docs: DataFrame) -> DataFrame:
    """Every row as the struct ``doc`` with a number ``row`` and a hash ``sum`` of its columns, written once."""
    parts = [F.coalesce(F.to_json(F.struct(F.col(f"doc.`{c}`").alias("c"))), F.lit("")) for c in docs.columns if c != "text"]
    rows = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"))
    return table(rows.withColumn("sum", F.xxhash64(F.col("doc.text"), *parts)), "near-rows")


def smallest(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Of every label the row with the smallest doc_id (null only if there is no other), by content among equals.

    ``rows`` are numbered, ``labels`` has (row, label). Only ids are grouped. The rows that go are fewer than those that
    stay: up to BROADCAST_ROWS of them are broadcast, and then no text is shuffled.
    """
    ids = rows.select("row", "sum", F.col("doc.doc_id").alias("id"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sum", "row")).alias("best")
    several = F.count("*").alias("n")
    named = table(ids.join(labels, "row").select("label", "row", "sum", "id"), "near-named")
    firsts = table(named.groupBy("label").agg(best, several).where("n > 1").select("label", F.col("best.row").alias("first")), "near-firsts")
    gone = table(join_small(named, firsts, ["label"], "inner", spread="row").where("row <> first").select("row"), "near-gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(side, "row", "left_anti").select("doc.*")


def ordinals(df: DataFrame, by: list[Column], name: str = "ordinal") -> DataFrame:
    """Adds the place of every row in the order ``by``, from 0: ranges are sorted apart and numbered on, none in one task."""
    parts = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id())
    parts = table(parts.withColumn("__own", F.row_number().over(Window.partitionBy("__part").orderBy(*by)).cast("long") - 1), "ordinals")
    before, starts = 0, []
    for r in parts.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect():  # one row for each range
        starts += [F.lit(r["__part"]), F.lit(before)]
        before += r["n"]
    start = F.element_at(F.create_map(*starts), F.col("__part")) if starts else F.lit(0)
    return parts.withColumn(name, (F.col("__own") + start).cast("long")).drop("__part", "__own")
