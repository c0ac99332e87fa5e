"""Sharding by a k-d tree over document metadata with weighted medians.

Every document is a point: its language and its source, each by its place in the order of code points, and the logarithm of
its size, codes of 12 bits. Further bits part the documents of one code, so that no language or source is too large to split:
8 from a hash of the text, then 10 from one of doc_id. Equal texts take the smallest language and source among them, so they
are one point but for the last bits, and stay together unless a median falls on them: a group larger than a shard is split
exactly, a small one only if it shares the bits of a median's text. A node that stands for k shards is split along its widest
dimension where the bytes of the lower side reach floor(k/2)/k of its own, and so on until every leaf is one shard with the
target bytes.

Medians come from histograms of all nodes of a level at once, refined in three steps of 1024 buckets, over cells (documents
with equal points, added up). The driver sees bucket sums, at most nodes x 1024 of them, and keeps one threshold for each
split; documents are then assigned by a nested expression without a join.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, ordinals, table, text_of

SHARDS = 40
OVERHEAD = 16
CODE_BITS, TEXT_BITS, DOC_BITS, STEP_BITS = 12, 8, 10, 10
KEY_BITS = CODE_BITS + TEXT_BITS + DOC_BITS
DIMENSIONS = ("by_lang", "by_source", "by_size")
#: Groups in which the documents of a shard are numbered.
SLOT_GROUPS = 256


class Node(NamedTuple):
    id: int
    first: int  # the first of its shards
    shards: int


class Split(NamedTuple):
    node: int
    dimension: str
    threshold: int  # keys below go left
    left: Node
    right: Node


def _coded(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``column``_code: the place of the value in the order of code points, null last, stretched over the codes."""
    known = table(ordinals(rows.select(column).distinct(), [F.col(column).asc_nulls_last()], "k"), "shard-codes")
    code = F.floor(F.col("k") * F.lit(1 << CODE_BITS) / F.lit(max(1, known.count()))).cast("long")
    return join_small(rows, known.select(column, code.alias(f"{column}_code")), [column], spread="doc_id")


def points(docs: DataFrame, columns: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, size, the keys of the dimensions and further columns.

    Null lang, source and doc_id are values like any other, null text is empty; repeated rows are equal points.
    """
    size = (F.octet_length(text_of()) + OVERHEAD).cast("long")
    rows = docs.select("doc_id", "lang", "source", size.alias("size"), F.xxhash64(text_of()).alias("text_hash"), *columns)
    further = [F.col(c) for c in rows.columns[5:]]
    several = rows.groupBy("text_hash").agg(F.count("*").alias("n"), F.min(F.struct("lang", "source")).alias("first")).where("n > 1").select("text_hash", "first")
    rows = join_small(rows, table(several, "shard-groups"), ["text_hash"], spread="doc_id")
    same = lambda c: F.when(F.col("first").isNotNull(), F.col(f"first.{c}")).otherwise(F.col(c)).alias(c)
    rows = rows.select("doc_id", same("lang"), same("source"), "size", "text_hash", *further)
    rows = _coded(_coded(rows, "lang"), "source")
    spread = F.pmod("text_hash", F.lit(1 << TEXT_BITS)) * (1 << DOC_BITS) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << DOC_BITS))
    key = lambda d, c: (c * (1 << (TEXT_BITS + DOC_BITS)) + spread).cast("long").alias(d)
    log = F.least(F.floor(F.log2("size") * (1 << (CODE_BITS - 5))), F.lit((1 << CODE_BITS) - 1))
    return rows.select("doc_id", "size", key("by_lang", F.col("lang_code")), key("by_source", F.col("source_code")), key("by_size", log), *further)


def place(splits: list[Split], shards: bool = False) -> Column:
    """The node that a point is in after the splits, as an expression; with ``shards``, the number of its leaf's shard."""
    by = {s.node: s for s in splits}
    boxes: list[tuple[Node, dict[str, tuple[int, int]]]] = []

    def walk(node: Node, box: dict[str, tuple[int, int]]) -> None:
        if node.id not in by:
            boxes.append((node, box))
            return
        s = by[node.id]
        low, high = box.get(s.dimension, (0, 1 << KEY_BITS))
        walk(s.left, box | {s.dimension: (low, s.threshold)})
        walk(s.right, box | {s.dimension: (s.threshold, high)})

    walk(Node(1, 0, len(splits) + 1), {})
    out = None
    for node, box in boxes:
        inside = F.lit(True)
        for d, (low, high) in box.items():
            inside = inside & (F.col(d) >= low) & (F.col(d) < high)
        number = F.lit(node.first if shards else node.id)
        out = F.when(inside, number) if out is None else out.when(inside, number)
    return out


def build(points: DataFrame, shards: int = SHARDS) -> list[Split]:
    """The splits of the tree, from the root down. They number shards - 1, whatever the data."""
    cells = points.groupBy(*DIMENSIONS).agg(F.sum("size").alias("bytes"))
    splits: list[Split] = []
    level = [Node(1, 0, shards)] if shards > 1 else []
    while level:
        open_ = [n.id for n in level]
        placed = cells = table(cells.withColumn("node", place(splits)).where(F.col("node").isin(open_)), "shard-cells")
        extents = [F.struct(F.min(d).alias("lo"), F.max(d).alias("hi")).alias(d) for d in DIMENSIONS]
        seen = {r["node"]: r for r in placed.groupBy("node").agg(*extents, F.sum("bytes").alias("bytes")).collect()}
        along, low, goal = {}, {}, {}
        for n in level:
            r = seen.get(n.id)
            width = lambda d, r=r: r[d]["hi"] - r[d]["lo"]
            along[n.id] = max(DIMENSIONS, key=width) if r else DIMENSIONS[0]
            low[n.id] = 0
            goal[n.id] = (r["bytes"] if r else 0) * (n.shards // 2) / n.shards
        key = _case(along, lambda d: F.col(d))
        below = dict.fromkeys(low, 0)  # bytes below the bucket in which the median is known to lie
        for shift in range(KEY_BITS - STEP_BITS, -STEP_BITS, -STEP_BITS):
            s, span = max(shift, 0), min(STEP_BITS, shift + STEP_BITS)
            base = _case(low, F.lit)
            bucket = F.floor((key - base) / (1 << s)).cast("long")
            hist = placed.withColumn("bucket", bucket).where((F.col("bucket") >= 0) & (F.col("bucket") < (1 << span)))
            sums: dict[int, dict[int, int]] = {}
            for r in hist.groupBy("node", "bucket").agg(F.sum("bytes").alias("bytes")).collect():  # nodes x 1024 at most
                sums.setdefault(r["node"], {})[r["bucket"]] = r["bytes"]
            for n in level:
                upto = below[n.id]
                for b in sorted(own := sums.get(n.id, {})):
                    if upto + own[b] > goal[n.id] or b == max(own):
                        low[n.id] += b << s
                        break
                    upto += own[b]
                below[n.id] = upto
                if s == 0 and own:
                    # the key itself goes to the side that brings the lower bytes nearer the goal
                    at = own[b]
                    if abs(upto + at - goal[n.id]) < abs(upto - goal[n.id]):
                        low[n.id] += 1
        for n in level:
            left = n.shards // 2
            splits.append(Split(n.id, along[n.id], low[n.id], Node(2 * n.id, n.first, left), Node(2 * n.id + 1, n.first + left, n.shards - left)))
        level = [c for s in splits if s.node in {n.id for n in level} for c in (s.left, s.right) if c.shards > 1]
    return splits


def _case(by_node: dict[int, object], value) -> Column:
    out = None
    for node, x in by_node.items():
        hit = F.col("node") == node
        out = F.when(hit, value(x)) if out is None else out.when(hit, value(x))
    return out


def assign(points: DataFrame, splits: list[Split]) -> DataFrame:
    """Adds ``shard`` and ``slot``, gapless from 0 in each shard."""
    rows = points.withColumn("shard", place(splits, True)).drop(*DIMENSIONS)
    rest = [c for c in rows.columns if c not in ("doc_id", "shard")]
    rows = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", *rest), F.lit(SLOT_GROUPS)).cast("int"))
    by = Window.partitionBy("shard").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "g").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("shard").alias("s"), F.col("g").alias("h"), F.coalesce(F.sum("n").over(by), F.lit(0)).alias("before"))
    numbered = rows.withColumn("own", F.row_number().over(Window.partitionBy("shard", "g").orderBy("doc_id", *rest)) - 1)
    out = numbered.join(F.broadcast(counts), (F.col("shard") == F.col("s")) & (F.col("g") == F.col("h")))  # shards x SLOT_GROUPS rows
    return out.withColumn("slot", (F.col("own") + F.col("before")).cast("long")).drop("g", "s", "h", "own", "before")


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Null and empty texts have OVERHEAD bytes; very long ones are weighed whole and go where they bring the sides nearest; ties
    go to one side; repeated rows get slots of their own. An empty table gives no rows; other columns may have any names.
    """
    rows = points(docs, (F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32"),))
    rows = table(rows, "shard-points")
    out = assign(rows, build(rows, shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes the documents themselves, one folder for each shard."""
    own = points(docs, (F.struct(*docs.columns).alias("doc"),))
    splits = build(own.drop("doc"), shards)
    own.withColumn("shard", place(splits, True)).select("doc.*", F.col("shard").alias("shard_id")).write.partitionBy("shard_id").parquet(path)
