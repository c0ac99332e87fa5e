import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from sitescope.llm import sharding

from ..conftest import DATA


def check(docs, shards=40):
    rows = sharding.shard_report(docs, shards).collect()
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
    return rows, sizes


def test_odd_documents(odd, none):
    rows, _ = check(odd)
    assert len(rows) == odd.count()
    assert sharding.shard_report(none).count() == 0


def test_near_equal(spark):
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")
    rows, sizes = check(docs)
    largest = max(r["size"] for r in rows)
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and all(abs(s - mean) <= 2 * largest for s in sizes.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.shard_report(docs).collect()))


def test_hot_text_is_split(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a text of a hot group").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"), F.lit("one").alias("source"))
    _, sizes = check(docs, 7)
    assert max(sizes.values()) - min(sizes.values()) <= 120


def test_files(spark, odd, tmp_path):
    sharding.write_shards(odd.drop("doc"), str(tmp_path / "s"), 5)
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()


def brute_tree(rows, first, shards):
    """{row: shard} by splitting sorted points at their weighted median, one node after another."""
    if shards == 1 or not rows:
        return {r["row"]: first for r in rows}
    d = max(sharding.DIMENSIONS, key=lambda d: max(r[d] for r in rows) - min(r[d] for r in rows))
    left, total = shards // 2, sum(r["size"] for r in rows)
    goal, below, cut = total * left / shards, 0, None
    for key in sorted({r[d] for r in rows}):
        own = sum(r["size"] for r in rows if r[d] == key)
        if below + own > goal:
            cut = key + 1 if abs(below + own - goal) < abs(below - goal) else key
            break
        below += own
    lower, upper = [r for r in rows if r[d] < cut], [r for r in rows if r[d] >= cut]
    return brute_tree(lower, first, left) | brute_tree(upper, first + left, shards - left)


def test_tree_against_brute_force(spark):
    """Every document is in the shard that exact medians, found node by node, give it."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    own = sharding.points(docs).collect()
    want = brute_tree([r.asDict() | {"row": k} for k, r in enumerate(own)], 0, 13)
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_report(docs, 13).collect()}
    assert got == {r["doc_id"]: want[k] for k, r in enumerate(own)}


def test_equal_texts_stay_together(spark):
    docs = spark.read.parquet(DATA.replace("0.001", "0.01") + "/documents.parquet")
    groups = sharding.shard_report(docs).groupBy("text_crc32").agg(F.count("*").alias("n"), F.count_distinct("shard").alias("shards")).where("n > 1").collect()
    assert len(groups) > 50 and sum(r["shards"] > 1 for r in groups) <= 0.1 * len(groups)
