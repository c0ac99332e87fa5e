"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words. Within a source, documents are included with unequal odds: a document of a length
*class* (the binary digits of its size) is expected in the mix ``rate * class`` times, at most ``cap`` times, where the rate
is such that the expected words are the source's target; what capped classes cannot take goes to the others. The whole part
is given to each document for certain, the fraction is its inclusion probability p. Documents are then ranked by the Pareto
ratio (u / (1 - u)) / (p / (1 - p)), u a hash of doc_id in (0, 1), and taken in that order while the source's remaining
words allow: a sample of fixed size, in words. The gap that is left (less than one document) is closed by the document
outside the sample whose size fits it best, if one brings the total nearer.

No group of one source meets in a task: ranks are cut by a histogram of the ratio for each source, and only the bucket in
which the cut falls is ordered. The plan has one row for each source and class, at most 64 for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_unit, join_small, ordinals, table, text_of, word_count

BUCKETS = 4096
NO_ID = -(2**63)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size (words of the whole text; null text: 0)."""
    return docs.select("doc_id", "source", word_count(text_of()).alias("size"))


def class_of(size: Column) -> Column:
    """The binary digits of a size: what its document's odds are in proportion to."""
    return F.length(F.bin(size)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: source_size and target.

    Sources in the order of their code points, null last, weigh ``weights``, repeating. They share ``share`` times all
    sizes; no target is above ``cap`` times its source's size, what is above goes to the others by weight: the level is
    raised until no further source is capped.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    per = ordinals(per, [F.col("source").asc_nulls_last()], "k")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("k", F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    level, count = -1.0, -1
    while True:
        capped = F.col("most") / F.col("w") < F.lit(level)
        r = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("most"))).alias("taken"), F.sum(F.when(~capped, F.col("w"))).alias("w"), F.count_if(capped).alias("n")).first()
        if r["n"] == count or not r["w"]:
            break
        count, level = r["n"], (share * (r["all"] or 0) - (r["taken"] or 0.0)) / r["w"]
    return per.select("source", "source_size", F.when(capped, F.col("most")).otherwise(F.col("w") * F.lit(level)).alias("target"))


def rates(sized: DataFrame, plan: DataFrame, cap: float = 2.0) -> DataFrame:
    """One row per source and class: source_size, target, the whole copies and the inclusion probability p.

    From the largest class down, classes are capped as long as the rate that is left for the others would take them beyond
    ``cap``. A source without words has target 0 and no rate.
    """
    per = sized.groupBy("source", class_of(F.col("size")).alias("cls")).agg(F.sum("size").cast("long").alias("words"))
    per = join_small(per, plan, ["source"])
    down = Window.partitionBy("source").orderBy(F.desc("cls"))  # at most 64 rows for each source
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("cls") * F.col("words")).over(down.rowsBetween(0, Window.unboundedFollowing))
    left = F.col("target") - F.lit(float(cap)) * above
    per = per.withColumn("rate", F.when(rest > 0, left / rest).otherwise(0.0))
    per = per.withColumn("full", F.col("rate") * F.col("cls") > F.lit(float(cap)))
    first = F.max(F.when(~F.col("full"), F.struct("cls", "rate"))).over(Window.partitionBy("source"))
    copies_ = F.when(first.isNull() | (F.col("cls") > first["cls"]), F.lit(float(cap))).otherwise(first["rate"] * F.col("cls"))
    per = per.withColumn("copies", F.when(F.col("source_size") > 0, copies_).otherwise(0.0))
    per = per.withColumn("whole", F.floor("copies").cast("long")).withColumn("p", F.col("copies") - F.floor("copies"))
    given = F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    return per.select("source", "cls", "source_size", "target", "whole", "p", (F.col("target") - given).alias("left"))


def _ranked(sized: DataFrame, plan: DataFrame, cap: float, seed: str) -> DataFrame:
    """Adds each document's Pareto ratio q, its histogram bucket and its id without null."""
    u = hash_unit(F.col("doc_id"), seed=seed)
    p = F.col("p")
    return (
        join_small(sized.withColumn("cls", class_of(F.col("size"))), plan, ["source", "cls"], spread="doc_id")
        .withColumn("q", F.when((p > 0) & (F.col("whole") < cap), (u / (1 - u)) / (p / (1 - p))))
        .withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS).cast("int"))
        .withColumn("id", F.coalesce("doc_id", F.lit(NO_ID)))
    )


def mix_plan(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per source and class: targets, whole copies, probabilities, and where the order of ratios is cut.

    Rows that repeat a doc_id in a source are taken together, ties of the ratio by doc_id.
    """
    plan = table(rates(sized, table(targets(sized, weights, share, cap), "mix-targets"), cap), "mix-rates")

    ranked = _ranked(sized, plan, cap, seed).where(F.col("q").isNotNull())
    by = Window.partitionBy("source").orderBy("bucket")
    hist = ranked.groupBy("source", "bucket", "left").agg(F.sum("size").alias("words"))
    hist = hist.withColumn("upto", F.sum("words").over(by))
    cross = hist.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("c"))
    cross = table(cross.select("source", F.col("c.bucket").alias("cut_bucket"), F.col("c.before").alias("before")), "mix-cross")

    # Only the documents of the bucket with the cut are ordered; rows with one id count as one.
    near = join_small(ranked, cross, ["source"], "inner", spread="doc_id").where(F.col("bucket") == F.col("cut_bucket"))
    near = near.groupBy("source", "left", "before", "q", "id").agg(F.sum("size").alias("size"))
    near = near.withColumn("upto", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("q", "id")))
    fits = F.when(F.col("upto") <= F.col("left"), F.struct("q", "id", "upto"))
    cut = near.groupBy("source").agg(F.max(fits).alias("c"), F.min("before").alias("before"))
    cut = cross.alias("x").join(cut.select(F.col("source").alias("s"), "c"), F.col("x.source").eqNullSafe(F.col("s")), "left").select(
        "source",
        "cut_bucket",
        F.col("c.q").alias("cut_q"),
        F.col("c.id").alias("cut_id"),
        F.coalesce(F.col("c.upto"), F.col("before")).alias("words"),
    )
    plan = table(plan.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-cut")

    # The document outside that fits the gap best.
    ranked = _ranked(sized, plan, cap, seed)
    gap = F.col("left") - F.col("words")
    off = F.abs(F.col("size") - gap)
    rest = ranked.where(F.col("q").isNotNull() & F.col("cut_bucket").isNotNull() & ~_inside() & (off < gap))
    fill = rest.groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("q"), F.col("id"))).alias("f"))
    fill = fill.select(F.col("source").alias("s"), F.col("f.q").alias("fill_q"), F.col("f.id").alias("fill_id"))
    return table(plan.join(fill, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "mix-plan")


def _inside():
    """Whether a ranked document is in the sample. Without a cut all candidates fit."""
    q, cut = F.col("q"), F.col("cut_q")
    in_bucket = F.coalesce((F.col("bucket") == F.col("cut_bucket")) & ((q < cut) | ((q == cut) & (F.col("id") <= F.col("cut_id")))), F.lit(False))
    return F.col("q").isNotNull() & (F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket")) | in_bucket)


def copies(docs: DataFrame, plan: DataFrame, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per document: the whole row as the struct ``doc``, source_size, target and copies (0 to ``cap``).

    Columns of the documents may have any names: they travel inside the struct. A size is taken over where there is one of
    ``sizes``, and counted from the text otherwise.
    """
    size = word_count(text_of()) if "text" in docs.columns else F.col("size")
    ranked = _ranked(docs.select(F.struct("*").alias("doc"), "doc_id", "source", size.alias("size")), plan, cap, seed)
    chosen = _inside() | F.coalesce((F.col("q") == F.col("fill_q")) & (F.col("id") == F.col("fill_id")), F.lit(False))
    return ranked.select("doc", "source_size", "target", (F.col("whole") + chosen.cast("long")).alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each row as often as the plan takes it (0, 1 or 2 times)."""
    plan = mix_plan(table(sizes(docs), "mix-sizes"), **options)
    taken = copies(docs, plan).where(F.col("copies") > 0)
    return taken.withColumn("n", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("doc.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words) of every document.

    Null and empty texts have size 0 and take nothing; a null source is a source, the last; null doc_ids count as one id.
    Very long texts are counted whole; where one of them is larger than what a source has left, it stays out. Repeated rows
    are taken alike. An empty table gives no rows; other columns are not read, whatever their names.
    """
    sized = table(sizes(docs), "mix-sizes")
    out = copies(sized, mix_plan(sized))
    return out.select("doc.doc_id", "doc.size", "source_size", "target", (F.col("copies") * F.col("doc.size")).alias("taken"))
