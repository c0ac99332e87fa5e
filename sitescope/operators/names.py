"""Free names for many new rows at once: the first number that no other name has, by gaps and islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import slug
from ..plans.scratch import table

# Fixed value: the name of what has none.
NAMELESS = "organisation"


def base_of(name: Column) -> Column:
    return F.coalesce(F.nullif(slug(name), F.lit("")), F.lit(NAMELESS))


def _used(slugs: DataFrame) -> DataFrame:
    """(base, n) of names in use, in both readings: the name itself is number 1 of its base, ``base-n`` number n."""
    n = F.regexp_extract("slug", "^(.+)-([1-9][0-9]*)$", 2).try_cast("long")
    own = F.struct(F.col("slug").alias("base"), F.lit(1).cast("long").alias("n"))
    other = F.when(n > 1, F.struct(F.regexp_extract("slug", "^(.+)-([1-9][0-9]*)$", 1).alias("base"), n.alias("n")))
    return slugs.where("slug IS NOT NULL").select(F.inline(F.filter(F.array(own, other), lambda x: x.isNotNull()))).distinct()


def _placed(new: DataFrame, used: DataFrame, order: list[str]) -> DataFrame:
    """Sets slug: the k-th new row of a base takes the k-th number that is free there.

    Below the j-th taken number n lie n - j free ones; so the k-th free number is k + j for the last j with n - j < k. Taken
    numbers and new rows are merged in the order of free numbers, and each row reads the last j before it.
    """
    rows = new.withColumn("k", F.row_number().over(Window.partitionBy("base").orderBy(*order)).cast("long"))
    taken = used.join(new.select("base").distinct(), "base", "left_semi").withColumn("j", F.row_number().over(Window.partitionBy("base").orderBy("n")).cast("long"))
    marks = taken.select("base", (F.col("n") - F.col("j")).alias("at"), "j", F.lit(None).cast(rows.select(F.struct("*").alias("row")).schema["row"].dataType).alias("row"))
    asks = rows.select("base", F.col("k").alias("at"), F.lit(None).cast("long").alias("j"), F.struct("*").alias("row"))
    # a mark at k does not count for row k: rows go before marks of the same place
    by = Window.partitionBy("base").orderBy("at", F.col("row").isNull(), "j").rowsBetween(Window.unboundedPreceding, 0)
    merged = marks.unionByName(asks).withColumn("j", F.coalesce(F.last("j", ignorenulls=True).over(by), F.lit(0))).where("row IS NOT NULL")
    number = F.col("row.k") + F.col("j")
    return merged.select("row.*", F.when(number == 1, F.col("base")).otherwise(F.concat_ws("-", "base", number.cast("string"))).alias("slug")).drop("k")


def place(new: DataFrame, taken: DataFrame, order: list[str], name: str = "name") -> DataFrame:
    """``new`` with ``slug``: every row's own, none of ``taken`` (slug), rows of one base in their ``order``.

    A name of one base may be a numbered name of another ("a" and "a-2"). Of new rows that come to the same name the first
    keeps it; the others are placed again, next to all that are settled. Null names and names without letters are ``NAMELESS``.
    ``order`` has to tell rows apart.
    """
    rest = table(new.withColumn("base", base_of(F.col(name))), "names-new")
    used, out = table(_used(taken), "names-used"), None
    while True:
        found = _placed(rest, used, order).withColumn("again", F.row_number().over(Window.partitionBy("slug").orderBy(*order)) > 1)
        found = table(found, "names-placed")
        settled = found.where("NOT again").drop("again")
        out = settled if out is None else out.unionByName(settled)
        rest = found.where("again").drop("again", "slug")
        if not rest.head(1):
            return out.drop("base")
        used = table(used.unionByName(_used(settled)).distinct(), "names-used")
