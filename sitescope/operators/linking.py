"""Internal links: sources, broken links, and suggestions where a text already names another page."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.numbers import half_up
from ..plans.batches import arrow_schema, sliced
from ..plans.context import failed
from ..plans.filters import KeyFilter
from ..plans.scratch import table

# Phrases that name no topic; limits of suggestions.
GENERIC = ("home", "home page", "welcome", "about", "about us", "contact", "contact us", "news", "events", "read more", "click here", "page not found")
PER_TARGET, TOTAL, AROUND = 3, 500, 80
PARTS = 64
#: Words of the runs that phrases and texts meet on.
RUN = 5
#: Letters that are not the lower case of their own capitals; categories of characters that are of no word; letters handed on at a time.
IRREGULAR = "µıſ\u0345ςϐϑϕϖϰϱϵᲀᲁᲂᲃᲄᲅᲆᲇᲈẛ\u1fbe"
NO_WORD = ("Po", "Ps", "Pe", "Pi", "Pf", "Pd", "Sm", "Sc", "Zs", "Zl", "Zp", "Cc")
HANDED = 1 << 22
#: Links in a task, and parts that the links of one page are spread over.
ROWS, SPREAD = 1_000_000, 16


def linking_sources(links: DataFrame, pages: DataFrame, limit: int = 10) -> DataFrame:
    """(target_id, sources): the first distinct addresses in order that link to a page.

    Links meet the addresses of their sources, and are then ranked, in tasks of about ROWS of them, so that the memory of a
    task does not grow with the links; the rows of one source or of one target lie in SPREAD parts, of which a target's
    first addresses are merged. Equal addresses have one rank, so no distinct is needed.
    """
    own = links.where("target_id IS NOT NULL AND target_id <> source_id").select("source_id", "target_id")
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, -(-own.count() // ROWS))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(SPREAD)).alias("part")
    src = pages.select(F.col("id").alias("source_id"), F.col("url").alias("source_url"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<bigint>")).alias("part"))
    rows = own.select("source_id", "target_id", part("target_id")).repartition(tasks, "source_id", "part").join(src.repartition(tasks, "source_id", "part"), ["source_id", "part"])
    rows = rows.select("target_id", "source_url", part("source_url")).repartition(tasks, "target_id", "part")
    first = lambda df, *keys: df.withColumn("n", F.dense_rank().over(Window.partitionBy(*keys).orderBy("source_url"))).where(F.col("n") <= limit).drop("n")
    rows = first(first(rows, "target_id", "part").drop("part").repartition(tasks, "target_id"), "target_id")
    return rows.groupBy("target_id").agg(F.array_sort(F.collect_set("source_url")).alias("sources"))


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(source_url, target_url, status_code, fetch_status) of internal links to pages that fail."""
    target = pages.where(failed()).select(F.col("id").alias("target_id"), F.col("url").alias("target_page"), "status_code", "fetch_status")
    source = pages.select(F.col("id").alias("source_id"), F.col("url").alias("source_url"))
    hits = links.where("is_internal").join(target, "target_id").join(source, "source_id")
    return hits.select("source_url", F.col("target_page").alias("target_url"), "status_code", "fetch_status")


def outlinks(links: DataFrame, pages: DataFrame, page_id: Column, limit: int = 500) -> DataFrame:
    target = pages.select(F.col("id").alias("target_id"), "status_code")
    return links.where(F.col("source_id") == page_id).join(target, "target_id", "left").select("target_url", "status_code").orderBy("target_url").limit(limit)


def inlinks(links: DataFrame, pages: DataFrame, page_id: Column, limit: int = 500) -> DataFrame:
    source = pages.select(F.col("id").alias("source_id"), F.col("url").alias("source_url"))
    return links.where(F.col("target_id") == page_id).join(source, "source_id").select("source_url", "anchor_text").orderBy("source_url").limit(limit)


def phrases(headings: Column, title: Column, suffix: Column) -> Column:
    """What a page is about: its main headings, then its title without the site's name; distinct but for case."""
    own = F.concat(F.transform(F.filter(F.coalesce(headings, F.array().cast("array<struct<level:int,text:string>>")), lambda h: h["level"] == 1), lambda h: h["text"]), F.array(text.strip_suffix(title, suffix)))
    own = F.filter(F.transform(own, text.collapsed), lambda p: (F.size(text.tokens(p)) >= 2) & (F.length(p) >= 8) & ~F.lower(p).isin(*GENERIC))
    low = F.transform(own, F.lower)
    return F.filter(own, lambda p, i: F.array_position(low, F.lower(p)) == i + 1)


def word_runs(words: Column, size: int, *within: Column) -> Column:
    """Distinct hashes of ``size`` neighbouring words, and of what they are ``within``."""
    starts = F.sequence(F.lit(1), F.size(words) - (size - 1))
    found = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(size)], *within))
    return F.array_distinct(F.when(F.size(words) >= size, found).otherwise(F.array().cast("array<bigint>")))


def places(rows: DataFrame) -> DataFrame:
    """Where texts ``t`` (``low`` in lower case) hold each of the phrases ``named``: columns of ``rows`` but these three, and phrase,
    found, around, more_before, more_after; or, where it takes a pattern to say, the text ``t`` itself.

    Where a text has as many letters in lower case, none of them IRREGULAR, what its lower case holds first is the first match,
    if no letter may go on beside it. Python looks for all phrases of a text where it is read, as its search is some ten times
    as fast as an expression; texts are handed on for the other phrases alone, HANDED letters of them at a time.
    """
    kept = [f for f in rows.schema if f.name not in ("t", "low", "named")]
    names = [f.name for f in kept]
    made = "phrase string, found string, around string, more_before boolean, more_after boolean, t string"
    types = arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import unicodedata

        def batch(b: pa.RecordBatch, of: list[int], out: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)]
            return pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(of, pa.int32())) for c in names], *cols], names=[*names, *types.names])

        for b in sliced(batches):
            of, out, size = [], [], 0
            for i in range(b.num_rows):
                t, low = b.column("t")[i].as_py(), b.column("low")[i].as_py()
                plain = len(t) == len(low) and (low.isascii() or not any(c in low for c in IRREGULAR))
                for p in b.column("named")[i].as_py():
                    at = low.find(p)
                    if at < 0:
                        continue
                    end = at + len(p)
                    left, right = max(at - AROUND, 0), end + AROUND
                    alone = all(unicodedata.category(c) in NO_WORD for c in t[max(at - 1, 0) : at] + t[end : end + 1])
                    of.append(i)
                    out.append((p, t[at:end], t[left:right], left > 0, right < len(t), None) if plain and alone else (p, None, None, None, None, t))
                    size += 500 if plain and alone else len(t)
                    if size > HANDED:
                        yield batch(b, of, out)
                        of, out, size = [], [], 0
            yield batch(b, of, out)

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return rows.mapInArrow(run, own + made)


def suggest(pages: DataFrame, links: DataFrame, root_url: str, min_inlinks: int = 3) -> DataFrame:
    """(crawl_job_id, source_id, target_id, source_url, target_url, anchor_text, snippet, reason, relevance): texts that name
    a page's topic and do not link to it; at most 500 of a crawl, the most relevant first (then by address).

    Pages belong to crawls, which are matched apart in one job; ids of pages are unique over all crawls. Pages without the
    column ``crawl_job_id`` are one crawl. Each distinct phrase of a crawl is matched once, and only with texts that hold its
    rarest RUN neighbouring words (all its words, where it has fewer). These are joined by a hash (with the crawl in it) and ids
    alone; a filter of bits drops the runs of a text that are in no phrase where they are hashed. A source meets all its phrases
    in one row and is read with them once; a phrase that one page alone is about is not looked for in that page. Sources of a phrase are ranked, and a target asks for as many of the first ones as can be in
    its way (itself, sources that link to it already, those it has by an earlier phrase) and three more: pages that share a
    phrase do not multiply with the texts that hold it. Ranks are given within parts of a phrase (and of a crawl) first, so
    that no task sorts all texts that hold a frequent one.
    """
    own = (pages if "crawl_job_id" in pages.columns else pages.withColumn("crawl_job_id", F.lit(""))).where("indexable")
    own = own.withColumn("crawl", F.coalesce(F.col("crawl_job_id").cast("string"), F.lit("")))
    facts = table(own.select("crawl", "id", "url", "title", "headings", "important", "inlinks_count", "is_orphan"), "suggest-pages")  # without texts
    suffix = text.common_title_suffix(facts, keys=("crawl",))
    wanted = facts.where((F.col("url") != root_url) & ((F.col("inlinks_count") <= 1) | F.coalesce("is_orphan", F.lit(False)) | (F.col("important") & (F.col("inlinks_count") < min_inlinks))))
    wanted = wanted.join(suffix, "crawl", "left")
    wanted = wanted.select("crawl", F.col("id").alias("target_id"), F.col("url").alias("target_url"), "important", F.col("inlinks_count").alias("target_links"), F.posexplode(phrases(F.col("headings"), F.col("title"), F.col("suffix"))).alias("phrase_no", "phrase"))
    wanted = table(wanted.withColumn("phrase", F.lower("phrase")).withColumn("words", text.tokens(F.col("phrase"))), "suggest-phrases")

    named = wanted.select("crawl", "phrase", F.col("phrase").alias("said"), F.xxhash64("crawl").alias("seed")).distinct()
    asked = table(text.hashed_runs(named, "said", "seed", list(range(2, RUN + 1)), longest=True), "suggest-asked")
    keys, sizes = asked.select("g").distinct(), [r[0] for r in asked.select("size").distinct().collect()]  # four at most
    held = own.select(F.col("id").alias("source_id"), F.lower("text").alias("said"), F.xxhash64("crawl").alias("seed"))
    held = text.hashed_runs(held, "said", "seed", sizes or [RUN], KeyFilter(keys, "g")).select("source_id", "g")
    held = table(held.join(keys, "g", "left_semi"), "suggest-runs")
    use = held.groupBy("g").agg(F.count("*").alias("n"))
    rare = asked.join(use, "g", "left").groupBy("crawl", "phrase").agg(F.min_by(F.struct("g", "n"), F.struct(F.coalesce("n", F.lit(0)), "g")).alias("r"))
    # a phrase that one page alone is about needs no match with that page
    alone = wanted.groupBy("crawl", "phrase").agg(F.when(F.count("*") == 1, F.min("target_id")).alias("alone"))
    rare = rare.where("r.n IS NOT NULL").join(alone, ["crawl", "phrase"]).select("phrase", "r.g", "alone")
    near = held.join(rare, "g").where("alone IS NULL OR alone <> source_id").groupBy("source_id").agg(F.collect_set("phrase").alias("named"))
    source = own.select(F.col("id").alias("source_id"), "crawl", F.col("url").alias("source_url"), F.col("text").alias("t"), F.coalesce("depth", F.lit(99)).alias("d"), F.col("inlinks_count").alias("links_in"))
    near = places(source.join(near, "source_id").withColumn("low", F.lower("t")))
    # A literal matches as many code points as it has, whatever their case: what is before the first match tells its place.
    quoted = F.concat(F.lit(r"(?iU)(?<!\w)"), F.regexp_replace("phrase", r"([.+*?^${}()|\[\]\\])", r"\\$1"), F.lit(r"(?!\w)"))
    near = near.withColumn("parts", F.when(F.col("t").isNotNull(), F.split("t", quoted, 2))).where("t IS NULL OR size(parts) = 2")
    start = F.length(F.col("parts")[0]) + 1
    end = start + F.length("phrase") - 1
    left, right = F.greatest(start - AROUND, F.lit(1)), end + AROUND
    there = lambda c, x: F.when(F.col("t").isNull(), F.col(c)).otherwise(x)
    more = lambda c, x: F.when(there(c, x), "…").otherwise("")
    snippet = F.concat(more("more_before", left > 1), F.trim(there("around", F.substring(F.col("t"), left, right - left + 1))), more("more_after", right < F.length("t")))
    near = near.select("crawl", "phrase", "source_id", "source_url", "d", "links_in", there("found", F.substring(F.col("t"), start, F.length("phrase"))).alias("anchor_text"), snippet.alias("snippet"))
    near = table(near, "suggest-sources")

    one = ["crawl", "phrase"]
    linked = table(links.where("target_id IS NOT NULL").select("source_id", "target_id").distinct(), "suggest-links")
    passed = linked.join(wanted.select("target_id", "phrase_no", *one), "target_id").join(near.select(*one, "source_id"), [*one, "source_id"])
    passed = passed.groupBy("target_id", "phrase_no").agg(F.count("*").alias("passed"))
    asks = wanted.join(passed, ["target_id", "phrase_no"], "left").withColumn("need", 2 * PER_TARGET + F.coalesce(F.col("passed"), F.lit(0)).cast("int"))
    asks = table(asks, "suggest-asks")
    order = (F.col("d"), F.desc("links_in"), F.col("source_url"))
    # parts are ranked before the join by phrase, which would deal all sources of a phrase to one task
    ranked = near.withColumn("part", F.pmod(F.xxhash64("source_id"), F.lit(PARTS)))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*one, "part").orderBy(*order))).where(F.col("r") <= (asks.agg(F.max("need")).first()[0] or 0))
    ranked = ranked.join(asks.groupBy(*one).agg(F.max("need").alias("most")), one)
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy(*one).orderBy(*order))).where("r <= most")
    hits = asks.withColumn("r", F.explode(F.sequence(F.lit(1), "need"))).join(ranked.drop("part", "most"), [*one, "r"])
    hits = hits.where("source_id <> target_id").join(linked, ["source_id", "target_id"], "left_anti")
    # a source counts once for a target, with its first phrase
    once = Window.partitionBy("target_id", "source_id").orderBy("phrase_no")
    best = Window.partitionBy("target_id").orderBy("phrase_no", "r")
    hits = hits.withColumn("k", F.row_number().over(once)).where("k = 1").withColumn("k", F.row_number().over(best)).where(F.col("k") <= PER_TARGET)
    relevance = half_up(F.least(F.lit(1.0), F.size("words") / 6.0) * 0.8 + F.when(F.col("important"), 0.2).otherwise(0.0), 2)
    reason = F.concat(F.lit("“"), F.col("anchor_text"), F.lit("” in this text is what "), F.col("target_url"), F.lit(" is about, without a link to it; pages that link there: "), F.coalesce(F.col("target_links"), F.lit(0)).cast("string"), F.lit("."))
    out = hits.select(F.col("crawl").alias("crawl_job_id"), "source_id", "target_id", "source_url", "target_url", "anchor_text", "snippet", reason.alias("reason"), relevance.alias("relevance"), F.pmod(F.xxhash64("target_id"), F.lit(PARTS)).alias("part"))
    first = (F.desc("relevance"), F.col("target_url"), F.col("source_url"))
    for keys in (["crawl_job_id", "part"], ["crawl_job_id"]):
        out = out.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*first))).where(F.col("r") <= TOTAL)
    return out.drop("part", "r").orderBy(*first)


def listing(suggestions: DataFrame, pages: DataFrame) -> DataFrame:
    """Suggestions with the titles of both pages and the place in the list of their crawl: most relevant first, then by the
    address of the target (then of the source)."""
    titled = lambda side: pages.select(F.col("id").alias(f"{side}_id"), F.col("title").alias(f"{side}_title"))
    by = Window.partitionBy("crawl_job_id").orderBy(F.desc("relevance"), "target_url", "source_url")  # at most 500 rows
    return suggestions.join(titled("source"), "source_id").join(titled("target"), "target_id").withColumn("place", F.row_number().over(by))
