"""robots.txt as rules, and the longest-match decision for paths."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bytes that are read, and the longest delay.
MAX_CHARS, MAX_DELAY = 512 * 1024, 30.0


#: Ends of lines, and spaces around fields, as text editors know them.
LINE_END, EDGES = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]", r"(?U)^\s+|\s+$"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def parse_rules(files: DataFrame, key: str = "host", body: str = "body") -> DataFrame:
    """(key, agent, kind, value, grp, n) with kind allow, disallow, crawl-delay or sitemap (agent null), from robots.txt bodies.

    Agents that follow each other share the rules that follow; any other field between them, known or not, ends the run
    (sitemap lines and lines without a colon do not). Rules before any agent and empty values do not count. ``grp`` numbers the
    groups of a file, ``n`` its lines.
    """
    line = _stripped(F.regexp_replace(F.col("raw"), "(?s)#.*$", ""))
    rows = files.select(key, F.posexplode(F.split(F.left(F.col(body), F.lit(MAX_CHARS)), LINE_END)).alias("n", "raw")).select(key, "n", line.alias("line"))
    rows = rows.where(F.contains("line", F.lit(":")))
    field, value = F.substring_index("line", ":", 1), F.substr("line", F.locate(":", F.col("line")) + 1)
    rows = rows.select(key, "n", F.lower(_stripped(field)).alias("field"), _stripped(value).alias("value"))
    known = rows.where("field <> 'sitemap'")
    by = Window.partitionBy(key).orderBy("n")
    agent = F.col("field") == "user-agent"
    first = agent & ~F.coalesce(F.lag(agent).over(by), F.lit(False))
    known = known.withColumn("grp", F.sum(first.cast("int")).over(by)).where("grp > 0")
    agents = known.where(agent).select(key, "grp", F.lower("value").alias("agent")).distinct()
    rules = known.where(F.col("field").isin("allow", "disallow", "crawl-delay") & (F.col("value") != "")).select(key, "grp", "n", F.col("field").alias("kind"), "value")
    path = F.when(F.col("kind").isin("allow", "disallow") & ~F.col("value").rlike("^[/*]"), F.concat(F.lit("/"), F.col("value"))).otherwise(F.col("value"))
    out = agents.join(rules, [key, "grp"]).select(key, "agent", "kind", path.alias("value"), "grp", "n")
    maps = rows.where("field = 'sitemap' AND value <> ''").select(key, F.lit(None).cast("string").alias("agent"), F.lit("sitemap").alias("kind"), "value", F.lit(None).cast("long").alias("grp"), "n")
    return out.unionByName(maps)


def product_token(user_agent: str) -> str:
    return re.split("[/ ]", user_agent.strip(), maxsplit=1)[0].lower()


def rules_for(rules: DataFrame, user_agent: str, key: str = "host") -> DataFrame:
    """The rules of the groups that name the crawler; of the ``*`` groups where none does."""
    token = product_token(user_agent)
    own = rules.where(F.col("agent") == token)
    named = rules.where(F.col("agent") == token).select(key).distinct()
    return own.unionByName(rules.where("agent = '*'").join(named, key, "left_anti"))


def crawl_delay(rules: DataFrame, user_agent: str, key: str = "host") -> DataFrame:
    """The delay of every host that states one: of a group its last number, 0 at least; of several groups the largest."""
    low = F.lower("value")
    delay = F.when(F.col("value").rlike(NUMBER), F.greatest(F.col("value").try_cast("double"), F.lit(0.0)))
    delay = delay.when(low.rlike(r"^[+]?inf(inity)?$"), MAX_DELAY).when(low.rlike(r"^([+-]?nan|-inf(inity)?)$"), 0.0)
    rows = rules_for(rules, user_agent, key).where("kind = 'crawl-delay'").withColumn("delay", delay).where("delay IS NOT NULL")
    last = rows.groupBy(key, "grp").agg(F.max_by("delay", "n").alias("delay"))
    return last.groupBy(key).agg(F.least(F.max("delay"), F.lit(MAX_DELAY)).alias("crawl_delay"))


def pattern_regex(pattern: Column) -> Column:
    """A path pattern (``*`` anything, ``$`` at the end an anchor) as an anchored regular expression."""
    anchored = F.endswith(pattern, F.lit("$"))
    body = F.when(anchored, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("^"), quoted, F.when(anchored, F.lit("$")).otherwise(""))


def literal_prefix(pattern: Column) -> Column:
    """What a path has to begin with for the pattern to match: the pattern up to its first star or its anchor."""
    return F.regexp_extract(pattern, r"^([^*]*?)(\*.*|\$)?$", 1)


def decide(paths: DataFrame, rules: DataFrame, key: str = "host", path: str = "path") -> DataFrame:
    """Adds ``allowed``: the longest matching rule wins, allow on a tie; no match is allowed, as is /robots.txt.

    The rules of a host are a trie of literal prefixes by levels: a path looks up its own prefixes, of the lengths its host
    has, by equality, and only rules found so are matched; those without a star or anchor match as they are. So a path meets
    the few rules on its way, however many its host has. Distinct paths are matched once.
    """
    value = F.col("value")
    own = rules.where(F.col("kind").isin("allow", "disallow")).select(F.col(key).alias("rk"), (F.col("kind") == "allow").alias("ok"), F.length(value).alias("len"), literal_prefix(value).alias("prefix"), F.when(value.rlike(r"\*|\$$"), pattern_regex(value)).alias("rx"))
    own = own.groupBy("rk", "prefix", "rx", "len").agg(F.max("ok").alias("ok"))
    levels = own.groupBy(F.col("rk").alias("pk")).agg(F.collect_set(F.length("prefix")).alias("levels"))
    asked = paths.select(F.col(key).alias("pk"), F.col(path).alias("pp")).distinct().join(levels, "pk")
    ways = asked.withColumn("level", F.explode("levels")).where(F.col("level") <= F.length("pp"))
    ways = ways.select("pk", "pp", F.left(F.col("pp"), F.col("level")).alias("way"))
    met = ways.join(own, (F.col("pk") == F.col("rk")) & (F.col("way") == F.col("prefix"))).where(F.col("rx").isNull() | F.expr("pp RLIKE rx"))
    hits = met.groupBy("pk", "pp").agg(F.max(F.struct("len", "ok")).alias("best"))
    out = paths.join(hits, (F.col(key) == F.col("pk")) & (F.col(path) == F.col("pp")), "left")
    return out.withColumn("allowed", (F.col(path) == "/robots.txt") | F.coalesce(F.col("best.ok"), F.lit(True))).drop("pk", "pp", "best")


def policy(status: Column, path: Column, allowed: Column) -> Column:
    """unreachable: only /robots.txt; not_found: everything; found: the rules."""
    return F.when(status == "unreachable", path == "/robots.txt").when(status == "not_found", F.lit(True)).otherwise(allowed)
