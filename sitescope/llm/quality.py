"""Quality rules: base rules, then robust multivariate outliers for each language and source. DataFrame functions only.

Documents that pass the base rules are vectors of four transformed statistics: the logarithm of the mean word length, and
the square roots of symbols, repeated lines and repeated words per word. Each is smoothed by some pseudo-words, so that a
short document is not judged by the chance of a few words, and held in fixed point, so that sums are exact and reruns agree.

The estimate of a group is the minimum covariance determinant one. From each of three starts (medians and median deviations,
medians and fixed scales, mean and covariance of all) it concentrates: the SUPPORT part of the documents with the smallest
Mahalanobis distances gives the next mean and covariance, for as long as the determinant falls (STEPS times at most); of the
three ends that with the smallest determinant stays. All rows take part; a step is one aggregation for the quantile and one
for the moments over all groups and starts at once, both with map-side partial sums, and groups of any size never meet in a
task. A fixed scale for each statistic is added to the covariance (a statistic that is zero in nearly all documents would
otherwise make it singular and every other document an outlier). Documents beyond LIMIT are rejected.

Estimates are made for the corpus, each language, and each language and source. A language's is drawn to the corpus' and a
source's to its language's with a weight that falls with the square of its documents, PRIOR of them having a half: small
groups are judged nearly as the pool they are in, large ones by themselves, without a size at which the rule changes. Only a corpus of fewer than MIN_CORPUS
documents that pass the base rules has no estimate, and none of its documents is rejected by one.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, join_small, table, text_of

MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
MIN_CORPUS, PRIOR, SUPPORT, STEPS = 200, 200, 0.75, 12
#: Squared distance: the quantile 1 - 1e-6 of chi-squared with four degrees of freedom.
LIMIT = 33.4
#: Fixed point of the statistics, and the scale of each that is always tolerated (in statistics' units).
POINT, SCALES = 10_000, (0.08, 0.05, 0.06, 0.12)
X = ("x1", "x2", "x3", "x4")
#: Quantile of chi-squared (4) at SUPPORT, and what the covariance of that part has to be multiplied by.
_Q = 5.385
CONSISTENCY = SUPPORT / (1 - exp(-_Q / 2) * (1 + _Q / 2 + _Q * _Q / 8))


PAIRS = tuple((i, j) for i in range(1, 5) for j in range(1, i + 1))
MEANS, COVARIANCES, FACTORS = (tuple(f"m{i}" for i in range(1, 5)), *(tuple(f"{c}{i}{j}" for i, j in PAIRS) for c in "ac"))
KEYS = ("doc_id", "lang", "source")


def statistics(docs: DataFrame, columns: tuple[str, ...] = KEYS) -> DataFrame:
    """The base statistics of every row's whole text, as columns beside the struct ``doc`` of ``columns``."""
    text = text_of()
    rows = docs.select(F.struct(*columns).alias("doc"), text.alias("t"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))
    none = F.array().cast("array<bigint>")
    rows = rows.select(
        "doc",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.size("w") >= WINDOW, windows).otherwise(none).alias("h"),
    )
    found = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    rows = rows.select(
        "doc",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) < F.size("h"), found).alias("s"),
    )
    twice = F.filter("s", lambda x, i: (F.get("s", i - 1)["h"] == x["h"]) | (F.get("s", i + 1)["h"] == x["h"]))
    rows = rows.withColumn("at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + WINDOW - F.greatest(a["end"] - x, F.lit(0))).alias("n"), (x + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    # A generator, as filters on the statistics are not pushed through it: below, they would repeat the work on the text.
    rows = rows.select("doc", F.inline(F.array(F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def vectors(stats: DataFrame) -> DataFrame:
    """(lang, source, x1 to x4) of rows that pass the base rules. The order of the arithmetic is part of the result."""
    n = F.col("n_words").cast("double")
    per = lambda c: F.sqrt(F.col(c) / (n + 20.0))
    made = (F.log((F.col("word_chars") + 500.0) / (n + 100.0)), per("n_symbols"), per("n_dup_lines"), per("n_repeat_words"))
    return stats.select("*", *[F.floor(x * float(POINT) + 0.5).cast("long").alias(c) for c, x in zip(X, made, strict=True)])


def groups_of(level: int) -> Column:
    """The group of a row: the corpus (0), its language (1), its language and source (2). Null is a value like any other."""
    none = F.lit(None).cast("string")
    lang, source = F.col("lang") if level else none, F.col("source") if level > 1 else none
    return F.struct(F.lit(level).alias("level"), lang.cast("string").alias("l"), source.cast("string").alias("s"))


def _bucket(d: Column) -> Column:
    return F.floor(F.log(1.0 + d) * 64.0).cast("long")


def _sums() -> list[Column]:
    exact = lambda c: F.sum(c.cast("decimal(20,0)"))
    sums = [exact(F.col(x)).alias(f"s{i}") for i, x in enumerate(X, 1)]
    return [F.count("*").alias("n"), *sums, *[exact(F.col(X[i - 1]) * F.col(X[j - 1])).alias(f"p{i}{j}") for i, j in PAIRS]]


def _moments(sums: DataFrame) -> DataFrame:
    """Means m1.. and covariances a11, a21.. (corrected for the part that is left out) from counts and sums."""
    n = F.col("n").cast("double")
    keys = [c for c in ("grp", "start") if c in sums.columns]
    rows = sums.select(*keys, n.alias("n"), *[(F.col(f"s{i}").cast("double") / n).alias(f"m{i}") for i in range(1, 5)], *[F.col(f"p{i}{j}").cast("double").alias(f"p{i}{j}") for i, j in PAIRS])
    cov = [((F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * F.lit(CONSISTENCY)).alias(f"a{i}{j}") for i, j in PAIRS]
    return rows.select(*keys, *MEANS, *cov)


def _factored(rows: DataFrame) -> DataFrame:
    """Adds the lower triangle c11, c21.. of the regularized covariance's Cholesky factor, and its determinant's root ``det``."""
    for i, j in PAIRS:
        a = F.col(f"a{i}{j}")
        if i == j:
            a = a + F.lit((SCALES[i - 1] * POINT) ** 2)
        for k in range(1, j):
            a = a - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
        rows = rows.withColumn(f"c{i}{j}", F.sqrt(a) if i == j else a / F.col(f"c{j}{j}"))
    return rows.withColumn("det", F.col("c11") * F.col("c22") * F.col("c33") * F.col("c44"))


def _starts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups (grp, size), and of each group three starts. Their determinants do not count."""
    mid = [F.percentile(x, 0.5).alias(f"m{i}") for i, x in enumerate(X, 1)]
    mid = table(rows.groupBy("grp").agg(*_sums(), *[c.alias(f"mid{i}") for i, c in enumerate(mid, 1)]), "quality-medians")
    off = [F.percentile(F.abs(F.col(x) - F.col(f"mid{i}")), 0.5).alias(f"off{i}") for i, x in enumerate(X, 1)]
    mids = mid.select("grp", *[f"mid{i}" for i in range(1, 5)])
    off = join_small(rows, mids, ["grp"]).groupBy("grp").agg(*off, *[F.first(f"mid{i}").alias(f"m{i}") for i in range(1, 5)])
    own = lambda wide: [F.lit(0.0).alias(f"a{i}{j}") if i != j else wide(i).alias(f"a{i}{i}") for i, j in PAIRS]
    wide = off.select("grp", F.lit(0).alias("start"), *MEANS, *own(lambda i: 1.4826 * F.col(f"off{i}") * 1.4826 * F.col(f"off{i}")))
    fixed = off.select("grp", F.lit(1).alias("start"), *MEANS, *own(lambda i: F.lit(0.0)))
    plain = _moments(mid.withColumn("start", F.lit(2)))
    found = _factored(wide.unionByName(fixed).unionByName(plain)).withColumn("det", F.lit(float("inf"))).withColumn("open", F.lit(True))
    return mid.select("grp", F.col("n").alias("size")), table(found, "quality-starts")


def _distance(rows: DataFrame, estimate: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Adds d, the squared Mahalanobis distance; null where there is no estimate."""
    kept = [F.col(c) for c in dict.fromkeys([*rows.columns, *keys])]
    rows = join_small(rows, estimate.select(*keys, *MEANS, *FACTORS), keys, how)
    d = F.lit(0.0)
    for i, x in enumerate(X, 1):
        y = F.col(x) - F.col(f"m{i}")
        for k in range(1, i):
            y = y - F.col(f"c{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", y / F.col(f"c{i}{i}"))
        d = d + F.col(f"y{i}") * F.col(f"y{i}")
    return rows.select(*kept, d.alias("d"))


def concentrated(rows: DataFrame) -> DataFrame:
    """(grp, size, m1.., a11..): the estimate with the smallest determinant of every group of the vectors (grp, x1 to x4)."""
    sizes, now = _starts(rows)
    rows = rows.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    for _ in range(STEPS):
        near = _distance(rows, now.where("open"), ["grp", "start"], "inner").withColumn("b", _bucket(F.col("d")))
        cut = table(near.groupBy("grp", "start").agg(F.percentile("b", SUPPORT).alias("q")), "quality-cut")
        half = join_small(near, cut, ["grp", "start"], "inner").where("b <= q")
        new = _factored(_moments(half.groupBy("grp", "start").agg(*_sums())))
        new = new.select(F.col("grp").alias("g"), F.col("start").alias("k"), F.struct(*MEANS, *COVARIANCES, *FACTORS, "det").alias("new"))
        both = now.join(new, F.col("grp").eqNullSafe(F.col("g")) & (F.col("start") == F.col("k")), "left")
        falls = F.coalesce(F.col("new.det") < F.col("det"), F.lit(False))
        cols = [F.when(falls, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in (*MEANS, *COVARIANCES, *FACTORS, "det")]
        now = table(both.select("grp", "start", *cols, falls.alias("open")), "quality-estimates")
        if not now.where("open").head(1):
            break
    best = now.groupBy("grp").agg(F.min_by(F.struct(*MEANS, *COVARIANCES), F.struct("det", "start")).alias("best"))
    best = best.withColumnRenamed("grp", "g").join(sizes, F.col("g").eqNullSafe(F.col("grp")))
    return table(best.select("grp", "size", "best.*"), "quality-best")


def _drawn(own: DataFrame, pool: DataFrame, level: int) -> DataFrame:
    """The estimates of a level, drawn to those of the level above."""
    cols = (*MEANS, *COVARIANCES)
    up = pool.select(F.col("grp.l").alias("up"), *[F.col(c).alias(f"pool_{c}") for c in cols])
    own = own.where(F.col("grp.level") == level)
    own = own.join(up, F.col("up").eqNullSafe(F.col("grp.l"))) if level > 1 else own.crossJoin(F.broadcast(up))  # the corpus is one row
    square = F.col("size").cast("double") * F.col("size")
    w = square / (square + F.lit(float(PRIOR * PRIOR)))
    return own.select("grp", "size", *[(F.col(c) * w + F.col(f"pool_{c}") * (1.0 - w)).alias(c) for c in cols])


def estimate(rows: DataFrame) -> DataFrame:
    """The estimate of every language and source (grp, means, Cholesky factor) from vectors (lang, source, x1 to x4)."""
    parts = F.array(*[groups_of(level) for level in range(3)])
    found = concentrated(rows.select(F.explode(parts).alias("grp"), *X))
    corpus = found.where((F.col("grp.level") == 0) & (F.col("size") >= MIN_CORPUS))
    return table(_factored(_drawn(found, _drawn(found, corpus, 1), 2)), "quality-estimate")


def judge(docs: DataFrame, columns: tuple[str, ...] = KEYS) -> DataFrame:
    """The statistics of every row, base_failed and kept. ``columns`` go along in the struct ``doc`` ("*": all of them).

    Null and empty texts have no words and fail; very long texts are counted whole; null lang or source is a group of its
    own; repeated rows and ties are judged alike. An empty table gives no rows, and other columns may have any names. Texts
    are read once: the estimates run over a table of the statistics, and of ``doc``, which they do not read.
    """
    made = vectors(statistics(docs, columns).withColumns({c: F.col(f"doc.{c}") for c in KEYS}))
    stats = table(made, "quality-stats")
    found = estimate(stats.where("NOT base_failed"))
    judged = _distance(stats.withColumn("grp", groups_of(2)), found, ["grp"])
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d") <= LIMIT, F.lit(True)))


def quality_report(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, as they are."""
    return judge(docs, ("*",)).where("kept").select("doc.*")
