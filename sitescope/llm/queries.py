"""Queries of the pipeline operators over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, licenses, lines, mixing, multiset, packing, quality, runs, sharding, simhash, tokens, warc, whitening


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(read(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(read(spark, sf_dir, "embeddings"))


def op12_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.fingerprint_report(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash": op4_simhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_sharding": op6_sharding,
    "op7_token_counts": op7_token_counts,
    "op8_nearest": op8_nearest,
    "op9_licenses": op9_licenses,
    "op10_packing": op10_packing,
    "op11_whitening": op11_whitening,
    "op12_multiset_hash": op12_multiset_hash,
    "op13_periodic_runs": op13_periodic_runs,
}

WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

MIXING_SQL = rf"""
WITH s AS (SELECT doc_id, source, {WORDS}::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w, 2.0::DOUBLE * source_size AS most FROM per),
k AS (SELECT *, most / w AS ratio, row_number() OVER (ORDER BY most / w, source NULLS LAST) AS k FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM k),
t AS (SELECT source, source_size, CASE WHEN level > ratio THEN most ELSE w * (SELECT arg_min(level, k) FROM l WHERE level <= ratio) END AS target FROM l),
n AS (SELECT *, length(bin(size))::BIGINT AS cls FROM s),
cw AS (SELECT source, cls, sum(size)::BIGINT AS words FROM n GROUP BY source, cls),
ct AS (SELECT cw.*, source_size, target,
    target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY cw.source ORDER BY cls DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rem,
    (sum(cls * words) OVER (PARTITION BY cw.source ORDER BY cls DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest FROM cw JOIN t ON cw.source IS NOT DISTINCT FROM t.source),
cr AS (SELECT *, CASE WHEN rest > 0 THEN rem / rest ELSE 0.0 END AS rate FROM ct),
cf AS (SELECT source, max(cls) AS top, arg_max(rate, cls) AS rate FROM cr WHERE rate * cls <= 2 GROUP BY source),
r AS (SELECT cr.source, cr.cls, words, source_size, target, CASE WHEN source_size = 0 THEN 0.0 WHEN cf.top IS NULL OR cr.cls > cf.top THEN 2.0 ELSE cf.rate * cr.cls END::DOUBLE AS rate
    FROM cr LEFT JOIN cf ON cr.source IS NOT DISTINCT FROM cf.source),
p AS (SELECT *, floor(rate)::BIGINT AS whole, rate - floor(rate) AS p, target - (sum(floor(rate)::BIGINT * words) OVER (PARTITION BY source))::BIGINT AS rem FROM r),
h AS (SELECT s.doc_id, s.size, p.*, (('0x' || substr(md5('mix|' || coalesce(s.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u FROM n s JOIN p ON s.source IS NOT DISTINCT FROM p.source AND s.cls = p.cls),
q AS (SELECT *, CASE WHEN p > 0 AND whole < 2 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM h),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id) AS upto FROM q WHERE q IS NOT NULL),
i AS (SELECT *, upto <= rem AS inside FROM c),
g AS (SELECT source, any_value(rem) - coalesce(sum(size) FILTER (inside), 0) AS gap FROM i GROUP BY source),
f AS (SELECT i.source, arg_min(doc_id, (abs(size - gap), q, doc_id)) AS fill_id FROM i JOIN g ON i.source IS NOT DISTINCT FROM g.source WHERE NOT inside AND abs(size - gap) < gap GROUP BY i.source)
SELECT q.doc_id, q.size, q.source_size, q.target,
    (q.size * (q.whole + CASE WHEN coalesce(i.inside, false) OR (i.doc_id IS NOT NULL AND coalesce(i.doc_id = f.fill_id, false)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM q LEFT JOIN i ON q.doc_id = i.doc_id LEFT JOIN f ON q.source IS NOT DISTINCT FROM f.source
"""

LINES_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
d AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.doc_id, k.k, k.line, d.key IS NOT NULL AND k.doc_id <> d.keeper AS gone FROM k LEFT JOIN d ON k.key = d.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""



def quality_sql() -> str:
    """The quality rules in SQL, with the concentration steps written out."""
    q, x, pairs = quality, quality.X, quality.PAIRS
    same = lambda a, b: f"{a}.grp IS NOT DISTINCT FROM {b}.grp"
    scale = [(s * q.POINT) ** 2 for s in q.SCALES]
    parts = [
        rf"""w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)""",
        """g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w)""",
        """r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS c FROM g)""",
        """p AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM r WHERE c > 1)""",
        """rep AS (SELECT doc_id, sum(n)::BIGINT AS n_repeat_words FROM p GROUP BY doc_id)""",
        r"""b AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
            (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
              - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
            coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id)""",
        f"""v AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED} * n_words AS base_failed,
            floor(ln((word_chars + 500.0::DOUBLE) / (n_words + 100.0::DOUBLE)) * {q.POINT} + 0.5)::BIGINT AS x1,
            floor(sqrt(n_symbols / (n_words + 20.0::DOUBLE)) * {q.POINT} + 0.5)::BIGINT AS x2, floor(sqrt(n_dup_lines / (n_words + 20.0::DOUBLE)) * {q.POINT} + 0.5)::BIGINT AS x3,
            floor(sqrt(n_repeat_words / (n_words + 20.0::DOUBLE)) * {q.POINT} + 0.5)::BIGINT AS x4 FROM b)""",
        """u AS (SELECT unnest([{'level': 0, 'l': NULL::VARCHAR, 's': NULL::VARCHAR}, {'level': 1, 'l': lang, 's': NULL::VARCHAR}, {'level': 2, 'l': lang, 's': source}]) AS grp, x1, x2, x3, x4 FROM v WHERE NOT base_failed)""",
        "med AS (SELECT grp, count(*)::DOUBLE AS n, " + ", ".join(f"quantile_cont({c}, 0.5) AS m{i}" for i, c in enumerate(x, 1)) + " FROM u GROUP BY grp)",
        "mad AS (SELECT u.grp, " + ", ".join(f"quantile_cont(abs({c} - m{i}), 0.5) AS d{i}" for i, c in enumerate(x, 1)) + f" FROM u JOIN med ON {same('u', 'med')} GROUP BY u.grp)",
    ]
    means, covs = ", ".join(q.MEANS), ", ".join(q.COVARIANCES)
    state = (*q.MEANS, *q.COVARIANCES, *q.FACTORS, "det")

    def moments(rows: str, keys: str) -> str:
        sums = [f"sum({c})::DOUBLE / count(*)::DOUBLE AS m{i}" for i, c in enumerate(x, 1)] + [f"sum({x[i - 1]} * {x[j - 1]})::DOUBLE AS p{i}{j}" for i, j in pairs]
        inner = f"SELECT {keys}, count(*)::DOUBLE AS n, {', '.join(sums)} FROM {rows} GROUP BY {keys}"
        return f"SELECT {keys}, {means}, " + ", ".join(f"(p{i}{j} / n - m{i} * m{j}) * {q.CONSISTENCY!r}::DOUBLE AS a{i}{j}" for i, j in pairs) + f" FROM ({inner})"

    def factored(inner: str) -> str:
        for i, j in pairs:
            a = f"(a{i}{j}" + (f" + {scale[i - 1]!r}::DOUBLE" if i == j else "") + "".join(f" - c{i}{t} * c{j}{t}" for t in range(1, j)) + ")"
            inner = f"SELECT *, {f'sqrt{a}' if i == j else f'{a} / c{j}{j}'} AS c{i}{j} FROM ({inner})"
        return f"SELECT *, c11 * c22 * c33 * c44 AS det FROM ({inner})"

    def distance(rows: str, found: str, on: str, keep: str) -> str:
        made = [f"({c} - m{i}" + "".join(f" - c{i}{k} * y{k}" for k in range(1, i)) + f") / c{i}{i} AS y{i}" for i, c in enumerate(x, 1)]
        inner = f"SELECT {keep}, {rows}.x1, {rows}.x2, {rows}.x3, {rows}.x4, {means}, {', '.join(q.FACTORS)}, {made[0]} FROM {rows} LEFT JOIN {found} ON {on}"
        for m in made[1:]:
            inner = f"SELECT *, {m} FROM ({inner})"
        return f"SELECT *, 0.0::DOUBLE + y1 * y1 + y2 * y2 + y3 * y3 + y4 * y4 AS d FROM ({inner})"

    diagonal = lambda wide: ", ".join(f"{wide(i) if i == j else '0.0::DOUBLE'} AS a{i}{j}" for i, j in pairs)
    mids = f"FROM med JOIN mad ON {same('med', 'mad')}"
    starts = f"SELECT med.grp, 0 AS start, {means}, {diagonal(lambda i: f'1.4826::DOUBLE * d{i} * 1.4826::DOUBLE * d{i}')} {mids}"
    starts += f" UNION ALL SELECT med.grp, 1, {means}, {diagonal(lambda i: '0.0::DOUBLE')} {mids}"
    starts += f" UNION ALL SELECT grp, 2, {means}, {covs} FROM ({moments('u', 'grp')})"
    parts.append(f"e0 AS (SELECT * REPLACE ('infinity'::DOUBLE AS det) FROM ({factored(starts)}))")
    for k in range(q.STEPS):
        parts.append(f"b{k} AS (SELECT grp, start, x1, x2, x3, x4, floor(ln(1.0::DOUBLE + d) * 64.0::DOUBLE)::BIGINT AS b FROM ({distance('u', f'e{k}', same('u', f'e{k}'), f'u.grp, e{k}.start')}))")
        parts.append(f"q{k} AS (SELECT grp, start, quantile_cont(b, {q.SUPPORT}) AS q FROM b{k} GROUP BY grp, start)")
        half = f"(SELECT b{k}.* FROM b{k} JOIN q{k} ON {same(f'b{k}', f'q{k}')} AND b{k}.start = q{k}.start WHERE b <= q)"
        parts.append(f"n{k} AS ({factored(moments(half, 'grp, start'))})")
        cols = ", ".join(f"CASE WHEN n{k}.det < e{k}.det THEN n{k}.{c} ELSE e{k}.{c} END AS {c}" for c in state)
        parts.append(f"e{k + 1} AS (SELECT e{k}.grp, e{k}.start, {cols} FROM e{k} LEFT JOIN n{k} ON {same(f'e{k}', f'n{k}')} AND e{k}.start = n{k}.start)")
    parts.append(f"best AS (SELECT e.grp, n AS size, {means.replace('m', 'e.m')}, {covs} FROM (SELECT * FROM e{q.STEPS} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY det, start) = 1) e JOIN med ON {same('e', 'med')})")
    parts.append(f"l0 AS (SELECT * FROM best WHERE grp.level = 0 AND size >= {q.MIN_CORPUS})")
    for level in (1, 2):
        up = f"p.grp.l IS NOT DISTINCT FROM b.grp.l" if level == 2 else "true"
        w = f"(b.size * b.size / (b.size * b.size + {float(q.PRIOR * q.PRIOR)!r}::DOUBLE))"
        cols = ", ".join(f"b.{c} * {w} + p.{c} * (1.0::DOUBLE - {w}) AS {c}" for c in (*q.MEANS, *q.COVARIANCES))
        parts.append(f"l{level} AS (SELECT b.grp, b.size, {cols} FROM best b JOIN l{level - 1} p ON {up} WHERE b.grp.level = {level})")
    parts.append(f"last AS ({factored('SELECT * FROM l2')})")
    stats = "v.doc_id, v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed"
    final = distance("v", "last", "v.lang IS NOT DISTINCT FROM last.grp.l AND v.source IS NOT DISTINCT FROM last.grp.s", stats)
    return "WITH " + ",\n".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts) + f"""
SELECT {stats.replace('v.', '')}, NOT base_failed AND coalesce(d <= {q.LIMIT}, true) AS kept FROM ({final})"""


def licenses_sql() -> str:
    """The license scan in SQL: every unit against every template of its kind, without anchors."""
    lc = licenses
    kinds = [(0, lc.TEMPLATES), (1, lc.whole_texts())]
    rows = ", ".join(f"({kind}, {k}, '{name}', '{' '.join(lc.terms(text))}')" for kind, found in kinds for k, (name, text) in enumerate(found))
    return f"""
WITH texts(kind, k, name, t) AS (VALUES {rows}),
tpl AS MATERIALIZED (SELECT kind, k, any_value(name) AS name, term, 1 + ln(count(*)) AS c FROM (SELECT kind, k, name, unnest(string_split(t, ' ')) AS term FROM texts) GROUP BY kind, k, term),
doc AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT count(*) AS n FROM doc),
held AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS term FROM doc),
idf AS MATERIALIZED (SELECT kind, v.term, ln((1 + (SELECT n FROM n))::DOUBLE / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT DISTINCT kind, term FROM tpl) v
    JOIN (SELECT v.term, count(held.doc_id) AS df FROM (SELECT DISTINCT term FROM tpl) v LEFT JOIN held ON held.term = v.term GROUP BY v.term) d ON v.term = d.term),
len AS (SELECT tpl.kind, k, any_value(name) AS name, sqrt(sum(c * c * idf * idf)) AS len, count(*) FILTER (tpl.kind = 0 AND regexp_full_match(tpl.term, '[0-9]+')) AS must FROM tpl JOIN idf ON tpl.kind = idf.kind AND tpl.term = idf.term GROUP BY tpl.kind, k),
u AS MATERIALIZED (SELECT *, row_number() OVER () AS uid FROM (
    SELECT doc_id, 0 AS kind, unnest(list_distinct(list_concat(string_split(t, chr(10)), regexp_split_to_array(t, '\\n[ \\t\\r]*\\n'), [t]))) AS u FROM doc UNION ALL SELECT doc_id, 1, t FROM doc)),
x AS MATERIALIZED (SELECT uid, any_value(kind) AS kind, term, 1 + ln(count(*)) AS c FROM (SELECT uid, kind, unnest(regexp_extract_all(lower(u), '[a-z0-9]+')) AS term FROM u) GROUP BY uid, term),
q AS (SELECT uid, sqrt(sum(power(c * coalesce(idf, ln(1 + (SELECT n FROM n)::DOUBLE) + 1), 2))) AS len FROM x LEFT JOIN idf ON x.kind = idf.kind AND x.term = idf.term GROUP BY uid),
dot AS (SELECT x.uid, x.kind, tpl.k, sum(x.c * tpl.c * idf * idf) AS dot, count(*) FILTER (x.kind = 0 AND regexp_full_match(x.term, '[0-9]+')) AS held FROM x JOIN tpl ON x.kind = tpl.kind AND x.term = tpl.term JOIN idf ON x.kind = idf.kind AND x.term = idf.term GROUP BY x.uid, x.kind, tpl.k),
s AS (SELECT u.doc_id, dot.kind, dot.k, len.name, round(dot / q.len / len.len, 6) AS score FROM dot JOIN q ON dot.uid = q.uid JOIN len ON dot.kind = len.kind AND dot.k = len.k JOIN u ON dot.uid = u.uid WHERE held = must),
own AS MATERIALIZED (SELECT doc_id, arg_max(name, (score, kind, -k)) AS own_license, max(score) AS own_score FROM s WHERE score >= {lc.THRESHOLD} GROUP BY doc_id),
f AS MATERIALIZED (SELECT d.doc_id, own_license, own_score, (d.doc_id // 1000)::VARCHAR AS a, (d.doc_id // 1000)::VARCHAR || '/' || (d.doc_id // 100)::VARCHAR AS b,
    CASE WHEN d.doc_id % 1000 = 0 THEN (d.doc_id // 1000)::VARCHAR || '/LICENSE' WHEN d.doc_id % 100 = 0 THEN (d.doc_id // 1000)::VARCHAR || '/' || (d.doc_id // 100)::VARCHAR || '/LICENSE'
    ELSE (d.doc_id // 1000)::VARCHAR || '/' || (d.doc_id // 100)::VARCHAR || '/' || d.doc_id::VARCHAR || '.txt' END AS path FROM doc d LEFT JOIN own ON d.doc_id = own.doc_id),
g AS MATERIALIZED (SELECT regexp_replace(path, '/[^/]*$', '') AS up, coalesce(own_license, '{lc.UNKNOWN}') AS given FROM f WHERE path LIKE '%/LICENSE')
SELECT f.doc_id, f.own_license, f.own_score, f.path, coalesce(f.own_license, CASE WHEN f.doc_id % 1000 <> 0 THEN gb.given END, ga.given) AS license,
    CASE WHEN f.own_license IS NULL THEN coalesce(CASE WHEN f.doc_id % 1000 <> 0 THEN gb.up END, ga.up) END AS inherited_from
FROM f LEFT JOIN g ga ON ga.up = f.a LEFT JOIN g gb ON gb.up = f.b
"""


def multiset_sql() -> str:
    """The fingerprints in SQL: pieces as rows, one sum for each counter; edited texts from the beginning."""
    number = lambda md5, at: f"('0x' || substr({md5}, {at}, 15))::BIGINT"
    counted = ", ".join(f"(count(*) FILTER (b = {s}))::BIGINT % 32768 AS c{s}" for s in range(128))
    limbs = [" + ".join(f"(c{s + k}::BIGINT << {15 * k})" for k in range(4)) for s in range(0, 128, 4)]
    signed = [f"(128 * c{s} - m % 4194304 + 6291456) % 4194304 - 2097152" for s in range(128)]
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, ''))) AS r FROM documents),
nx AS MATERIALIZED (SELECT d.*, length(d.t)::BIGINT AS n, coalesce(o.r, f.r) AS nr, coalesce(o.t, f.t) AS nt FROM d LEFT JOIN d o ON o.r = d.r + 1 LEFT JOIN d f ON f.r = 1 AND o.r IS NULL),
e AS MATERIALIZED (SELECT *, substr(t, 1, n - n // 2) || substr(nt, 1, n // 2) AS e FROM nx),
x AS (SELECT r, 0 AS k, t FROM d UNION ALL SELECT r, 1, e FROM e),
p AS MATERIALIZED (SELECT r, k, unnest(string_split(t, chr(10))) AS p FROM x),
w AS MATERIALIZED (SELECT r, k, sum({number('md5(p)', 1)})::HUGEINT % 1152921504606846976 AS p1, sum({number('md5(p)', 16)})::HUGEINT % 1152921504606846976 AS p2 FROM p GROUP BY r, k),
ws AS (SELECT r, k, regexp_extract_all(p, '[^ 	-
]+') AS ws FROM p),
g AS (SELECT r, k, md5(unnest(list_transform(ws, lambda w, i: (CASE WHEN i > 1 THEN ws[i - 1] ELSE '' END) || ' ' || w))) AS h FROM ws),
c AS MATERIALIZED (SELECT r, k, count(*)::BIGINT AS m, {counted} FROM (SELECT r, k, ('0x' || substr(h, 1, 2))::BIGINT % 128 AS b FROM g) GROUP BY r, k),
z AS (SELECT w.r, w.k, p1, p2, coalesce(m, 0) AS m, {', '.join(f'coalesce(c{s}, 0)::BIGINT AS c{s}' for s in range(128))} FROM w LEFT JOIN c ON w.r = c.r AND w.k = c.k),
fp AS MATERIALIZED (SELECT r, k, [m, p1::BIGINT, p2::BIGINT, {', '.join(limbs)}] AS fp, [{', '.join(signed)}] AS s FROM z),
lim AS MATERIALIZED (SELECT e.doc_id, e.n, e.e, a.fp AS fa, b.fp AS fb, c.fp AS fc, a.s AS sa, b.s AS sb, c.s AS sc
    FROM e JOIN fp a ON a.r = e.r AND a.k = 0 JOIN fp b ON b.r = e.r AND b.k = 1 JOIN fp c ON c.r = e.nr AND c.k = 0),
q AS (SELECT *, list_dot_product(sa::DOUBLE[], sb::DOUBLE[]) AS ab, list_dot_product(sa::DOUBLE[], sc::DOUBLE[]) AS ac, list_dot_product(sa::DOUBLE[], sa::DOUBLE[]) AS aa,
    list_dot_product(sb::DOUBLE[], sb::DOUBLE[]) AS bb, list_dot_product(sc::DOUBLE[], sc::DOUBLE[]) AS cc FROM lim)
SELECT doc_id, n AS n_chars, sha256(e) AS edited_sha256, array_to_string(list_transform(fa, lambda v: printf('%015x', v)), '') AS fingerprint,
    array_to_string(list_transform(fb, lambda v: printf('%015x', v)), '') AS edited_fingerprint,
    CASE WHEN fa = fb THEN 1.0::DOUBLE WHEN aa + bb > 0 THEN least(greatest(2 * ab / (aa + bb), 0), 1) ELSE 0 END::DOUBLE AS near_edited,
    CASE WHEN fa = fc THEN 1.0::DOUBLE WHEN aa + cc > 0 THEN least(greatest(2 * ac / (aa + cc), 0), 1) ELSE 0 END::DOUBLE AS near_next
FROM q
"""


SQL = {
    "op12_multiset_hash": multiset_sql(),
    "op9_licenses": licenses_sql(),
    "op3_quality_rules": quality_sql(),
    "op5_line_dedup": LINES_SQL,
    "op2_mixing": MIXING_SQL,
}
