import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sitescope.llm import multiset, queries

from ..compare import same


def plain(text):
    """The fingerprint by definition."""
    fp = [0] * multiset.LIMBS
    for p in text.split("\n"):
        whole = hashlib.md5(p.encode()).hexdigest()
        fp[1] = (fp[1] + int(whole[:15], 16)) % 2**60
        fp[2] = (fp[2] + int(whole[15:30], 16)) % 2**60
        words = [w for w in p.translate({c: " " for c in b"\t\x0b\x0c\r"}).split(" ") if w]
        for a, b in zip(["", *words], words, strict=False):
            h = hashlib.md5(f"{a} {b}".encode()).hexdigest()
            fp[0] += 1
            at, shift = divmod(int(h[:2], 16) % 128, 4)
            count = (fp[3 + at] >> 15 * shift) % 2**15
            fp[3 + at] += ((count + 1) % 2**15 - count) << 15 * shift
    return "".join(f"{v:015x}" for v in fp)


def report(df):
    return {r["doc_id"]: r for r in multiset.fingerprint_report(df).collect()}


def test_odd_documents(spark, odd, none):
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    rows = multiset.fingerprint_report(odd).collect()
    assert len(rows) == odd.count() and multiset.fingerprint_report(none).count() == 0
    order = [12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 2, 1, None]
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    for r in rows:
        text, n = texts[r["doc_id"]], len(texts[r["doc_id"]])
        assert r["n_chars"] == n and r["fingerprint"] == plain(text)
        if r["doc_id"] == 6:
            continue  # two equal rows: the first is followed by the second
        new = text[: n - n // 2] + texts[after[r["doc_id"]]][: n // 2]
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["edited_fingerprint"] == plain(new)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert sorted(r["near_next"] == 1.0 for r in rows if r["doc_id"] == 6) == [False, True]
    assert [r["near_next"] for r in rows if r["doc_id"] == 8] == [1.0]


def test_homomorphism(spark):
    """Order does not matter; inserting and deleting paragraphs is adding and taking off."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    pars = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(40)]
    shuffled = rng.sample(pars, len(pars))
    df = spark.createDataFrame([("\n".join(pars), "\n".join(shuffled), "\n".join(pars[:25]), "\n".join(pars[25:]))], "a string, b string, c string, d string")
    a, b, c, d = (multiset.fingerprint(F.col(x)) for x in "abcd")
    w = multiset.written
    r = df.select(w(a), w(b), w(multiset.plus(c, d)), w(multiset.minus(a, d)), w(c), w(multiset.minus(multiset.minus(a, c), d))).first()
    assert r[0] == r[1] == r[2] == plain("\n".join(pars)) and r[3] == r[4] and set(r[5]) == {"0"}


def test_likeness_is_the_shared_part(spark):
    """Against the part of pieces that two texts share: within five standard errors, for near and far texts."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(5000)]
    rows = []
    for k in range(40):
        a = [rng.choice(words) for _ in range(400)]
        cut = 10 * k
        rows.append((" ".join(a), " ".join(a[:cut] + [rng.choice(words) for _ in range(400 - cut)]), cut / 400))
    df = spark.createDataFrame(rows, "a string, b string, part double")
    got = df.select("part", multiset.likeness(multiset.fingerprint(F.col("a")), multiset.fingerprint(F.col("b"))).alias("near")).collect()
    assert all(abs(r["part"] - r["near"]) < 0.35 for r in got)
    assert sum(abs(r["part"] - r["near"]) for r in got) / len(got) < 0.09


def test_wrapped_counters(spark):
    """More pieces than a counter holds: sums are still those modulo powers."""
    text = "x " * 70_000
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(multiset.written(multiset.fingerprint(F.col("t")))).first()[0]
    first, more = plain("x"), plain("x x")
    for at in range(3, multiset.LIMBS):
        a, b = int(first[15 * at : 15 * at + 15], 16), int(more[15 * at : 15 * at + 15], 16)
        for f in (0, 15, 30, 45):
            one, both = (a >> f) % 2**15, (b >> f) % 2**15
            assert int(got[15 * at : 15 * at + 15], 16) >> f & 2**15 - 1 == (one + (both - one) * 69_999) % 2**15


@pytest.mark.parametrize("ids", ["id", "id % 3", "CASE WHEN id % 3 > 0 THEN id END", "id * 100000000000 - 77"])
def test_ranges(spark, duck, ids):
    """Thousands of documents, repeated and null ids among them, in many ranges: the order is that of SQL."""
    docs = spark.range(1500).selectExpr(f"{ids} AS doc_id", "concat('text ', id % 400, '\nend') AS text", "'x' AS range")
    con = duck.cursor()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    same(multiset.fingerprint_report(docs), con, queries.SQL["op12_multiset_hash"])

