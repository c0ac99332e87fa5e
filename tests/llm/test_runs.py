import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from sitescope.llm import runs

from ..conftest import DATA


def brute(words):
    """Every period by comparing all words with those a period on; smallest periods only."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)]
        i = 0
        while i < len(same):
            if same[i]:
                j = i
                while j < len(same) and same[j]:
                    j += 1
                if j - i + q >= max(6, 4 * q) and not any((i, j + q) == (s, s + m) for s, m, _ in found):
                    found[i, j - i + q, q] = True
                i = j
            else:
                i += 1
    return sorted(found)


def brute_report(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in b"\t\n\x0b\x0c\r"}).split(" ") if w]
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_random_words():
    """Short alphabets, planted powers and nested periods against all comparisons."""
    rng = random.Random(1)
    for k in range(3000):
        words = rng.choices("ab" if k % 2 else "abcd", k=rng.randrange(60))
        for _ in range(rng.randrange(4)):
            unit = rng.choices("abc", k=rng.randrange(1, 8)) * rng.randrange(1, 4)
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * 6)[: rng.randrange(1, 6 * len(unit) + 1)]
        assert runs.runs_of(words) == brute(words), words


def test_every_word_of_two_letters():
    for n in range(13):
        for code in range(1 << n):
            words = ["ab"[code >> i & 1] for i in range(n)]
            assert runs.runs_of(words) == brute(words)


def test_positions_in_blocks(monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 4)
    rng = random.Random(2)
    numbers = rng.sample(range(1000), 300)
    held, kept = runs.Positions(numbers[0]), [numbers[0]]
    for e in numbers[1:]:
        kept = sorted([*kept, e])
        at = kept.index(e)
        assert held.add(e) == (kept[at - 1] if at else None, kept[at + 1] if at + 1 < len(kept) else None)
        assert held.next(e) == (kept[at + 1] if at + 1 < len(kept) else None)
    assert list(held) == kept and held.next(max(kept)) is None
    test_random_words()


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    want = sorted(brute_report(*r) for r in docs.collect())
    assert sorted(map(tuple, runs.run_report(docs).collect())) == want and any(r[1] for r in want)


def test_odd_documents(spark, odd, none):
    key = lambda r: (r[0] is None, r)
    got = sorted(map(tuple, runs.run_report(odd).collect()), key=key)
    small = odd.where("doc_id IS NULL OR doc_id <> 3")
    assert sorted(map(tuple, runs.run_report(small).collect()), key=key) == sorted((brute_report(r["doc_id"], r["text"]) for r in small.collect()), key=key)
    assert len(got) == odd.count() and runs.run_report(none).count() == 0
    found = runs.find_runs(odd)
    assert found.select("doc.*").columns == odd.columns and found.count() == odd.count()


def test_very_long_texts(spark):
    """60,000 words of period 977 in one text; 200,000 equal words; long prose with a repeated paragraph far away."""
    found = {r["k"]: r for r in _found(spark)}
    assert [tuple(r) for r in found[0]["runs"]] == [(0, 60_000, 977)]
    assert len(found[0]["collapsed"].split(" ")) == 977
    assert [tuple(r) for r in found[1]["runs"]] == [(0, 200_000, 1)] and found[1]["collapsed"] == "x"
    assert found[2]["runs"] == []


def _found(spark):
    rng = np.random.default_rng(3)
    prose = [f"w{i}" for i in rng.integers(0, 500, 50_000)]
    prose[40_000:41_000] = prose[1000:2000]
    texts = [" ".join(f"word{i % 977}" for i in range(60_000)), "x " * 200_000, " ".join(prose)]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return runs.find_runs(docs).select("doc.k", "runs", "collapsed").collect()


def test_ties(spark):
    """Of equal exponents the first run is named; a fraction decides exactly."""
    rows = [("a b " * 4 + "| " + "c d " * 4,), ("a b " * 4 + "a | " + "c d " * 4,), ("x " * 6,), ("x " * 5,), ("a b c " * 4,), ("a b c " * 3 + "a b",)]
    docs = spark.createDataFrame(rows, "text string")
    best = runs.find_runs(docs).select(runs.longest(F.col("runs")).alias("b")).collect()
    assert [r["b"] and tuple(r["b"]) for r in best] == [(0, 8, 2), (0, 9, 2), (0, 6, 1), None, (0, 12, 3), None]
