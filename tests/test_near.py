"""Groups of near copies and suggestions against plain Python."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from sitescope.functions import text
from sitescope.operators import duplicates, linking
from sitescope.operators.graph import connected_components
from sitescope.plans import filters


def test_classes_against_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(60) for _ in range(12)]
    rows = []
    for i in range(150):
        h = rng.choice(base)
        for _ in range(rng.randint(0, 3)):
            h ^= 1 << rng.randrange(60)
        rows.append((i, h))
    df = spark.createDataFrame(rows, "k long, h long")
    near = {(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 3}
    assert {(r["a"], r["b"]) for r in duplicates.near_pairs(df, "k", "h", bits=60).collect()} == near
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in near:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {}
    for i, _ in rows:
        want.setdefault(root(i), []).append(i)
    got = {}
    for r in duplicates.near_groups(df, "k", "h", bits=60).collect():
        got.setdefault((r["label"], r["n"]), []).append(r["k"])
    assert {k: sorted(v) for k, v in got.items()} == {(k, len(v)): v for k, v in want.items() if len(v) > 1}


def test_topics_ignore_copies_of_one_text(spark):
    heads = [(1, "Evening courses")]
    rows = [("u1", "Evening Courses in the old town", "h1"), ("u2", "Evening courses in the old town", "h1"), ("u3", "Evening courses in the old town", "h2"), ("u4", "Something else entirely here", "h3")]
    df = spark.createDataFrame([(c, u, t, h, heads if u != "u4" else [], True) for u, t, h in rows for c in ("c1", "c2")], "crawl_job_id string, url string, title string, content_hash string, headings array<struct<level: int, text: string>>, indexable boolean")
    got = sorted((*r["label"], *r["k"], r["n"]) for r in duplicates.topic_overlaps(df).collect())
    assert got == [(c, "u1", c, u, 3) for c in ("c1", "c2") for u in ("u1", "u2", "u3")]
    assert duplicates.topic_overlaps(df.where("url IN ('u1', 'u2')")).count() == 0


def test_topic_pairs_against_brute_force(spark, monkeypatch):
    """Copies in many blocks, rows that repeat a key, sets of few and of very many words, keys apart, two limits."""
    monkeypatch.setattr(duplicates, "BLOCK", 3, raising=False)
    rng = random.Random(11)
    base = [[f"w{rng.randrange(90)}" for _ in range(rng.choice([2, 3, 5, 8, 13, 22, 30, 60]))] for _ in range(40)]
    rows = [(f"c{i % 2}", i - i % 50 // 49, [*rng.choice(base)]) for i in range(260)]
    for _, _, words in rows:
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(90)}"
    rows += [("c0", 1000 + i, ["evening", "course"]) for i in range(40)] + [("c0", 1005, ["course", "evening", "course"]), ("c1", 2000, ["course", "evening"]), ("c0", 3000, ["course"])]
    df = spark.createDataFrame(rows, "c string, k long, words array<string>")
    for least in (0.4, 0.6, 0.8):
        want = []
        for c, a, x in rows:
            for d, b, y in rows:
                x, y = set(x), set(y)
                if a < b and c == d and min(len(x), len(y)) >= 2 and len(x & y) / len(x | y) >= least:
                    want.append((a, b, len(x & y) / len(x | y)))
        assert sorted(map(tuple, duplicates.topic_pairs(df, least, ("c",)).collect())) == sorted(want)


def test_linking_sources_in_tasks_of_few_links(spark, monkeypatch):
    """A target that all pages link to, a source that links to all, links and addresses that repeat; tasks grow with the links."""
    monkeypatch.setattr(linking, "ROWS", 200, raising=False)
    rng = random.Random(3)
    pages = [(f"p{i}", f"https://e.org/{i - i % 10 // 9:03}") for i in range(120)]
    links = [(f"p{rng.randrange(130)}", rng.choice([None, "gone", *(f"p{rng.randrange(60)}" for _ in range(9))])) for _ in range(1500)]
    links += [(f"p{i}", "p7") for i in range(120) for _ in range(3)] + [("p9", f"p{i}") for i in range(120)]
    out = linking.linking_sources(spark.createDataFrame(links, "source_id string, target_id string"), spark.createDataFrame(pages, "id string, url string"))
    want = {}
    for s, t in links:
        if t and s != t and s in dict(pages):
            want.setdefault(t, set()).add(dict(pages)[s])
    assert {r["target_id"]: r["sources"] for r in out.collect()} == {t: sorted(u)[:10] for t, u in want.items()}
    assert out.rdd.getNumPartitions() >= len(links) * 0.8 / 200 > 4


def test_suggestions_of_a_shared_phrase(spark):
    """Many pages with one title and many texts that name it: three sources each, none that links already."""
    rows = [(i, f"https://e.org/{i:02}", "Evening course plan", f"we offer the evening course plan {i}", 1, i % 5, True) for i in range(30)]
    pages = spark.createDataFrame([(*r, [], False, False) for r in rows], "id long, url string, title string, text string, inlinks_count int, depth int, indexable boolean, headings array<struct<level: int, text: string>>, is_orphan boolean, important boolean")
    links = spark.createDataFrame([(0, 7), (5, 7), (10, 7), (15, 7), (0, 8)], "source_id long, target_id long")
    got = {}
    for r in linking.suggest(pages, links, "https://e.org/none").collect():
        got.setdefault(r["target_url"], []).append(r["source_url"])
    order = [f"https://e.org/{i:02}" for i in sorted(range(30), key=lambda i: (i % 5, i))]
    have = {7: {0, 5, 10, 15}, 8: {0}}
    for i in range(30):
        bad = {f"https://e.org/{k:02}" for k in have.get(i, set()) | {i}}
        assert sorted(got[f"https://e.org/{i:02}"]) == sorted([u for u in order if u not in bad][:3])


def test_components(spark):
    edges = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["label"] for r in connected_components(edges).collect()} == {0}


def test_suggestions_of_crawls_against_brute_force(spark):
    """Crawls apart, two phrases a page, punctuation and letters beyond the first plane before and around a match."""
    import re

    rng = random.Random(7)
    words = ["alpha", "Beta", "(gamma)", "dél", "ÉPS", "zeta.x", "😀", "et", "a+b"]
    schema = "crawl_job_id string, id long, url string, title string, headings array<struct<level: int, text: string>>, text string, inlinks_count int, depth int, is_orphan boolean, important boolean, indexable boolean"
    rows, links = [], set()
    for i in range(90):
        say = lambda n: " ".join(rng.choice(words) for _ in range(n))
        head = [(1, say(3)), (2, "no main heading here"), (1, say(2))] if i % 3 else []
        body = None if i == 4 else "" if i == 5 else say(rng.choice([5, 30, 200])) + rng.choice([" alpha  Beta x", "", "!"])
        rows.append((None if i % 3 == 2 else f"c{i % 2}", i, f"https://e.org/{i}", rng.choice([None, "", say(4), "Home page"]), head, body, rng.randrange(4), rng.choice([None, 0, 1, 2]), rng.choice([None, True, False]), rng.random() < 0.2, i % 11 != 3))
        links |= {(rng.randrange(90), i) for _ in range(2)}
    got = linking.suggest(spark.createDataFrame(rows, schema), spark.createDataFrame(sorted(links), "source_id long, target_id long"), "https://e.org/0").collect()
    want = []
    for crawl in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == crawl and r[10]]
        titles = [r[3] for r in own if r[3]]
        assert not any(s in t for t in titles for s in (" | ", " - ", " – ", " — "))  # no suffix to strip
        for t in own:
            if t[1] == 0 or not (t[6] <= 1 or t[8] or (t[9] and t[6] < 3)):
                continue
            phrases, seen, used = [], set(), []
            for p in [h[1] for h in t[4] if h[0] == 1] + [t[3] or ""]:
                if len(re.findall(r"\w+", p)) >= 2 and len(p) >= 8 and p.lower() not in linking.GENERIC and p.lower() not in seen:
                    phrases.append(p), seen.add(p.lower())
            for p in phrases:
                for s in sorted((r for r in own if r[5]), key=lambda r: (99 if r[7] is None else r[7], -r[6], r[2])):
                    m = re.search(r"(?<!\w)" + re.escape(p) + r"(?!\w)", s[5], re.I)
                    if m and len(used) < 3 and s[1] != t[1] and (s[1], t[1]) not in links and s[1] not in used:
                        used.append(s[1])
                        a, b = max(0, m.start() - 80), min(len(s[5]), m.end() + 80)
                        snippet = ("…" if a else "") + s[5][a:b].strip(" ") + ("…" if b < len(s[5]) else "")
                        want.append((crawl or "", s[1], t[1], m.group(0), snippet, int((min(1, len(re.findall(r"\w+", p)) / 6) * 0.8 + 0.2 * t[9]) * 100 + 0.5) / 100))
    assert len(want) > 40 and len({w[0] for w in want}) == 3
    assert sorted((r["crawl_job_id"], r["source_id"], r["target_id"], r["anchor_text"], r["snippet"], r["relevance"]) for r in got) == sorted(want)


def test_suggestions_of_nothing(spark):
    pages = spark.createDataFrame([], "id long, url string, title string, text string, inlinks_count int, depth int, indexable boolean, headings array<struct<level: int, text: string>>, is_orphan boolean, important boolean")
    assert linking.suggest(pages, spark.createDataFrame([], "source_id long, target_id long"), "x").count() == 0


def test_fingerprints_are_not_shuffled(spark):
    """Bits are counted where a text is read; more shingles than are counted at a time, few words, no text."""
    words = [f"w{k % 97}" for k in range(300)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, "--".join(words).upper()), (3, " ".join(words[:14])), (4, None), (5, " ".join(words[:15]) + "!")], "k int, t string")
    out = text.md5_simhash(rows, "k", "t")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()

    def want(w):
        found = [int(hashlib.md5(" ".join(w[i : i + 3]).encode()).hexdigest()[:15], 16) for i in range(len(w) - 2)]
        return sum(1 << b for b in range(60) if 2 * sum(v >> b & 1 for v in found) > len(found))

    assert dict(map(tuple, out.collect())) == {1: want(words), 2: want(words), 5: want(words[:15])}


def test_heads_of_md5():
    """Slices of every length around the ends of words and of a block, in more than one round of lanes."""
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(40_000))
    sizes = np.array([k % 75 for k in range(text.LANES * 2 + 5)])
    starts = np.array([rng.randrange(len(data) - n + 1) for n in sizes.tolist()])
    starts[-5:], sizes[-5:] = len(data) - np.arange(5), np.arange(5)
    got = text.md5_heads(data, starts, sizes)
    assert all(h.tobytes() == hashlib.md5(data[s : s + n]).digest()[:8] for h, s, n in zip(got, starts.tolist(), sizes.tolist(), strict=True))
    assert len(text.md5_heads(b"", starts[:0], sizes[:0])) == 0


def test_fingerprints_of_documents_read_together(spark):
    """Texts of any length beside each other, long words, repeated keys, texts larger than what is read together."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        words = [rng.choice(["été", "x", "long" * rng.randrange(1, 12), f"w{rng.randrange(50)}", "日本語"]) for _ in range(rng.choice([0, 1, 2, 14, 15, 16, 40, 300]))]
        rows.append((i - i % 9 // 8, rng.choice([" ", ", ", " -- "]).join(words) if i % 40 else None))
    rows.append((999, " ".join(f"v{k % 7919}" for k in range(80_000))))

    def want(t):
        w = [x.lower() for x in (t or "").replace(",", " ").replace("-", " ").split()]
        found = [int(hashlib.md5(" ".join(w[i : i + 3]).encode()).hexdigest()[:15], 16) for i in range(len(w) - 2)]
        return sum(1 << b for b in range(60) if 2 * sum(v >> b & 1 for v in found) > len(found)) if len(w) >= 15 else None

    out = text.md5_simhash(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    assert sorted(map(tuple, out.collect())) == sorted((k, want(t)) for k, t in rows if want(t) is not None)


def test_runs_of_words(spark):
    """Runs of two and three words that a phrase shares with a text, apart by crawl; none where there are fewer words."""
    rows = spark.createDataFrame([(["a", "b", "c", "a", "b", "c"], "x"), (["b", "c"], "x"), (["a", "b", "c"], "x"), (["a", "b", "c"], "y"), ([], "x")], "w array<string>, c string")
    two, three = ([set(r[0]) for r in rows.select(linking.word_runs(F.col("w"), k, F.col("c"))).collect()] for k in (2, 3))
    assert [len(x) for x in two] == [3, 1, 2, 2, 0] and [len(x) for x in three] == [3, 0, 1, 1, 0]
    assert two[1] < two[0] and three[2] < three[0] and not three[3] & three[0]


def test_hashed_runs_against_brute_force(spark):
    """Runs by size and seed: words of any letters, no text, texts beyond a block, more words than are hashed at a time."""
    rng = random.Random(5)
    words = ["été", "x", "日本語", "😀", "a_b", "long" * 9, "²", "--", "né", *(f"w{k}" for k in range(20))]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 60]))) if i % 20 else None, i % 3) for i in range(200)]
    rows.append((999, " ".join(f"v{k % 70_001}" for k in range(text.WORDS + 90_000)), 1))

    def runs(t, sizes):
        own = re.findall(r"[^\W]+", t or "")
        return {tuple(own[i : i + k]) for k in sizes for i in range(len(own) - k + 1)}

    frame = spark.createDataFrame(rows, "k int, t string, seed long")
    got = text.hashed_runs(frame, "t", "seed", [2, 4]).collect()
    assert len(got) == len({(r["k"], r["g"]) for r in got}) == sum(len(runs(t, [2, 4])) for _, t, _ in rows)
    assert len({r["g"] for r in got}) == len({(s, x) for _, t, s in rows for x in runs(t, [2, 4])})
    of_size = {k: len(re.findall(r"[^\W]+", t or "")) for k, t, _ in rows}
    longest = text.hashed_runs(frame, "t", "seed", [2, 3, 4], longest=True).collect()
    assert {(r["k"], r["size"]) for r in longest} == {(k, min(n, 4)) for k, n in of_size.items() if n > 1}
    asked = spark.createDataFrame([(r["g"],) for r in got if r["k"] % 7 == 3], "g long")
    kept = text.hashed_runs(frame, "t", "seed", [2, 4], filters.KeyFilter(asked, "g")).collect()
    held = {r["g"] for r in asked.collect()}
    assert {(r["k"], r["g"]) for r in got if r["g"] in held} <= {(r["k"], r["g"]) for r in kept}
    assert len(kept) < sum(r["g"] in held for r in got) + len(got) / 50
    none = filters.KeyFilter(asked.limit(0), "g")
    assert text.hashed_runs(frame, "t", "seed", [2, 4], none).count() == 0


def test_texts_meet_phrases_on_long_runs(spark, monkeypatch):
    """Texts that hold every three neighbouring words of a phrase, but not the phrase, are not read for it."""
    pages = [(i, f"https://e.org/{i:03}", "" if i else "alpha beta gamma delta epsilon", f"{i} alpha beta gamma, beta gamma delta; gamma delta epsilon" if i < 60 else "see Alpha beta gamma delta EPSILON", 0, 0, True, [], False, False) for i in range(62)]
    rows = spark.createDataFrame(pages, "id long, url string, title string, text string, inlinks_count int, depth int, indexable boolean, headings array<struct<level: int, text: string>>, is_orphan boolean, important boolean")
    seen = {}

    def table(df, name):
        seen[name] = df.cache()
        return seen[name]

    monkeypatch.setattr(linking, "table", table)
    got = linking.suggest(rows, spark.createDataFrame([], "source_id long, target_id long"), "x").collect()
    assert sorted((r["source_id"], r["anchor_text"]) for r in got) == [(i, "Alpha beta gamma delta EPSILON") for i in (60, 61)]
    assert seen["suggest-runs"].count() == 2


def test_phrases_of_crawls_meet_their_own_texts_alone(spark, monkeypatch):
    """Texts that name what a page of another crawl is about are no candidates; nor is a page alone for its own phrase."""
    rows = [(f"c{i % 2}", i, f"https://e.org/{i:02}", "alpha beta gamma delta epsilon" if i == 0 else None, "say alpha beta gamma delta epsilon", 0, 0, True, [], False, False) for i in range(40)]
    pages = spark.createDataFrame(rows, "crawl_job_id string, id long, url string, title string, text string, inlinks_count int, depth int, indexable boolean, headings array<struct<level: int, text: string>>, is_orphan boolean, important boolean")
    seen = {}

    def table(df, name):
        seen[name] = df.cache()
        return seen[name]

    monkeypatch.setattr(linking, "table", table)
    got = linking.suggest(pages, spark.createDataFrame([], "source_id long, target_id long"), "x").collect()
    assert [r["source_id"] for r in got] == [2, 4, 6] and {r["crawl_job_id"] for r in got} == {"c0"}
    assert sorted(r["source_id"] for r in seen["suggest-runs"].collect()) == list(range(0, 40, 2))
    assert sorted(r["source_id"] for r in seen["suggest-sources"].collect()) == list(range(2, 40, 2))


def test_places_of_phrases_against_brute_force(spark):
    """The first match, where letters have several small forms, lower case is longer, or words go on beside a match."""
    rng = random.Random(11)
    words = ["soft", "ſoft", "SOFT", "power", "powers", "plan", "İ", "ΟΔΟΣ", "οδοσ", "😀", "x²", "“plan”", "plan-b"]
    named = ["soft power", "power plan", "plan soft power", "οδοσ plan"]
    regular = [w for w in words if w not in ("ſoft", "İ", "ΟΔΟΣ")]
    rows = [(i, " ".join(rng.choice(words if i % 2 else regular) for _ in range(rng.choice([3, 40, 400])))) for i in range(300)]
    low = {r["i"]: r["low"] for r in spark.createDataFrame(rows, "i int, t string").select("i", F.lower("t").alias("low")).collect()}
    frame = spark.createDataFrame([(i, t, low[i], named) for i, t in rows], "i int, t string, low string, named array<string>")
    got = {(r["i"], r["phrase"]): r for r in linking.places(frame).collect()}
    assert {k for k in got} == {(i, p) for i, _ in rows for p in named if p in low[i]}
    said = 0
    for (i, p), r in got.items():
        t = rows[i][1]
        m = re.search(r"(?<!\w)" + re.escape(p) + r"(?!\w)", t, re.I)
        if r["t"] is None:
            said += 1
            assert (r["found"], r["around"]) == (m.group(0), t[max(m.start() - 80, 0) : m.end() + 80])
            assert (r["more_before"], r["more_after"]) == (m.start() > 80, m.end() + 80 < len(t))
        else:
            assert r["t"] == t
    assert said > 20 and len(got) - said > 20
    assert set(linking.IRREGULAR) == {c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and len(c.upper()) == 1 and c.upper().lower() != c.lower()}
