import random
import re

import numpy as np
import pytest

import corpus_pipeline as pipeline
from sitescope.llm import common, near, simhash

from ..conftest import DATA


def brute_shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_kept(rows, limit=0.8):
    """The smallest doc_id of each component, all pairs compared."""
    sets = [brute_shingles(t) for _, t in rows]
    label = [i for i, _ in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= limit * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return sorted(set(label))


def edited(rng, words, edits):
    words = list(words)
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"new{rng.randint(0, 10**9)}"
    return " ".join(words)


def planted(pairs):
    """Texts of 200 words, each with a copy of one to four changed words: a Jaccard index of 0.8 or more."""
    rng = random.Random(5)
    rows = []
    for p in range(pairs):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
        rows += [(2 * p, " ".join(words)), (2 * p + 1, edited(rng, words, rng.randint(1, 4)))]
    return rows


def test_planted_near_copies(spark):
    """Recall on planted near copies, through the stage of the pipeline."""
    docs = spark.createDataFrame(planted(300), "doc_id long, text string")
    stage = dict(pipeline.STAGES)["near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, DATA).collect()) == [2 * p for p in range(300)]


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute_kept([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in near.first_of_each(docs).collect()) == want


@pytest.mark.parametrize("block", [3, 16, 128])
def test_blocks_lose_no_pair(spark, block):
    """One cluster of texts near and just not near to each other."""
    rng = random.Random(2)
    words = [f"w{k}" for k in range(120)]
    rows = [(k, edited(rng, words, rng.randint(0, 6)).encode()) for k in range(60)]
    got = near.links(spark.createDataFrame([(0, i, t) for i, t in rows], "label long, cls long, t binary"), block).collect()
    sets = [brute_shingles(t.decode()) for _, t in rows]
    want = {(i, j) for j in range(60) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    # a forest for each pair of blocks: only near copies are tied, and all of them are
    assert {tuple(sorted(r)) for r in got} <= components_pairs(want, 60)
    assert components_pairs({tuple(sorted(r)) for r in got}, 60) == components_pairs(want, 60)
    assert 0 < len(want) < 60 * 59 // 2 and len(got) <= 60 * (60 // block + 1)


def components_pairs(links, n):
    """All pairs that are reachable from each other."""
    label = list(range(n))
    for _ in range(n):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return {(i, j) for j in range(n) for i in range(j) if label[i] == label[j]}


@pytest.mark.parametrize("first", [0, 25])
def test_close_pairs(first):
    """The bit-sliced comparison leaves no near copy out: all pairs against brute force."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(90)]
    texts = [edited(rng, words, rng.randint(0, 5)) for _ in range(50)] + [f"short text number {k // 2} of several words" for k in range(20)]
    sets = [brute_shingles(t) for t in texts]
    want = {(i, j) for j in range(70) for i in range(j) if (not first or i < first <= j) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    got = near.close([near.shingles(t.encode())[1] for t in texts], first)
    assert set(zip(*map(np.ndarray.tolist, got), strict=True)) == want and want


def test_odd_documents(odd, none):
    kept = near.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 7, None, 10, 11, 12]))
    assert near.first_of_each(none).count() == 0


def test_no_words_and_long_texts():
    assert near.bands(near.shingles(b" \n")[1]) == []
    found = near.shingles(" ".join(f"w{k}" for k in range(5000)).encode())[1]
    assert len(found) == 4996 and len(near.bands(found)) == near.BANDS
    assert (np.diff(found.astype(object)) > 0).all()


@pytest.mark.parametrize("first", [near.first_of_each, simhash.first_of_each])
def test_null_and_repeated_ids(spark, first):
    """Unrelated texts stay, whatever their ids; a copy goes, though its id is that of a kept text."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (1, text(3)), (1, text(4)), (2, text(4)), (0, text(5)), (2, text(5)), (None, text(3)), (3, text(6)), (3, text(6))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = [(None, text(1)), (None, text(2)), (1, text(3)), (1, text(4)), (0, text(5)), (3, text(6))]
    assert sorted(map(tuple, first(docs).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("salts", [1, 64])
def test_copied_keys_are_not_broadcast(spark, tmp_path, monkeypatch, salts):
    """Spark knows the file of a small table, not the copies that are made of it: those are merged."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 5)
    spark.range(20).selectExpr("IF(id = 0, NULL, id) AS k", "id AS v").write.parquet(f"{tmp_path}/small")
    rows = spark.range(100).selectExpr("id", "IF(id % 25 = 0, NULL, id % 25) AS k")
    out = common.join_small(rows, spark.read.parquet(f"{tmp_path}/small"), ["k"], spread="id", salts=salts)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(i, i % 25 if i % 25 < 20 else None) for i in range(100)]
