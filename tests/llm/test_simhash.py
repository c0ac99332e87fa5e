import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitescope.llm import components, simhash

from ..conftest import DATA


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=2):
    ids = [r[0] for r in rows]
    f = np.array([r[1] for r in rows], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    label = np.array(ids)
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return dict(zip(ids, label.tolist(), strict=True))
        label = new


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    want = brute_components(rows)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_of(F.col("fp")).alias("h"), "component_id").collect()
    assert {(r["doc_id"], r["h"], r["component_id"]) for r in got} == {(i, f"{f:016x}", want[i]) for i, f in rows}


def test_odd_documents(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == by[2] == by[9] == 1 and by[7] == by[8] == 7
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({i for i in by.values() if i is not None})


@pytest.mark.parametrize("block", [2, 16])
def test_blocks_lose_no_link(spark, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    f = base[rng.integers(0, 5, 200)]
    for _ in range(3):
        f = f ^ np.where(rng.random(200) < 0.6, np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64), np.uint64(0))
    f = np.unique(f)
    classes = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    found = components.connected_components(simhash.links(classes, block=block)).collect()
    want = brute_components(list(zip(f.view(np.int64).tolist(), f.tolist(), strict=True)))
    assert {r["node"]: r["label"] for r in found} == {n: x for n, x in want.items() if sum(y == x for y in want.values()) > 1}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4)), min_size=1, max_size=80), st.integers(0, 5))
def test_bit_slices(rows, radius):
    rows = sorted(rows, key=lambda r: r[0])
    f = []
    for _, x, bits in rows:
        x %= 8
        for b in bits:
            x ^= 1 << b
        f.append(x)
    f, runs = np.array(f, np.uint64), np.array([r[0] for r in rows])
    i, j = simhash.sliced_links(f, runs, radius)
    near = (np.bitwise_count(f[:, None] ^ f[None, :]) <= radius) & (runs[:, None] == runs[None, :])
    a, b = np.nonzero(np.triu(near, 1))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(a.tolist(), b.tolist(), strict=True))


def test_components_of_a_path(spark):
    edges = spark.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(100, 101), (7, 7)], "a long, b long"))
    got = {r["node"]: r["label"] for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert components.connected_components(edges.limit(0)).count() == 0
