import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sitescope.llm import lines


def key_of(line):
    key = line.strip(" \t\n\x0b\x0c\r")
    key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in key)
    return key if len(key) >= 20 else None


def brute_texts(rows):
    """(doc_id, all lines, kept lines)."""
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and key_of(x):
                held[key_of(x)].add(i)
    lost = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if i is None or key_of(x) not in lost or lost[key_of(x)] == i]
        out.append((i, all_, kept))
    return out


def brute(rows):
    return sorted(((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for i, all_, kept in brute_texts(rows)), key=str)


def test_odd_documents(odd, none):
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sorted((tuple(r) for r in lines.line_report(odd).collect()), key=str) == want
    assert any(r[2] for r in want)
    out = lines.dedup_lines(odd)
    assert out.columns == odd.columns
    own = {r["doc_id"]: r for r in out.collect()}
    assert own[2]["text"] is None and own[4]["n_chars"] == len(own[4]["text"])
    assert lines.line_report(none).count() == 0 and lines.dedup_lines(none).count() == 0


def test_reversible(spark):
    """Inserting and deleting documents leads to the index of the documents that are left."""
    shared = [f"shared line number {k} of some length" for k in range(30)]
    rows = [(i, "\n".join(x for k, x in enumerate(shared) if (i + k) % 4 > 0) + f"\nown line of document {i}, long enough") for i in range(12)]
    make = lambda ids: spark.createDataFrame([rows[i] for i in ids], "doc_id long, text string")
    state = lambda index: {(r["doc_id"], (k["hi"], k["lo"])) for r in lines.dropped(index).collect() for k in r["keys"]}
    index = lines.build(make(range(6)), shards=4)
    grown = lines.insert(index, make(range(4, 12)))
    assert state(grown) == state(lines.build(make(range(12)), shards=4))
    back = lines.delete(grown, make(range(6, 12)).select("doc_id"))
    assert state(back) == state(index)
    few = lines.delete(back, make(range(4)).select("doc_id"))
    assert state(few) == set()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=400, unique=True), st.integers(1, 40))
def test_cuckoo_filter(keys, capacity):
    """Also when it is much too small: nothing inserted is ever missing, and what is deleted goes."""
    hi = np.array(keys, np.uint64)
    lo = hi * np.uint64(0x9E3779B97F4A7C15) ^ (hi >> np.uint64(7))
    f = lines.CuckooFilter(capacity)
    f.insert(hi, lo)
    f = lines.CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(hi, lo).all()
    half = len(hi) // 2
    f.delete(hi[:half], lo[:half])
    assert f.contains(hi[half:], lo[half:]).all()
    f.delete(hi[half:], lo[half:])
    assert not f.buckets.any() and not f.stash


def test_filters_grow(spark):
    """Many insertions: filters are built anew before they are full, tables are written as one, and nothing is forgotten."""
    text = lambda i: "\n".join(f"shared line number {k} of some length" for k in range(i // 5 * 40 + 40))
    docs = [spark.createDataFrame([(i, text(i)) for i in range(a, a + 5)], "doc_id long, text string") for a in range(0, 50, 5)]
    index = lines.build(docs[0], shards=2)
    first = dict(index.filters)
    for d in docs[1:]:
        index = lines.insert(index, d)
    assert len(index.changes) < lines.BATCHES and all(index.filters[n][1] > first[n][1] for n in first)
    store, path = lines.open_store(index.folder)
    for file, room in index.filters.values():
        with store.open_input_stream(f"{path}/{file}", compression=None) as f:
            own = lines.CuckooFilter.from_bytes(f.read())
        assert not own.stash and np.count_nonzero(own.buckets) <= room
    whole = lines.build(spark.createDataFrame([(i, text(i)) for i in range(50)], "doc_id long, text string"), shards=2)
    state = lambda x: {(r["doc_id"], (k["hi"], k["lo"])) for r in lines.dropped(x).collect() for k in r["keys"]}
    assert state(index) == state(whole)
    few = lines.delete(index, spark.range(3, 50).withColumnRenamed("id", "doc_id"))
    assert state(few) == state(lines.build(docs[0].where("doc_id < 3"), shards=2))


def test_insertion_in_bulk():
    """A filter filled to its room needs no stash, and holds every key."""
    rng = np.random.default_rng(1)
    hi, lo = (rng.integers(0, 2**64, 100_000, dtype=np.uint64) for _ in range(2))
    f = lines.CuckooFilter(100_000)
    for k in range(0, 100_000, 9_000):
        f.insert(hi[k : k + 9_000], lo[k : k + 9_000])
    assert f.contains(hi, lo).all() and not f.stash
    f.delete(hi[::2], lo[::2])
    assert f.contains(hi[1::2], lo[1::2]).all() and np.count_nonzero(f.buckets) == 50_000
