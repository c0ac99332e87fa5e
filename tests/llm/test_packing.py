import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sitescope.llm import packing

from ..conftest import DATA


def check(docs, seq_len=2048):
    return verify(packing.pack(docs, seq_len=seq_len).collect(), docs.collect(), seq_len)


def verify(rows, texts, seq_len=2048):
    """Every piece of every text is there, with its ids, and sequences are gapless and not overfull; (sequences, ids)."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_vocabulary())
    want = Counter()
    for r in texts:
        ids = np.array(library.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        first = (len(ids) - 1) % seq_len + 1
        starts = [0, *range(first, len(ids), seq_len)]
        for k, s in enumerate(starts):
            own = ids[s : (first if not s else s + seq_len)]
            want[(r["doc_id"], k, s, len(own), zlib.crc32(own.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= seq_len
    return len(by), sum(r["length"] for r in rows)


def test_odd_documents(odd, none):
    check(odd)
    check(odd, 16)
    assert packing.pack(none).count() == 0


def test_few_sequences(spark):
    n, total = check(spark.read.parquet(f"{DATA}/documents.parquet"))
    assert n <= -(-total // 2048) + 1


def test_whole_sequences(spark, odd):
    rows = packing.sequences(packing.pack(odd, seq_len=64, with_ids=True)).collect()
    assert all(0 < len(r["ids"]) <= 64 for r in rows)


def test_empty_text_is_only_a_separator():
    assert packing.cut(1, 8) == [(0, 1)] and packing.cut(8, 8) == [(0, 8)] and packing.cut(17, 8) == [(0, 1), (1, 8), (9, 8)]


def fewest(items, capacity):
    items = tuple(sorted(items, reverse=True))

    @lru_cache(None)
    def go(left, rooms):
        if not left:
            return 0
        best = len(left)
        seen = set()
        for i, room in enumerate(rooms):
            if room >= left[0] and room not in seen:
                seen.add(room)
                best = min(best, go(left[1:], tuple(sorted((*rooms[:i], *rooms[i + 1 :], room - left[0])))))
        return min(best, 1 + go(left[1:], tuple(sorted((*rooms, capacity - left[0])))))

    return go(items, ())


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
def test_reduction_loses_no_optimum(items):
    """What the reduction fixes and the best packing of the rest together need as few sequences as the best packing of all."""
    fixed, left = packing.dominate(Counter(items), 12)
    rest = [x for x, n in left.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + (fewest(rest, 12) if rest else 0) == fewest(items, 12)
    got = Counter()
    for pattern, n in packing.plan(Counter(items), 12):
        assert sum(pattern) <= 12
        got.update({x: pattern.count(x) * n for x in set(pattern)})
    assert got == Counter(items)


def test_both_libraries_agree():
    bpe = packing.ByteBpe(packing.default_vocabulary())
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}1 {chr(c)}{chr(c)}b  {chr(c)}\n{chr(c)} " for c in points] + ["x<|endoftext|>y", " \n\n  z", "don't 'LL"]
    library = bpe.library().encode_batch(texts, add_special_tokens=False)
    assert [t for t, e in zip(texts, library, strict=True) if bpe.ids(t).tolist() != e.ids] == []
