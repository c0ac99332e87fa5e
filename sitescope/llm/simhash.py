"""SimHash near-duplicates: fingerprints, bit-sliced comparison in blocks, connected components.

Documents with one fingerprint are one class, so copies are never compared with each other. Two fingerprints within
``radius`` bits agree in at least ``bands - radius`` of their bands; classes meet in the groups of all such sets of bands.
A group larger than BLOCK is cut into blocks, and each pair of blocks becomes a group of its own: every link is found and
no task holds more than two blocks. In a group, fingerprints stand in bit planes, 64 lanes to a word. One fingerprint is
compared with 64 at a time: a plane is XORed with its bit and added to carry-save counters that start so that a lane
overflows when it exceeds the radius; words all of whose lanes have overflowed are abandoned. A group returns its links as
a spanning forest, which has the components of all its links and at most as many edges as fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, sliced, smallest, table, text_of
from .components import connected_components

RADIUS, BANDS, SHINGLE, SEED = 2, 4, 3, 42
BLOCK = 128
#: Planes between two looks at which words can be abandoned.
STRIDE = 8
ENTRIES = 1 << 17

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, A-Z lower-cased, as a signed integer. No words: 0."""
    import xxhash

    words = data.lower().split()  # bytes: only A-Z, and white space is \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    last = ends[shingle - 1 :] or ends[-1:]
    seen = np.zeros((8, 256), np.int64)
    for at in range(0, n, 1 << 16):
        parts = [joined[s:e] for s, e in zip(starts[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=True)]
        seen += byte_counts(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts)))
    return majority(seen, n)


def byte_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the eight bytes of unsigned 64-bit hashes has each value."""
    return np.bincount((hashes.view(np.uint8).reshape(-1, 8) + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint whose bits are set in over half of ``n`` hashes, as a signed integer."""
    return int(np.packbits((counts @ _BITS).ravel() * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp of every row; null text is empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", F.encode(text_of(), "UTF-8").alias("t")).mapInArrow(run, f"doc_id {kind}, fp long")


def band_groups(classes: DataFrame, radius: int = RADIUS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """(fp, table, key, i, j): the groups in which fingerprints meet, split into pairs of blocks where they are large."""
    edges = [64 * k // bands for k in range(bands + 1)]
    band = lambda k: F.shiftrightunsigned("fp", edges[k]).bitwiseAND((1 << (edges[k + 1] - edges[k])) - 1)
    keys = []
    for t, chosen in enumerate(combinations(range(bands), bands - radius)):
        key = F.lit(0).cast("long")
        for k in chosen:
            key = F.shiftleft(key, edges[k + 1] - edges[k]).bitwiseOR(band(k))
        keys.append(F.struct(F.lit(t).alias("table"), key.alias("key")))
    rows = classes.select("fp", F.inline(F.array(*keys)))
    busy = table(rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-busy")
    rows = rows.join(busy, ["table", "key"])
    k = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.select("fp", "table", "key", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))


def sliced_links(fps: np.ndarray, runs: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i < j, of one run and within the radius. ``fps``: uint64; ``runs``: run numbers, sorted."""
    n = len(fps)
    first = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    size = np.diff(np.r_[first, n])
    words = -(-size // 64)
    word0 = np.r_[0, np.cumsum(words)]
    run = np.repeat(np.arange(len(first)), size)
    place = np.arange(n) - first[run]
    word = word0[run] + place // 64
    lane = (place % 64).astype(np.uint64)
    begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    one = np.uint64(1)
    planes = np.stack([np.add.reduceat(((fps >> np.uint64(b)) & one) << lane, begin) for b in range(64)])
    full = np.add.reduceat(one << lane, begin)
    # a row meets its own word and the later ones of its run
    times = (word0[run + 1] - word).astype(np.int64)
    row = np.repeat(np.arange(n), times)
    at = word[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    counters = (radius + 1).bit_length()
    bias = (1 << counters) - (radius + 1)
    left, right = [], []
    for s in range(0, len(row), ENTRIES):
        r, w = row[s : s + ENTRIES], at[s : s + ENTRIES]
        count = [np.full(len(r), -(bias >> k & 1), np.int64).view(np.uint64) for k in range(counters)]
        over = ~full[w]  # empty lanes count as exceeded
        for b in range(64):
            carry = planes[b][w] ^ (np.uint64(0) - ((fps[r] >> np.uint64(b)) & one))
            for k in range(counters):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if b % STRIDE == STRIDE - 1 and b < 63:
                open_ = over != np.uint64(0xFFFFFFFFFFFFFFFF)
                if not open_.all():
                    r, w, over = r[open_], w[open_], over[open_]
                    count = [c[open_] for c in count]
                if not len(r):
                    break
        if len(r):
            hits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            e, bit = np.nonzero(hits)
            a, c = r[e], first[run[r[e]]] + (w[e] - word0[run[r[e]]]) * 64 + bit
            left.append(a[a < c])
            right.append(c[a < c])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index in each index's component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        old = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        if (label == old).all():
            break
    return label


def links(classes: DataFrame, radius: int = RADIUS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """(a, b) of fingerprints: edges whose components are those of all pairs within the radius."""

    def compare(table_: pa.Table) -> pa.RecordBatch:
        cols = [table_.column(k).to_numpy() for k in range(5)]
        fps = cols[0].view(np.uint64)
        new = np.zeros(len(fps), bool)
        for c in cols[1:]:
            new[1:] |= c[1:] != c[:-1]
        i, j = sliced_links(fps, np.cumsum(new), radius)
        label = forest(len(fps), i, j)
        own = np.flatnonzero(label != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(cols[0][own]), pa.array(cols[0][label[own]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last group may go on in the next batch
            cols = [batch.column(k).to_numpy() for k in range(1, 5)]
            other = np.zeros(batch.num_rows, bool)
            for c in cols:
                other |= c != c[-1]
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if cut:
                yield compare(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(1, 5)):
                yield compare(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield compare(pa.Table.from_batches(held))

    rows = band_groups(classes, radius, bands, block).repartition("table", "key", "i", "j")
    return rows.sortWithinPartitions("table", "key", "i", "j", "fp").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bands: int = BANDS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row.

    Texts without words (null and empty ones too) have fingerprint 0 and link like any other. Repeated rows and ties share a
    component. Null doc_ids are members but never name a component, unless it has no other id. Very long texts are hashed
    whole, 65,536 shingles at a time. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    own = table(fingerprints(docs, shingle), "simhash-fps")
    classes = table(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-classes")
    labels = table(connected_components(links(classes, radius, bands)), "simhash-labels")
    named = classes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("label", "fp").alias("label"))
    least = table(named.groupBy("label").agg(F.min("first").alias("component_id"), F.sum("n").alias("n")), "simhash-least")
    # only classes of more than one document have to be looked up
    found = named.drop("n").join(least.where("n > 1"), "label").select("fp", "component_id")
    found = table(found, "simhash-components")
    out = own.join(found.withColumnRenamed("fp", "c"), F.col("fp") == F.col("c"), "left")
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def hex_of(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without near copies: of every component, one row with its smallest doc_id.

    Rows are told apart by themselves, not by doc_id: a null or repeated doc_id with unrelated texts keeps each of them.
    """
    rows = numbered(docs)
    found = table(near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), **options), "simhash-rows")
    return smallest(rows, found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("label")))
