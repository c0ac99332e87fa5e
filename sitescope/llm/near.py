"""Near copies by the Jaccard index of five-word shingles: bit-sliced SimHash in clusters, then exact confirmation.

At an index of 0.8 fingerprints of sets of shingles differ in some ten of 64 bits (12 for sets of four and five). A radius
that covers them leaves SimHash's pigeonhole nothing to prune by, so classes of texts (those of the same words) meet another
way: those that share a band of minima are tied to clusters. BANDS bands of WIDTH minima miss a pair at 0.8 with a chance of
6e-5, and closer ones more rarely. In a cluster, fingerprints are compared in bit planes with carry-save counters at RADIUS
bits (a pair at 0.8 lies beyond it with a chance of 5e-5 at most, unrelated ones within it with 3e-2); pairs within are
compared by their exact sets of shingles. Only confirmed pairs are links. Large clusters are cut into blocks and compared in
pairs of blocks, so that no task holds more than two; a pair of blocks returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, numbered, sliced, smallest, table, text_of
from .components import connected_components
from .simhash import byte_counts, forest, majority, sliced_links

SHINGLE, LIMIT, SEED = 5, (4, 5), 42
BANDS, WIDTH, BLOCK, RADIUS = 32, 6, 128, 24
#: Columns of the table of shared shingles that are multiplied at a time.
COLUMNS = 4096

_ODD = np.random.default_rng(SEED).integers(0, 2**63, BANDS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: bytes, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """A hash of a text's words and the sorted hashes of its distinct shingles, A-Z lower-cased. Under five words: one."""
    import xxhash

    words = data.lower().split()  # bytes: only A-Z, and white space is \x20 \x09-\x0D
    whole = xxhash.xxh64_intdigest(b" ".join(words), SEED)
    if not words:
        return whole, np.zeros(0, np.uint64)
    parts = (b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1)))
    return whole, np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """The keys of a set's bands; no key for an empty set."""
    import xxhash

    if not len(found):
        return []
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        low = np.minimum(low, (found[None, at : at + 1024] * _ODD[:, None]).min(axis=1))
    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(low.reshape(BANDS, WIDTH))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def keyed(rows: DataFrame) -> DataFrame:
    """(row, cls, keys) of (row, text): the class of equal words and the keys of the bands. Null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            made = [shingles(t.as_py()) for t in b.column(1)]
            cls = np.array([w for w, _ in made], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cls), pa.array([bands(x) for _, x in made], pa.list_(pa.int64()))], ["row", "cls", "keys"])

    return rows.select("row", F.encode(text_of(), "UTF-8").alias("t")).mapInArrow(run, "row long, cls long, keys array<long>")


def clusters(classes: DataFrame) -> DataFrame:
    """(node, label): classes that are tied by shared bands, directly or over others. ``classes``: cls, keys."""
    rows = classes.select("cls", F.explode("keys").alias("key"))
    busy = rows.groupBy("key").agg(F.min("cls").alias("m"), F.max("cls").alias("x")).where("m < x").select("key", "m")
    ties = rows.join(table(busy, "near-busy"), "key").where("cls <> m").select(F.col("cls").alias("a"), F.col("m").alias("b"))
    return connected_components(ties.distinct())


def close(sets: list[np.ndarray], first: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i < j, of sets whose fingerprints are within ``radius`` bits and whose Jaccard index is LIMIT or more."""
    fps = np.array([majority(byte_counts(s), len(s)) for s in sets], np.int64).view(np.uint64)
    i, j = sliced_links(fps, np.zeros(len(fps), np.int64), radius)
    if first:
        across = (i < first) & (j >= first)
        i, j = i[across], j[across]
    if not len(i):
        return i, j
    rows, at = np.unique(np.r_[i, j], return_inverse=True)
    near = np.zeros((len(rows), len(rows)), bool)
    near[confirmed([sets[r] for r in rows], int(np.searchsorted(rows, first)))] = True
    keep = near[at[: len(i)], at[len(i) :]]
    return i[keep], j[keep]


def confirmed(sets: list[np.ndarray], first: int) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j), i < j, with a Jaccard index of LIMIT or more. With ``first``, only pairs of one below and one from it."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    own = np.repeat(np.arange(n), size)
    _, at, count = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    own, at = own[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    both = np.zeros((n, n), np.float64)
    for c in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(at, [c, c + COLUMNS])
        held = np.zeros((n, COLUMNS), np.float32)
        held[own[a:b], at[a:b] - c] = 1
        both += held @ held.T
    num, den = LIMIT
    near = (den * both >= num * (size[:, None] + size[None, :] - both)) & (both > 0)
    if first:
        near[:first, :first] = near[first:, first:] = False
    return np.nonzero(np.triu(near, 1))


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b) of classes: edges whose components are those of all near copies. ``nodes``: label, cls, t (the text's bytes)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            found = [shingles(t.as_py())[1].view(np.int64) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], ["label", "cls", "found"])

    sets = table(nodes.select("label", "cls", "t").mapInArrow(read, "label long, cls long, found array<long>"), "near-sets")
    sizes = table(sets.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("k")), "near-sizes")
    rows = join_small(sets, sizes, ["label"], "inner", spread="cls").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select("label", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "cls", "found")

    def compare(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        # a pair of two blocks leaves the pairs within a block to that block's own group
        first = sum(h[0] == held[0][0] for h in held) if held[0][2] != held[0][3] else 0
        cls = np.array([h[4] for h in held], np.int64)
        label = forest(len(held), *close([h[5] for h in held], first))
        own = np.flatnonzero(label != np.arange(len(held)))
        return cls[own], cls[label[own]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in sliced(batches):
            left, right = [], []
            flat = zip(*[b.column(k).to_pylist() for k in range(5)], b.column(5), strict=True)
            for label, i, j, own, cls, found in flat:
                row = (own, label, i, j, cls, found.values.to_numpy(zero_copy_only=False).view(np.uint64))
                if held and held[-1][1:4] != row[1:4]:
                    a, c = compare(held)
                    left.append(a), right.append(c)
                    held = []
                held.append(row)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
        if held:
            a, c = compare(held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    return rows.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "own").mapInArrow(run, "a long, b long")


def components(rows: DataFrame) -> DataFrame:
    """(row, label) of numbered rows: equal labels are near copies, directly or over others."""
    own = table(keyed(rows.select("row", F.col("doc.text").alias("text"))), "near-keys")
    classes = table(own.groupBy("cls").agg(F.min("row").alias("row"), F.first("keys").alias("keys")), "near-classes")
    found = table(clusters(classes), "near-clusters")
    named = found.join(classes.select("cls", "row"), F.col("node") == F.col("cls")).select("row", "cls", "label")
    texts = rows.select("row", F.encode(F.coalesce("doc.text", F.lit("")), "UTF-8").alias("t"))
    near = links(join_small(texts, table(named, "near-nodes"), ["row"], "inner", salts=1))
    labels = table(connected_components(table(near, "near-links")).withColumnRenamed("node", "cls"), "near-labels")
    return join_small(own.select("row", "cls"), labels, ["cls"], spread="row").select("row", F.coalesce("label", "cls").alias("label"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of every component, one row with its smallest doc_id.

    Null and empty texts are texts without words, which are copies of each other and near nothing else. Rows are told apart
    by themselves, not by doc_id: unrelated texts under null or repeated ids all stay. Among repeated rows and ties the
    content decides. Very long texts are compared whole. An empty table stays empty; columns may have any names.
    """
    rows = numbered(docs)
    return smallest(rows, components(rows))
