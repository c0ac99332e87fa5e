"""Approximate nearest neighbours by inner product: multi-index hashing of learned rotated binary codes.

Codes: vectors are centred and turned by learned rotations (iterative quantization), the signs are the bits; CODES rotations
give 64 bits each. A code is cut into substrings of eight bits. Two codes within Hamming radius r agree in at least one of
the m substrings up to floor(r / m) bits, so a substring index that is probed within that sub-radius returns every code
within r (pigeonhole). A table of the index holds, for each of its 256 values, the rows within the sub-radius as a bitmap:
probing one table is one look-up, and the candidates are the union over the tables. Candidates within r are then ranked by
the exact inner product of the original vectors in double precision.

The rotations and the radius are fitted on a bounded sample (SAMPLE vectors at most); every vector is indexed. The stated
queries meet the indexed vectors in blocks: each task builds the index of its shard and reads the query blocks from the
shared folder one after another; the best of each shard are merged by query. Vectors are rotated as they are, which suits
an inner product between vectors of like norm; where norms differ, a further coordinate makes them equal (sqrt(M^2 - |x|^2)).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path
from .files import open_store

SAMPLE, CODES, ROUNDS = 4096, 2, 20
K = 20
#: Part of the sample's true neighbours that the radius has to cover.
COVER = 0.97
#: Vectors in the shard of a task, queries in a block.
SHARD_ROWS, QUERY_ROWS = 8192, 512


class Coder(NamedTuple):
    mean: np.ndarray
    turns: np.ndarray  # dimensions x bits
    radius: int
    norm: float

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.c_[x, rest]

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes as bytes, one row a vector. Queries are scaled to the norm; that leaves their order of neighbours."""
        if query:
            x = x * (self.norm / np.linalg.norm(x, axis=1))[:, None]
        return np.packbits((self.lift(x, query) - self.mean) @ self.turns > 0, axis=1, bitorder="little")


def fit(sample: np.ndarray, norm: float, codes: int = CODES, k: int = K, seed: int = 7) -> Coder:
    """Learns rotations by iterative quantization from different starts, and the radius that covers the neighbours."""
    rng = np.random.default_rng(seed)
    plain = Coder(np.zeros(sample.shape[1] + 1), np.zeros((sample.shape[1] + 1, 0)), 0, norm)
    lifted = plain.lift(sample)
    mean = lifted.mean(0)
    x = lifted - mean
    d = x.shape[1]
    bits = min(64, 8 * max(1, (d - 1) // 8))
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    turns = []
    for _ in range(codes):
        turn = np.linalg.qr(rng.standard_normal((bits, bits)))[0]
        y = x @ axes
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
            turn = (u @ v).T
        turns.append(axes @ turn)
    coder = plain._replace(mean=mean, turns=np.concatenate(turns, axis=1))
    own, asked = coder.codes(sample), coder.codes(sample[::8], query=True)
    near = np.argsort(-(sample[::8] @ sample.T), axis=1, kind="stable")[:, 1 : k + 1]
    far = np.bitwise_count(own[near] ^ asked[:, None]).sum(2, dtype=int)
    return coder._replace(radius=int(np.quantile(far, COVER)) if far.size else 0)


class Index:
    """The multi-index of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, coder: Coder) -> None:
        self.ids, self.x, self.coder = ids, x, coder
        self.codes = coder.codes(x)
        self.words = self.codes.view(np.uint64) if self.codes.shape[1] % 8 == 0 else self.codes
        self._tables: dict[int, list[np.ndarray]] = {}

    def tables(self, sub: int) -> list[np.ndarray]:
        """For each substring: value -> bitmap of the rows within ``sub`` bits of it."""
        if sub not in self._tables:
            values = np.arange(256, dtype=np.uint8)
            near = np.bitwise_count(values[:, None] ^ values[None, :]) <= sub
            self._tables = {sub: []}
            for c in self.codes.T:
                held = np.packbits(c[None, :] == values[:, None], axis=1)
                self._tables[sub].append(np.stack([np.bitwise_or.reduce(held[row], axis=0) for row in near]))
        return self._tables[sub]

    def within(self, asked: np.ndarray, radius: int) -> np.ndarray:
        """(query, row) pairs of all codes within the radius: probe every table, then check whole codes."""
        tables = self.tables(radius // self.codes.shape[1])
        seen = np.bitwise_or.reduce([t[a] for t, a in zip(tables, asked.T, strict=True)])
        q, r = np.nonzero(np.unpackbits(seen, axis=1, count=len(self.ids)))
        own = asked.view(self.words.dtype)
        far = sum(np.bitwise_count(own[q, k] ^ self.words[r, k]).astype(np.uint16) for k in range(own.shape[1]))
        hit = far <= radius
        return np.stack([q[hit], r[hit]])

    def search(self, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, candidate id, score): the k best of the shard; the radius grows while a query has fewer than k."""
        asked = self.coder.codes(x, query=True)
        open_, found, radius = np.arange(len(ids)), [], self.coder.radius
        most = 8 * self.codes.shape[1]
        while len(open_):
            q, r = self.within(asked[open_], radius)
            keep = self.ids[r] != ids[open_[q]]
            q, r = q[keep], r[keep]
            enough = np.bincount(q, minlength=len(open_)) >= k if radius < most else np.ones(len(open_), bool)
            done = enough[q]
            found.append((open_[q[done]], r[done]))
            open_, radius = open_[~enough], min(most, radius + max(8, radius // 4))
        q, r = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
        score = np.concatenate([np.einsum("ij,ij->i", x[q[s : s + 65536]], self.x[r[s : s + 65536]]) for s in range(0, len(q), 65536)] or [np.zeros(0)])
        order = np.lexsort((self.ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        top = rank < k
        return q[top], self.ids[r[top]], score[top]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of vectors that take part: not null, not zero, all components present and finite, and of an id."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select("vec_id", x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    return rows.where(~bad & F.exists("x", lambda v: v != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k nearest among ``vectors`` (vec_id, embedding), itself apart.

    An empty table or no queries give no rows. Repeated rows of a vec_id are candidates of their own, but one query: the
    smallest of their vectors, by component, asks. Vectors have the length that most have (the shorter of equally many);
    others take no part. Null, zero and non-finite vectors take none either; other columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    length = F.sqrt(F.aggregate(F.transform("x", lambda v: v * v), F.lit(0.0), lambda a, v: a + v))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.max(length).alias("norm"), F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("x") == most["d"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLE).select("x").collect()  # SAMPLE vectors at most
    coder = fit(np.array([r["x"] for r in sample]), float(most["norm"]) * (1 + 1e-9), k=k)

    folder = scratch_path(spark, "ann-queries")
    asked = usable(queries).where(F.size("x") == most["d"]).groupBy("vec_id").agg(F.min("x").alias("x"))
    asked.write.option("maxRecordsPerFile", QUERY_ROWS).parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = open_store(folder)
        blocks = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))

        def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = pa.Table.from_batches(held)
            index = Index(own.column(0).to_numpy(), _matrix(own.column(1).combine_chunks()), coder)
            for block in blocks:
                with store.open_input_file(block) as f:
                    part = pq.read_table(f)
                for s in range(0, part.num_rows, QUERY_ROWS):
                    piece = part.slice(s, QUERY_ROWS)
                    ids = piece.column("vec_id").to_numpy()
                    q, found, score = index.search(ids, _matrix(piece.column("x").combine_chunks()), k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])

        held, n = [], 0
        for b in batches:
            for s in range(0, b.num_rows, SHARD_ROWS):
                piece = b.slice(s, SHARD_ROWS)
                if n + piece.num_rows > SHARD_ROWS:
                    yield from answer(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if held:
            yield from answer(held)

    shards = max(1, -(-most["n"] // SHARD_ROWS))
    best = rows.repartition(int(shards)).mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
