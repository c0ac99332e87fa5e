"""Whitening of embeddings by TSQR: right singular vectors of the centred rows, without their covariance matrix.

Entries are put on a grid (x = floor(64 * c) + 1,000,000, a long), so that the sums of every dimension are exact and rows can
be centred without rounding beyond the last bit: x - S // n is a whole number, and (S % n) / n is taken off it in doubles.
Each task runs over its rows in blocks and keeps one upper triangular factor: the QR factor of the factor so far with the next
block below it. The factors of FAN tasks at a time are merged the same way, level by level, in written tables; the last one,
of dimensions times dimensions numbers, is taken apart by SVD. Its right vectors are the components, and its singular values
s give their eigenvalues s * s / n. Nothing whole passes through a task or the driver: a task holds a block and a factor, a
merge FAN factors, and the driver one factor and the sums.

Special cases. Rows whose vector is null, empty, or holds a null or non-finite entry are dropped; so are vectors of another
length than most have (of equally frequent lengths the longer counts). Repeated rows, null ids and ties count as rows of their
own, each with results. Entries are held within plus or minus 2^47 before they go on the grid. Components whose singular value
is zero to double precision have no whitened values and are not listed, so a single row or equal rows give no components and
no result rows; nor does an empty table. Components have either sign; here the largest entry (of equal ones the first) is
positive. A deviation that exceeds a long is null. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table

GRID, SHIFT, MOST = 64.0, 1_000_000, 1 << 47
#: Components at most, rows of a block, factors that one merge takes.
COMPONENTS, BLOCK_ROWS, FAN = 32, 4096, 8


class Centre(NamedTuple):
    n: int
    sums: list[int]

    def whole(self, x: np.ndarray) -> np.ndarray:
        """x - S // n, exact."""
        return x - np.array([s // self.n for s in self.sums], dtype=np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.whole(x) - np.array([s % self.n / self.n for s in self.sums])

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)^2 over the dimensions of each row, exact; None beyond a long."""
        rest, y = [s % self.n for s in self.sums], self.whole(x)
        most = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if most * most * len(rest) >= 1 << 63:
            y = y.astype(object)
        far = y * self.n - np.array(rest, dtype=y.dtype)
        return [int(v) if v < 1 << 63 else None for v in (far * far).sum(axis=1)]


class Whitening(NamedTuple):
    centre: Centre
    components: np.ndarray  # dimensions x components
    values: np.ndarray  # their eigenvalues, falling
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre.rows(x) @ (self.components / np.sqrt(self.values))

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist()


def grid(c: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(c, -MOST, MOST) * GRID).astype(np.int64) + SHIFT


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors on the grid, one row each. The column vector holds lists of one length."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            part = b.slice(at, BLOCK_ROWS)
            flat = part.column("vector").flatten().to_numpy(zero_copy_only=False)
            yield part, grid(flat.reshape(part.num_rows, -1))


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(row, vector): the rows that take part, as structs of their columns, and their vectors as doubles."""
    found = rows.select(F.struct("*").alias("row"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    found = found.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    lengths = found.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    return found.where(F.size("vector") == (most["size"] if most else 0))


def centre_of(rows: DataFrame) -> Centre | None:
    """The number of vectors and the exact sums of their dimensions; None if there are none."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for _, x in blocks(batches):
            # A block of whole numbers below 2^40 cannot leave a long; larger ones are added without bound.
            own = (x if np.abs(x).max() < 1 << 40 else x.astype(object)).sum(axis=0)
            n, sums = n + len(x), [int(v) + s for v, s in zip(own, sums or [0] * len(own), strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": [[Decimal(s) for s in sums]]}, schema=pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))]))

    parts = rows.select("vector").mapInArrow(partial, "n long, sums array<decimal(38,0)>")
    sums = parts.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found = sums.orderBy("at").collect()  # one row for each dimension
    return Centre(int(found[0]["n"]), [int(r["s"]) for r in found]) if found else None


def merged(parts: DataFrame, merge: Callable[[bytes, bytes], bytes], name: str) -> bytes | None:
    """The values ``data`` of all rows (part, data) merged FAN neighbours at a time, level by level; None if there are none."""

    def up(key: tuple, rows: pa.Table) -> pa.Table:
        found = sorted(zip(rows["part"].to_pylist(), rows["data"].to_pylist(), strict=True))
        data = found[0][1]
        for _, other in found[1:]:
            data = merge(data, other)
        return pa.table({"part": [key[0].as_py()], "data": [data]})

    while True:
        parts = table(parts, name)
        last = parts.agg(F.max("part")).first()[0]
        if last is None or last == 0:
            return parts.first()["data"] if last == 0 else None
        parts = parts.withColumn("up", F.floor(F.col("part") / FAN).cast("long")).groupBy("up").applyInArrow(up, "part long, data binary")


def _per_task(rows: DataFrame, fold: Callable[[Iterator[np.ndarray]], bytes | None]) -> DataFrame:
    """(part, data): what ``fold`` makes of the vectors of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        data = fold(x for _, x in blocks(batches))
        if data is not None:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "data": [data]}, schema=pa.schema([("part", pa.int64()), ("data", pa.binary())]))

    return rows.select("vector").mapInArrow(run, "part long, data binary")


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all ``usable`` rows; None if there are none."""
    centre = centre_of(rows)
    if centre is None:
        return None
    d = len(centre.sums)

    def factor(found: Iterator[np.ndarray]) -> bytes | None:
        r = None
        for x in found:
            y = centre.rows(x)
            r = triangle(y if r is None else np.concatenate([r, y]))
        return None if r is None else r.tobytes()

    def both(a: bytes, b: bytes) -> bytes:
        return triangle(np.frombuffer(a + b).reshape(-1, d)).tobytes()

    last = np.frombuffer(merged(_per_task(rows, factor), both, "whitening-factors")).reshape(-1, d)
    _, s, right = np.linalg.svd(last)
    held = s > s[0] * max(centre.n, d) * np.finfo(float).eps
    k = min(components, int(held.sum()))
    axes = right[:k].T
    largest = axes[np.abs(axes).argmax(axis=0), np.arange(k)]
    return Whitening(centre, axes * np.where(largest < 0, -1.0, 1.0), s[:k] ** 2 / centre.n, float((s**2).sum() / centre.n))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of (covariance of the whitened rows - identity), centred before multiplying."""
    k = len(model.values)

    def moments(found: Iterator[np.ndarray]) -> bytes | None:
        total = None
        for x in found:
            w = model.whiten(x)
            mean = w.mean(axis=0)
            one = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
            total = one.tobytes() if total is None else both(total, one.tobytes())
        return total

    def both(a: bytes, b: bytes) -> bytes:
        """Counts, means and sums of centred products of two sets of rows, from those of each."""
        a, b = np.frombuffer(a), np.frombuffer(b)
        n, far = a[0] + b[0], b[1 : k + 1] - a[1 : k + 1]
        products = a[k + 1 :] + b[k + 1 :] + (np.outer(far, far) * (a[0] * b[0] / n)).ravel()
        return np.concatenate([[n], a[1 : k + 1] + far * (b[0] / n), products]).tobytes()

    found = np.frombuffer(merged(_per_task(rows, moments), both, "whitening-moments"))
    return float(np.abs(found[k + 1 :].reshape(k, k) / found[0] - np.eye(k)).max(initial=0.0))


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """The ``usable`` rows with ``deviation`` and the array ``whitened``, one entry for each component."""
    kept = rows.select("row").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in blocks(batches):
            w = model.whiten(x)
            values = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], w.ravel())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(model.centre.deviation(x), pa.int64()), values], names=["row", "deviation", "whitened"])

    made = StructType.fromDDL("deviation long, whitened array<double>")
    return rows.mapInArrow(run, StructType([*kept.fields, *made.fields]))


def whitening_report(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each vector that takes part and each component, with figures of the whole fit."""
    rows = usable(vectors.select("vec_id", "embedding"))
    model = fit(rows, components)
    if model is None or not len(model.values):
        none = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.limit(0).selectExpr("vec_id", *[f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in none.split(", ")])
    parts = whitened(rows, model).select(F.col("row.vec_id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return parts.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.centre.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.array(*[F.lit(e) for e in model.explained]), F.col("at")).alias("explained"),
        F.lit(identity_error(rows, model)).alias("identity_error"),
    )
