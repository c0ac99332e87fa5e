import numpy as np
import pytest

from sitescope.llm import whitening

from ..conftest import DATA


def brute(x):
    """Covariance by definition, whitened by its eigenvectors, in extended precision where sums are concerned."""
    n = len(x)
    y = x - np.array([sum(map(int, c)) for c in x.T], dtype=np.longdouble) / n
    v = (y.T @ y / n).astype(float)
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(32, len(e))
    return (y.astype(float) @ axes[:, :k]) / np.sqrt(e[:k]), e[:k] / np.trace(v)


def test_against_covariance(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    found = df.select("vec_id", "embedding").collect()
    x = whitening.grid(np.array([r[1] for r in found], float))
    want, explained = brute(x)
    got = {}
    rows = whitening.whitening_report(df.repartition(13)).collect()
    assert len(rows) == 32 * len(x)
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    sums = [sum(map(int, c)) for c in x.T]
    signs = np.sign([got[found[0][0]][k + 1]["whitened"] * want[0, k] for k in range(32)])
    for (vec_id, _), own, line in zip(found, x, want, strict=True):
        r = got[vec_id]
        assert np.allclose([r[k + 1]["whitened"] for k in range(32)], line * signs, atol=1e-9)
        assert {v["deviation"] for v in r.values()} == {sum((len(x) * int(a) - s) ** 2 for a, s in zip(own, sums, strict=True))}
    assert [got[found[0][0]][k + 1]["explained"] for k in range(32)] == pytest.approx(list(explained), rel=1e-10)
    assert {r["n"] for r in rows} == {len(x)} and max(r["identity_error"] for r in rows) < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    good = [(i, rng.standard_normal(4).tolist()) for i in range(40)]
    odd = [(100, None), (101, []), (102, [nan] * 4), (103, [1.0, inf, 0.0, 0.0]), (104, [None] * 4), (105, [1.0] * 3)]
    twice = [(None, [2.0, 0.0, 0.0, 0.0]), good[0]]
    df = spark.createDataFrame([(*r, "x", 1) for r in good + odd + twice], "vec_id long, embedding array<double>, vector string, row int")
    rows = whitening.whitening_report(df).collect()
    assert len(rows) == 42 * 4 and {r["vec_id"] for r in rows} == {None, *range(40)}
    x = whitening.grid(np.array([v for _, v in good + twice]))
    want, _ = brute(x)
    for k in range(4):
        got = {r["vec_id"]: r["whitened"] for r in rows if r["component"] == k + 1}
        sign = np.sign(got[1] * want[1, k])
        assert [got[i] for i in range(40)] == pytest.approx(list(want[:40, k] * sign), abs=1e-9)
    assert whitening.whitening_report(df.limit(0)).count() == 0
    assert whitening.whitening_report(df.where("vec_id = 3")).count() == 0


def test_hot_vector_and_large_entries(spark):
    """A third of the rows the same; a constant dimension has no component; entries may be huge."""
    rng = np.random.default_rng(6)
    rows = [(i, [0.5, 0.25, 7.0] if i % 3 == 0 else [*rng.standard_normal(2).tolist(), 7.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(20)
    got = whitening.whitening_report(df).collect()
    assert {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-9
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<float>")
    assert {(r["vec_id"], r["deviation"]) for r in whitening.whitening_report(huge).collect()} == {(1, None), (2, None), (3, 102_400)}


def test_exact_deviation_of_large_numbers():
    x = np.array([[3 << 40, 5], [1 << 40, -7]])
    centre = whitening.Centre(2, [int(v) for v in x.sum(axis=0)])
    assert centre.deviation(x) == [None, None]
    x = np.array([[1 << 30, 5], [0, -7]])
    centre = whitening.Centre(2, [int(v) for v in x.sum(axis=0)])
    assert centre.deviation(x) == [2**60 + 144] * 2
