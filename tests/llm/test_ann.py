import numpy as np
import pytest
from pyspark.sql import functions as F

from sitescope.llm import ann

from ..conftest import DATA


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        score = x @ x[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-score[i], ids[i]))[:k]
        out[q] = [ids[i] for i in order]
    return out


def test_recall(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = sorted(df.select("vec_id", "embedding").collect())
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    want = exact(ids, x, [i for i in ids if i % 20 == 0], 20)
    hits = sum(r["vec_id"] in want[r["query_id"]] for r in got)
    assert len(got) == 20 * len(want) and hits >= 0.9 * len(got)
    for r in got[:50]:
        assert r["score"] == pytest.approx(float(x[ids.index(r["query_id"])] @ x[ids.index(r["vec_id"])]), abs=1e-12)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    good = [(i, rng.standard_normal(16).tolist()) for i in range(30)]
    odd = [(100, None), (101, [0.0] * 16), (102, [nan] * 16), (103, [inf] * 16), (104, [None] * 16), (None, [1.0] * 16), (20, None), (5, good[5][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in good + odd], "vec_id long, embedding array<float>, rank string")
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).collect()
    assert {r["query_id"] for r in got} == {0, 20} and not {r["vec_id"] for r in got} & {100, 101, 102, 103, 104, None}
    assert sorted(r["rank"] for r in got if r["query_id"] == 0) == list(range(1, 21))
    few = spark.createDataFrame(good[:3], "vec_id long, embedding array<float>")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 2
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0] + [0.0] * 7) for i in range(60)] + [(i, [0.0, 1.0] + [0.0] * 6) for i in range(60, 90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [r["vec_id"] for r in ann.nearest(df, df.where("vec_id = 40")).orderBy("rank").collect()]
    assert got == list(range(20))


def test_repeated_ids_and_other_lengths(spark):
    """The smallest vector of a repeated id asks, in every run; vectors of another length and clashing columns change nothing."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(50)]
    twin = (20, [x - 1.0 for x in rows[20][1]])
    other = [(60, [1.0] * 7), (40, [9.0] * 9), (61, [1.0])]
    df = spark.createDataFrame([(*r, {"x": 1}, 5) for r in [*rows, twin, *other]], "vec_id long, embedding array<double>, x map<string, int>, rank int")
    runs = [sorted(map(tuple, ann.nearest(d, d.where("vec_id % 20 = 0"), k=60).collect())) for d in (df, df.repartition(7).orderBy("rank", F.desc("vec_id")))]
    assert runs[0] == runs[1] and {r[0] for r in runs[0]} == {0, 20, 40}
    asks = {0: rows[0][1], 20: min(rows[20][1], twin[1]), 40: rows[40][1]}
    for q, v in asks.items():
        want = sorted((-float(np.dot(v, x)), i) for i, x in [*rows, twin] if i != q)
        got = [r for r in runs[0] if r[0] == q]
        assert [r[2] for r in got] == [i for _, i in want] and np.allclose([r[3] for r in got], [-s for s, _ in want])


def test_index_returns_every_code_within_the_radius():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 32))
    coder = ann.fit(x, float(np.linalg.norm(x, axis=1).max()), k=5)
    index = ann.Index(np.arange(300), x, coder)
    asked = coder.codes(x[:20], query=True)
    far = np.bitwise_count(asked[:, None] ^ index.codes[None]).sum(2, dtype=int)
    for radius in (0, 9, 14, 25):
        q, r = index.within(asked, radius)
        assert set(zip(q.tolist(), r.tolist(), strict=True)) == set(zip(*(a.tolist() for a in np.nonzero(far <= radius)), strict=True))
