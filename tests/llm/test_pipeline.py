import corpus_pipeline as pipeline
import pytest

from sitescope.llm import common, queries

from ..conftest import DATA
from .test_lines import brute as brute_lines
from .test_lines import brute_texts
from .test_near import brute_kept
from .test_packing import verify
from .test_quality import brute as brute_quality


def chain(documents):
    """The documents that reach the last stage, each as often as it is taken, without Spark: SQL for the verdicts of quality
    and the copies of mixing, all lines and all pairs of texts compared in plain Python."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", documents)
    kept = {i for (i,) in con.execute(f"SELECT doc_id FROM ({queries.SQL['op3_quality_rules']}) WHERE kept").fetchall()}
    rows = [(i, t) for i, t in zip(documents["doc_id"].tolist(), documents["text"].tolist(), strict=True) if i in kept]
    lined = {i: "\n".join(lines) for i, _, lines in brute_texts(rows)}
    left = set(brute_kept(list(lined.items())))
    single = documents[documents["doc_id"].isin(left)].copy()
    single["text"] = [lined[i] for i in single["doc_id"]]
    con.unregister("documents")
    con.register("documents", single)
    taken = con.execute(f"SELECT doc_id, size, taken FROM ({queries.SQL['op2_mixing']})").fetchall()
    assert all(size > 0 for _, size, _ in taken)  # copies of texts without words have no size to be told by
    return [{"doc_id": i, "text": lined[i]} for i, size, n in taken for _ in range(n // size)]


def test_run(spark):
    """run() against the chain: each piece of each copy with its ids, in gapless sequences that are nearly as few as can be."""
    documents = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    assert documents["doc_id"].is_unique
    n, total = verify(pipeline.run(spark, DATA).collect(), chain(documents))
    assert n <= -(-total // 2048) + 1


def test_stages(spark):
    """Every stage against plain Python on what the one before it kept."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = []
    for name, stage in pipeline.STAGES:
        before = docs
        docs = common.table(stage(spark, docs, DATA), name)
        if name != "best_fit_packing":
            assert docs.columns == before.columns
        kept.append(docs)
    good, lined, single, mixed, packed = kept
    source = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    passing = {i for i, r in source.items() if not brute_quality(r["text"])[5]}
    assert {r["doc_id"] for r in good.collect()} <= passing and good.count() > 0.85 * len(passing)
    assert all(source[r["doc_id"]]["text"] == r["text"] for r in good.collect())

    want = {r[0]: r[2] for r in brute_lines([(r["doc_id"], r["text"]) for r in good.collect()])}
    for r in lined.collect():
        assert len(r["text"].split("\n")) == len(source[r["doc_id"]]["text"].split("\n")) - want[r["doc_id"]] or not r["text"]
        assert r["n_chars"] == len(r["text"])

    left = brute_kept([(r["doc_id"], r["text"]) for r in lined.collect()])
    assert sorted(r["doc_id"] for r in single.collect()) == left
    assert {r["doc_id"] for r in mixed.collect()} <= set(left)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mixed.collect()}


def test_odd_documents(spark, odd, none):
    for docs in (odd, none):
        for name, stage in pipeline.STAGES:
            docs = common.table(stage(spark, docs, DATA), name)
        assert docs.columns[:2] == ["doc_id", "piece"]
