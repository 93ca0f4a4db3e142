"""The pipeline's stages: each keeps what the one before it kept, and its decisions take effect."""

import pytest

import corpus_pipeline as cp
from folio.llm import fertility, mixing, neardup, packing, toxicity


def test_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality_rules", "near_dedup", "mixing", "packing"]


@pytest.fixture(scope="module")
def steps(spark, sf_small, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], sf_small).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def key(rows):
    return sorted((r["doc_id"], r["text"]) for r in rows)


def test_filters(spark, sf_small, steps):
    docs, clean, good, single, mixed, packed = steps
    for frame in (clean, good, single, mixed):
        assert frame.columns == docs.columns
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_small}/labels.parquet"))
    passed = {r["doc_id"] for r in toxicity.scores(docs, model).where("score < 0.7").collect()}
    assert {r["doc_id"] for r in clean.collect()} == passed
    kept = {r["doc_id"] for r in fertility.measures(clean).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept < passed
    classes = neardup.classes(good).collect()
    assert [r["doc_id"] for r in sorted(single.collect(), key=lambda r: r["doc_id"])] == sorted({r["class_id"] for r in classes})
    copies = {r["doc_id"]: r["copies"] for r in mixing.repetitions(single).select("row.doc_id", "copies").collect()}
    assert key(mixed.collect()) == key(r for r in single.collect() for _ in range(copies[r["doc_id"]]))
    tokens = packed.groupBy("doc_id").sum("length").collect()
    encoder = packing.ByteIds()
    want = {}
    for r in mixed.collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + len(encoder.whole(r["text"])) // 4 + 1
    assert {r[0]: r[1] for r in tokens} == want


def test_run_equals_the_stages(spark, sf_small, steps):
    got = cp.run(spark, sf_small)
    cols = ["doc_id", "start", "length", "doc_tokens"]
    assert got.groupBy("doc_id").sum("length").orderBy("doc_id").collect() == steps[-1].groupBy("doc_id").sum("length").orderBy("doc_id").collect()
    assert set(cols) <= set(got.columns)


def test_empty_and_odd(spark, sf_small, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, sf_small)
            assert name == "packing" or out.schema == docs.schema
            assert out.count() >= 0
