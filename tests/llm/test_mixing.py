"""Targets by water filling, copies near the targets, and reruns."""

from collections import defaultdict

from pyspark.sql import functions as F

from folio.llm import mixing


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, fixed, budget = {}, set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        total = sum(weight[s] for s in free)
        left = budget - sum(2 * sizes[s] for s in fixed)
        target = {s: 2.0 * sizes[s] if s in fixed else left * weight[s] / total for s in order}
        over = {s for s in free if target[s] >= 2 * sizes[s]}
        if not over:
            return target
        fixed |= over


def check(frame, tolerance):
    rows = mixing.repetitions(frame).select("row.*", "size", "source_size", "target", "copies").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").encode().split())
        assert r["size"] == len((r["text"] or "").encode().split())
        assert 0 <= r["copies"] <= 2
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        taken[r["source"]] += r["size"] * r["copies"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= tolerance * max(want[s], 1)
    return rows


def test_documents(documents):
    rows = check(documents, 0.12)
    again = mixing.repetitions(documents).select("row.*", "copies").collect()
    key = lambda r: (r["doc_id"], r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    mixed = mixing.mix(documents)
    assert mixed.schema == documents.schema
    copies = {r["doc_id"]: r["copies"] for r in rows}
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert times == {k: v for k, v in copies.items() if v}


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs, 10.0)
    assert mixing.mix(odd_docs).schema == odd_docs.schema
    assert mixing.mix(no_docs).count() == 0


def test_hot_source(spark):
    frame = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("source"),
    )
    check(frame, 0.01)


def test_repeated_rows_draw_each_for_itself(spark):
    """Sources of equal rows (same id and text) come near their targets, and reruns agree."""
    rows = [(1, "w " * 500, "a")] * 400 + [(2, "v " * 100, "b")] * 300 + [(3 + i, "u " * 50, "c") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6, "source").sortWithinPartitions("doc_id")
    got = check(frame, 0.02)
    again = check(frame, 0.02)
    count = lambda rows: sorted((r["doc_id"], r["copies"]) for r in rows)
    assert count(got) == count(again)
