"""The kernel against its definition, held-out accuracy, and disguised insults."""

import os
import zlib
from itertools import combinations

import numpy as np
import pytest

from folio.llm import toxicity as tx


def plain_kernel(s, t):
    total = 0.0
    for a in combinations(range(len(s)), tx.ORDER):
        for b in combinations(range(len(t)), tx.ORDER):
            if all(s[i] == t[j] for i, j in zip(a, b)):
                total += tx.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
    return total


def test_kernel_equals_definition():
    words = ["idiot", "idixot", "trash", "aaa", "ab", "réeux", "thrashing"]
    pairs = [(a, b) for a in words for b in words]
    got = tx.kernel(tx._codes([a for a, _ in pairs]), tx._codes([b for _, b in pairs]))
    assert np.allclose(got, [plain_kernel(a, b) for a, b in pairs], rtol=1e-4)


@pytest.fixture(scope="module")
def fitted(spark):
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("test tables not available")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    return docs, labels, tx.fit(docs, labels)


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    docs = docs.join(labels.select("doc_id"), "doc_id")
    rows = tx.scores(docs, model).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [(r["score"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    good = [s for s, y in held if not y]
    bad = [s for s, y in held if y]
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc > 0.9 and np.mean([s >= 0.7 for s in good]) < 0.02


def test_disguised_insults(spark, fitted):
    model = fitted[2]
    insult = [w for w in model.landmarks if w.isascii()][0]
    assert len(insult) >= 4
    shown = ["-".join(insult), " ".join(insult), insult.upper() + "!!", insult[:2] + "x" + insult[2:], f"({insult})", insult + "s"]
    rows = [(i, f"Here stands a {w} between plain words.") for i, w in enumerate(shown)]
    rows += [(90, "Here stands a house between plain words."), (91, ""), (92, None)]
    got = {r["doc_id"]: r["score"] for r in tx.scores(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[91] == got[92] <= got[90] < min(got[i] for i in range(len(shown)))


def test_odd_rows(spark, odd_docs, no_docs, fitted):
    model = fitted[2]
    assert tx.scores(odd_docs, model).count() == odd_docs.count()
    kept = tx.drop_toxic(odd_docs, model)
    assert kept.schema == odd_docs.schema and kept.count() == odd_docs.count()
    assert tx.scores(no_docs, model).count() == 0
    labels = spark.createDataFrame([(1, 0), (None, 1), (4, None), (4, 0)], "doc_id long, toxic int")
    assert tx.fit(odd_docs, labels) is None
    assert {r["score"] for r in tx.scores(odd_docs, None).collect()} == {0.0}
    assert tx.fit(odd_docs, labels.where("doc_id > 99")) is None
