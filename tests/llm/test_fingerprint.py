"""Digests, likeness, and the next document."""

import hashlib

import numpy as np

from folio.llm import fingerprint as fp


def brute_counts(data: bytes) -> list[int]:
    counts = [0] * fp.BUCKETS
    for end in range(fp.WINDOW - 1, len(data)):
        for (i, j), (a, b, c) in zip(fp.TRIPLETS, fp._HASH):
            counts[a[data[end]] ^ b[data[end - i]] ^ c[data[end - j]]] += 1
    return counts


def test_counts_and_difference():
    data = ("Ein Text, éà 中文 " * 9).encode()
    assert fp.bucket_counts(data).tolist() == brute_counts(data)
    a, b = fp.digest(data.decode()), fp.digest(data.decode()[:60] + "something else")
    codes = [[int(x[4:], 16) >> 2 * k & 3 for k in range(fp.BUCKETS)] for x in (a, b)]
    want = sum(6 if abs(p - q) == 3 else abs(p - q) for p, q in zip(*codes))
    want += 2 * min(40, abs(int(a[:2], 16) - int(b[:2], 16))) + 2 * sum(abs(int(a[k], 16) - int(b[k], 16)) for k in (2, 3))
    assert fp.difference([a], [b]).tolist() == [want]
    assert fp.likeness([a], [a]).tolist() == [1.0]
    assert 0 <= fp.likeness([a], [b])[0] < 1


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (doc_id, text, *_) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        marks = [fp.digest(t) for t in (text, edited, after)]
        near = [round(float(fp.likeness(marks[:1], [m])[0]), 9) for m in marks[1:]]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], *near))
    return sorted(out, key=str)


def found(frame):
    cols = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted(
        (tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in frame.collect()), key=str
    )


def test_odd_rows(odd_docs, odd_rows, no_docs):
    assert found(fp.fingerprints(odd_docs)) == expected(odd_rows)
    assert fp.fingerprints(no_docs).count() == 0


def test_sparse_ids_over_blocks(spark):
    ids = [0, 1, 511, 512, 5000, 2_097_152, 2_097_153, 10**12, 10**12 + 7, 3 * 10**12]
    rows = [(i, f"text of {i} " * (i % 7 + 1)) for i in ids]
    assert found(fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)
    one = spark.createDataFrame(rows[:1], "doc_id long, text string")
    assert found(fp.fingerprints(one)) == expected(rows[:1])


def test_documents(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = found(fp.fingerprints(documents))
    assert got == expected(rows)
    assert np.mean([r[5] for r in got]) > np.mean([r[6] for r in got])  # half a text is nearer than another one
