"""Every id lies in exactly one piece, sequences are gapless, and little is padded."""

import random

import numpy as np
from tokenizers import Tokenizer

from folio.llm import packing


def test_ids_equal_the_tokenizer():
    encoder = packing.ByteIds()
    parts = [" ", "  ", "a", "the", "\n", "\t", "é", "ﬁ", "　", "<|endoftext|>", "中", "b ", "\x00", "😀", "12", "'s", "\x1c", "\x85", "\xa0", "!?"]
    random.seed(6)
    texts = ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(3000)]
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]


def check(frame):
    rows = [(r["doc_id"], r["text"] or "") for r in frame.collect()]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted(([i, [*tokenizer.encode(t, add_special_tokens=False).ids, 1]] for i, t in rows), key=str)
    pieces = [r.asDict() for r in packing.pack(frame).collect()]
    sequences = {}
    for p in pieces:
        p["ids"] = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(p["ids"]) == p["length"] > 0
        sequences.setdefault(p["sequence_id"], []).append(p)
    padded = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.WINDOW
        padded += 0 if at & (at - 1) == 0 else packing.WINDOW - at
    assert padded == 0
    docs, got = {}, []
    for p in sorted(pieces, key=lambda p: (str(p["doc_id"]), p["doc_tokens"], p["start"])):
        docs.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
    for (doc_id, tokens), parts in docs.items():
        copies = sum(p["length"] for p in parts) // tokens
        for k in range(copies):  # repeated rows are cut differently: put each together from its own pieces
            ids, left = [], parts
            while len(ids) < tokens:
                p = next(p for p in left if p["start"] == len(ids) and not p.get("used"))
                p["used"] = True
                ids += p["ids"]
            got.append([doc_id, ids])
    assert sorted(got, key=str) == want


def test_documents(documents):
    check(documents)


def test_odd_rows(odd_docs, no_docs, spark):
    check(odd_docs)
    assert packing.pack(no_docs).count() == 0


def test_sum_of_squares_rule():
    packer = packing.SumOfSquares(window=10, max_open=100)
    random.seed(2)
    level = [0] * 11
    for n in range(400):
        size = random.randint(1, 9)
        options = [(h, level[:]) for h in range(10) if (h == 0 or level[h]) and h + size <= 10]
        sums = []
        for h, after in options:
            if h:
                after[h] -= 1
            if h + size < 10:
                after[h + size] += 1
            sums.append((sum(x * x for x in after[1:10]), -h, after))
        level = min(sums)[2]
        packer.add(n, b"\0\0\0\0" * size)
        assert packer.level[1:10].tolist() == level[1:10]
    packer = packing.SumOfSquares(window=10, max_open=8)
    for n in range(100):
        packer.add(n, b"\0\0\0\0" * 6)  # two never fit: windows are cut when too many are open
        assert packer.level.sum() <= 8
    packer.close()
    assert sum(len(i) // 4 for s in packer.done for *_, i in s) == 600
