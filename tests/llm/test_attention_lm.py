"""Base counts against plain ones, and the attention scorer against its definition."""

import re
import zlib
from collections import Counter
from math import log10

import numpy as np

from folio.llm import attention_lm as lm

WORD = re.compile("[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_base(rows):
    tokens = [(i, [*WORD.findall((t or "").translate(FOLD)), None]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(w for (_, ws), h in zip(tokens, held) if not h for w in ws)
    n, v = counts.total(), len(counts)
    mass = n + 0.5 * (v + 1)
    return [
        (i, h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(log10((counts[w] + 0.5) / mass) for w in ws), 6))
        for (i, ws), h in zip(tokens, held)
    ]


def check(frame):
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = lm.lm_scores(frame).collect()
    cols = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    assert sorted(((*(r[c] for c in cols), round(r["base_score"], 6)) for r in got), key=str) == sorted(plain_base(rows), key=str)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_base(documents, odd_docs, no_docs, monkeypatch):
    check(odd_docs)
    assert lm.lm_scores(no_docs).count() == 0
    monkeypatch.setattr(lm, "HOT_WORDS", 50)  # most words take the joined way
    check(documents)


def tiny():
    rng = np.random.default_rng(1)
    w = {n: rng.standard_normal(s).astype(np.float32) * 0.4 for n, s in lm._SHAPES.items()}
    table = rng.standard_normal((lm.GROUPS, lm.CLASSES)).astype(np.float32)
    share = np.log(rng.uniform(0.01, 0.2, lm.VOCABULARY + 1)).astype(np.float32)
    return w, lm.Tables(rng.integers(0, lm.CLASSES, lm.GROUPS), share, table)


def slow_score(ids, w, t, group):
    """One query at a time, with the context that its block gives it."""
    total = 0.0
    for i in range(len(ids) - 1):
        first = max(0, i // lm.BLOCK * lm.BLOCK - lm.CONTEXT)
        g = group[ids[first : i + 1]]
        s = w["k"][g] @ w["q"][g[-1]] / np.sqrt(lm.DIM) + w["far"][np.arange(len(g))[::-1]]
        a = np.exp(s) / np.exp(s).sum()
        logits = t.table[g[-1]] + a @ w["v"][g] @ w["out"]
        p = np.exp(logits) / np.exp(logits).sum()
        total += np.log(p[t.class_of[group[ids[i + 1]]]]) + t.id_share[ids[i + 1]]
    return total


def test_scorer_equals_definition():
    subwords = lm.Subwords()
    words = [lm.words_of(t) for t in ("", "One", "The quick brown fox " * 30, "a b\tc Straße Ünï 中文 " * 9)]
    subwords.learn(set().union(*words))
    ids = [subwords.ids(w) for w in words]
    w, t = tiny()
    w["v"][lm.GROUPS] = 0
    got = lm.Scorer(w, t, subwords)(ids, step=3)
    assert np.allclose(got, [slow_score(i, w, t, subwords.group) for i in ids], rtol=1e-3)


def test_ids_of_words():
    subwords = lm.Subwords()
    texts = ["The CAT ÄÖ \xa0x a\x85b\t\n", "x\x1cy 中文。 $$ don't", "　"]
    for t in texts:
        words = lm.words_of(t)
        subwords.learn(set(words))
        whole = subwords.encoding.encode_ordinary("".join(" " + w.decode() for w in words))
        assert subwords.ids(words)[1:-1].tolist() == whole
        assert [w.decode() for w in words] == WORD.findall(t.translate(FOLD))


def test_gradient_lowers_the_loss():
    rng = np.random.default_rng(2)
    w, t = tiny()
    grown = {n: np.zeros(s) for n, s in lm._SHAPES.items()}
    keys = rng.integers(0, 40, (64, lm.WIDTH))
    target = np.concatenate([np.full((64, 1), 3), keys[:, lm.CONTEXT : -1] % lm.CLASSES], axis=1)  # the id before

    def loss():
        keep = {n: v.copy() for n, v in w.items()}
        q = keys[:, lm.CONTEXT :]
        s = w["q"][q] @ w["k"][keys].transpose(0, 2, 1) / np.sqrt(lm.DIM) + w["far"][np.maximum(lm._DISTANCE, 0)]
        a = np.exp(np.where(lm._SEEN, s, -1e9))
        o = a / a.sum(axis=2, keepdims=True) @ w["v"][keys]
        z = t.table[q] + o @ w["out"]
        p = np.take_along_axis(z, target[:, :, None], 2)[:, :, 0] - np.log(np.exp(z).sum(axis=2))
        assert all((keep[n] == w[n]).all() for n in w)
        return -p.mean()

    before = loss()
    # The first step follows the gradient: compare with differences for a few parameters.
    step = {n: v.copy() for n, v in w.items()}
    first = {n: np.zeros(s) for n, s in lm._SHAPES.items()}
    lm.train_step(step, first, t, keys, target)
    for name, at in (("out", (3, 5)), ("far", (2,)), ("q", (int(keys[0, 20]), 1)), ("v", (int(keys[0, 3]), 2))):
        kept, h = w[name][at], 1e-2
        w[name][at] = kept + h
        up = loss()
        w[name][at] = kept - h
        down = loss()
        w[name][at] = kept
        assert abs(abs(up - down) / (2 * h) - np.sqrt(first[name][at])) < 2e-4 + 0.05 * abs(up - down) / (2 * h)
    for _ in range(60):
        lm.train_step(w, grown, t, keys, target)
    assert loss() < 0.6 * before


def test_training_helps(documents):
    rows = documents.select("text")
    counts = lm.gather(rows)
    t = lm.tables(counts)
    w = lm.train(rows, t)
    subwords = lm.Subwords()
    texts = [lm.words_of(r["text"]) for r in documents.limit(60).collect()]
    subwords.learn(set().union(*texts))
    ids = [subwords.ids(x) for x in texts]
    plain = {**lm.start_weights(), "out": np.zeros((lm.DIM, lm.CLASSES), np.float32)}
    assert lm.Scorer(w, t, subwords)(ids).sum() > lm.Scorer(plain, t, subwords)(ids).sum()


def test_attention_learns_from_every_training_document(documents, no_docs, monkeypatch):
    seen, real = [], lm.train
    monkeypatch.setattr(lm, "train", lambda texts, t: (seen.append(texts.count()), real(texts, t))[1])
    rows = lm.lm_scores(documents.limit(40)).collect()
    assert seen == [sum(not r["held_out"] for r in rows)]
    t = lm.Tables(np.zeros(lm.GROUPS, np.int64), np.zeros(lm.VOCABULARY + 1), np.zeros((lm.GROUPS, lm.CLASSES)))
    assert not real(no_docs.select("text"), t)["out"].any()  # nothing learned enters no score
