"""Ranked search against plain scoring of every document, and the hierarchies' bounds."""

import math
import random
import re

import numpy as np
import pytest

from folio.llm import dual_tree as D

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return TERM.findall(text)


def plain_search(items, docs, k):
    """(item row number, rank) -> (doc_id, score), by scoring all pairs."""
    held = [(i, plain_terms(t)) for i, t in docs]
    held = [(i, t) for i, t in held if t]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    df = {}
    for _, ts in held:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item_id, text in items:
        wanted = [t for t in sorted(set(plain_terms(text))) if t in df]
        scored = []
        for doc_id, ts in held:
            m = 50 + (50 * len(ts) * n_docs) // length
            score = 0
            for t in wanted:
                tf = ts.count(t)
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return out


def _key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def _found(spark, items, docs, k):
    got = D.search(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), k=k)
    return _key([tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(300)], k=n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(700)]
    docs += [(1000 + i, docs[3][1]) for i in range(80)]  # a group of copies: equal scores beyond k
    items = [(i, text(rng.randint(1, 12))) for i in range(45)] + [(99, docs[3][1])]
    return items, docs


def test_equals_scoring_every_pair(spark, corpus):
    items, docs = corpus
    for k in (1, 7, 50):
        assert _found(spark, items, docs, k) == _key(plain_search(items, docs, k))


def test_layout_and_blocks_change_nothing(spark, corpus, monkeypatch):
    items, docs = corpus
    want = _key(plain_search(items, docs, 5))
    monkeypatch.setattr(D, "BLOCK_ITEMS", 10)
    assert _found(spark, items, docs, 5) == want
    got = D.search(spark.createDataFrame(items, "item_id long, text string").repartition(3),
                   spark.createDataFrame(docs, "doc_id long, text string").repartition(11), k=5)
    assert _key([tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()]) == want


def test_nulls_empty_texts_ties_repeats_and_long_texts(spark, odd_rows):
    docs = [(r[0], r[1]) for r in odd_rows] + [(8, "Straße STRASSE 123 a_b"), (9, "straße a b"), (9, "straße a b"), (None, "straße")]
    items = [(1, "STRASSE straße 123"), (1, "STRASSE straße 123"), (2, None), (3, "…—"), (None, "house river wort5"), (4, "nowhere"), (5, "a a a b")]
    for k in (2, 50):
        assert _found(spark, items, docs, k) == _key(plain_search(items, docs, k))


def test_empty_tables_and_clashing_columns(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "house garden", 5)], "item_id long, text string, score int")
    none = items.where("item_id < 0")
    assert D.search(none, odd_docs).count() == 0 and D.search(items, no_docs).count() == 0
    assert D.search(items, odd_docs).columns == ["item_id", "rank", "doc_id", "score"]
    by_name = D.search(items.withColumnRenamed("text", "q"), odd_docs.selectExpr("cast(doc_id as string) doc_id", "text q"), text="q")
    assert by_name.schema["doc_id"].dataType.simpleString() == "string" and by_name.count() > 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    n, width = 4000, 200
    owner = np.repeat(np.arange(n), 6)
    topic = rng.integers(0, 20, n)
    term = (topic[owner] * 10 + rng.integers(0, 10, len(owner))) % width
    owner, term = np.unique(np.stack([owner, term]), axis=1)
    value = rng.integers(1, 1000, len(owner))
    tree = D.Tree(owner, term, value, n, width, D.LEAF, D.FANOUT, value)
    assert sorted(tree.order) == list(range(n)) and tree.levels[-1].n == 1
    query = rng.integers(0, 50, width)
    for level in range(1, len(tree.levels)):
        nodes = np.arange(tree.levels[level].n)
        bounds = tree.levels[level].dots(nodes, query)
        for node in nodes[:50]:
            below = tree.children(level, np.array([node]))
            assert bounds[node] >= tree.levels[level - 1].dots(below, query).max()
    items = D.Tree(np.repeat(np.arange(40), 5), np.concatenate([np.arange(5) + 10 * (i % 20) for i in range(40)]),
                   np.full(200, 7), 40, width, 4, 4, np.full(200, 7))
    search = D.Search(items, tree, width, np.zeros(40, np.int64), np.arange(n), 10)
    assert search.scored < 40 * n / 5  # whole nodes are never scored
    dense = np.zeros((n, width), np.int64)
    dense[owner, term] = value
    for place, (scores, rows) in search.best.items():
        q = np.zeros(width, np.int64)
        items.levels[0].spread(place, q)
        full = (dense @ q)[tree.order]
        order = np.lexsort((np.arange(n), -full))[:10]
        assert list(scores) == list(full[order]) and list(rows) == list(order)
