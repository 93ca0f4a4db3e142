"""Classes against all pairs on small tables, sampling, and components."""

import random
from collections import Counter
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from folio.llm import neardup as nd


def weights(text, df, n):
    words = (text or "").encode().split()
    grams = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else {}
    return {g: (1 + log(c)) * nd.saturated_idf(df[g], n) for g, c in grams.items()}


def brute_classes(texts):
    """Components over all pairs with weighted Jaccard similarity of 0.8 or more."""
    grams = []
    for t in texts:
        words = (t or "").encode().split()
        grams.append(set(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else set())
    df = Counter(g for s in grams for g in s)
    w = [weights(t, df, len(texts)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    of = {}
    for i, s in enumerate(grams):
        for g in s:
            of.setdefault(g, []).append(i)
    pairs = {(i, j) for at in of.values() for i in at for j in at if i < j}
    pairs |= {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (texts[i] or "") == (texts[j] or "")}
    linked = set()
    for i, j in pairs:
        same = (texts[i] or "") == (texts[j] or "")
        both = sum(min(w[i][g], w[j][g]) for g in w[i].keys() & w[j].keys())
        total = sum(w[i].values()) + sum(w[j].values()) - both
        if same or total and both / total >= nd.SIMILARITY:
            linked.add((i, j))
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], linked


def families(seed=1, groups=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for g in range(groups):
        base = rng.choices(words, k=rng.randint(30, 400))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = base[:]
            for _ in range(max(1, len(copy) // 120)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
        if g % 4 == 0:
            texts += [texts[-1]] * 3
    passage = " ".join(rng.choices(words, k=60))
    texts += [" ".join([*rng.choices(words, k=80), passage, *rng.choices(words, k=80)]) for _ in range(25)]
    return texts


def test_classes_equal_all_pairs(spark):
    texts = families()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, linked = brute_classes(texts)
    got = {r["doc_id"]: r for r in nd.classes(frame).collect()}
    assert [got[i]["class_id"] for i in range(len(texts))] == want
    size = Counter(want)
    assert all(got[i]["class_size"] == size[want[i]] for i in got)
    # A text that resembles a different text has a link.
    apart = {i for p in linked for i in p if texts[p[0]] != texts[p[1]]}
    assert {i for i in got if got[i]["n_links"]} <= apart


def test_documents_recall(documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    want, _ = brute_classes([t for _, t in rows])
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(documents).collect()}
    assert [got[i] for i, _ in rows] == [rows[k][0] for k in want]


def test_large_group_of_near_copies(spark):
    """Half of the table is one group whose members each differ from the base in one word."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(300):
        copy = base[:]
        copy[i % 200] = f"other{i}"
        texts.append(" ".join(copy))
    texts += [" ".join(rng.choices([f"x{i}" for i in range(3000)], k=100)) for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter(r["class_id"] for r in nd.classes(frame).collect())
    assert got[0] == 300 and len(got) == 301


def test_copies_that_resemble_only_their_original(spark):
    """Copies with three other words each resemble the original, but not each other."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(100):
        copy = base[:]
        for at in rng.sample(range(10, 190, 9), 3):
            copy[at] = f"other{i}.{at}"
        texts.append(" ".join(copy))
    texts.insert(50, " ".join(base))
    texts += [" ".join(rng.choices([f"x{i}" for i in range(3000)], k=100)) for _ in range(100)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _ = brute_classes(texts)
    assert Counter(want)[0] > 60
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(frame).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_pairs_under_a_shared_passage(spark):
    """Most of each text is one passage, so its buckets are led by texts that it does not resemble."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    passage = rng.choices(words, k=165)
    texts = []
    for _ in range(60):
        own = rng.choices(words, k=35)
        texts.append(" ".join(passage + own))
        own[rng.randrange(35)] = "other"
        texts.append(" ".join(passage + own))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, _ = brute_classes(texts)
    assert len(set(want)) == 60
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(frame).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_prefixes_of_alike_texts_meet():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 50, nd.CELLS)
    for _ in range(200):
        shingles = np.sort(rng.integers(0, 2**63, 120).astype(np.uint64))
        weights = rng.uniform(0.75, 3, 120)
        n = int(rng.integers(1, 30))
        a, b = (shingles[n:], weights[n:]), (shingles[:-3], weights[:-3] * rng.uniform(0.9, 1.0, 117))
        threshold = nd.similarity(a, b)
        (first, left), (other, behind) = [nd.prefix(*x, counts, threshold) for x in (a, b)]
        both, i, j = np.intersect1d(first, other, return_indices=True)
        assert len(both) > 0
        # From the first shared shingle on, both have the weight that they must have in common.
        common = (a[1].sum() + b[1].sum()) * threshold / (1 + threshold)
        assert np.minimum(left[i], behind[j]).max() >= common * (1 - 1e-9)
        assert abs(left[0] - a[1].sum()) < 1e-9


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = sorted(((r["doc_id"], r["class_id"], r["class_size"]) for r in nd.classes(odd_docs).collect()), key=str)
    assert got == sorted([(1, 1, 2), (2, 1, 2), (None, 4, 4), (3, 3, 1), (4, 4, 4), (4, 4, 4), (5, 5, 1), (6, 6, 1), (7, 4, 4)], key=str)
    kept = nd.keep_one(odd_docs)
    assert kept.schema == odd_docs.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6]
    assert nd.classes(no_docs).count() == 0 and nd.keep_one(no_docs).count() == 0


def test_sampling_probability_is_the_similarity():
    """Single samples collide as often as the weighted Jaccard similarity says."""
    rng = np.random.default_rng(3)
    shingles = rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = np.sort(shingles[:45]), np.sort(shingles[15:])
    wa, wb = rng.uniform(0.5, 3, 45), rng.uniform(0.5, 3, 45)
    sim = nd.similarity((a, wa), (b, wb))
    sampler = nd.Sampler(bands=3000, rows=1)
    ka, kb = (sampler.keys(s, w, np.array([0]))[0] for s, w in ((a, wa), (b, wb)))
    assert abs((ka == kb).mean() - sim) < 0.03


def test_components(spark):
    edges = [("a", "b"), ("b", "c"), ("x", "y"), ("d", "c"), *((f"p{i:03}", f"p{i + 1:03}") for i in range(60))]
    got = {r["node"]: r["root"] for r in nd.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[n] for n in "bcd"} == {"a"} and got["y"] == "x"
    assert {got[f"p{i:03}"] for i in range(1, 61)} == {"p000"}


def test_buckets_of_the_same_nodes_are_one(spark):
    rows = [(n, k, 1.0, 10.0 * n + k) for k in (1, 2) for n in (1, 2, 3)] + [(n, 3, 1.0, 5.0) for n in (1, 2)] + [(9, 4, 1.0, 1.0)]
    got = nd._different(spark.createDataFrame(rows, "node long, key long, weight double, left double"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1.0, 12.0), (1, 3, 1.0, 5.0), (2, 1, 1.0, 22.0), (2, 3, 1.0, 5.0), (3, 1, 1.0, 32.0)]


def test_stars_are_found_without_a_further_step(spark, monkeypatch):
    written, real = [], nd.stored
    monkeypatch.setattr(nd, "stored", lambda df, name, **options: (written.append(name), real(df, name, **options))[1])
    stars = spark.createDataFrame([(1, 2), (3, 1), (1, 9), (4, 7), (4, 7)], "a long, b long")
    assert {r["node"]: r["root"] for r in nd.components(stars).collect()} == {2: 1, 3: 1, 9: 1, 7: 4}
    assert len(written) == 1  # the edges alone
    written.clear()
    path = spark.createDataFrame([(1, 3), (2, 3)], "a long, b long")
    assert {r["node"]: r["root"] for r in nd.components(path).collect()} == {2: 1, 3: 1}
    assert len(written) == 2  # and the two steps of one round


def test_a_leader_of_many_pairs_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(nd, "SALT_ROWS", 2)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join([*words, *extra]) for extra in ([], ["a"], ["b"], ["c"], ["d", "e"], ["f"])]
    held = [len(nd.Shingler().of(t)[0]) for t in texts]
    rows = [(i, t, nd.planes(np.ones(n, np.uint32))) for i, (t, n) in enumerate(zip(texts, held))]
    frame = spark.createDataFrame(rows, "node long, text string, dfs binary")
    pairs = [(0, i) for i in range(1, 6)] + [(4, 5)]  # one leader of three shares, and one of one
    got = nd._verified(spark.createDataFrame(pairs, "leader long, node long"), frame, 6).collect()
    assert sorted((r["leader"], r["node"]) for r in got) == pairs
    assert all(0.8 < r["sim"] < 1 for r in got)


def test_merged_classes_are_the_components_of_all_edges(spark):
    rng = random.Random(2)
    first = [tuple(sorted(rng.sample(range(200), 2))) for _ in range(60)]
    more = [tuple(sorted(rng.sample(range(200), 2))) for _ in range(60)]
    frame = lambda edges: spark.createDataFrame(edges, "a long, b long")
    got = nd.merged(nd.components(frame(first)), frame(more))
    want = nd.components(frame(first + more))
    rows = lambda df: sorted((r["node"], r["root"]) for r in df.collect())
    assert rows(got) == rows(want)
    assert rows(nd.merged(nd.components(frame(first)), frame(first[:3]))) == rows(nd.components(frame(first)))


def test_idf_falls_from_the_first_document_on():
    values = nd.idf(np.arange(1, 1001), 1000)
    assert (np.diff(values) < 0).all() and values[-1] == 1
    weigh = nd.Weights(1000)
    assert weigh(np.array([1]), np.array([1]))[0] == 1 and weigh(np.array([1]), np.array([2]))[0] < 1


def test_document_frequencies_are_exact(spark, monkeypatch):
    """Blocks of four documents and many parts: each shingle's number of documents, copies included."""
    monkeypatch.setattr(nd, "BLOCK_BITS", 2)
    monkeypatch.setattr(nd, "PART_BYTES", 500)
    texts = [*families(seed=3, groups=6), "", "a b", "a b", "a a a a a a a"]
    rows = spark.createDataFrame([(i >> 2, i, t) for i, t in enumerate(texts)], "block long, row long, text string")
    size = sum(len(t) for t in texts)
    got = {r["row"]: r for r in nd._sketched(rows, len(texts), size, nd.BANDS, nd.ROWS).collect()}
    shingler = nd.Shingler()
    held = [shingler.of(t)[0].tolist() for t in texts]
    df = Counter(g for s in held for g in s)
    assert max(df.values()) > 20 and len(got) == len(texts)
    for i, shingles in enumerate(held):
        assert nd.numbers(got[i]["dfs"], np.uint32).tolist() == [df[g] for g in shingles]
        assert (got[i]["bands"] is None) == (not shingles)
    weigh, sampler = nd.Weights(len(texts)), nd.Sampler()
    for i in (0, 5, 20):
        shingles, counts = shingler.of(texts[i])
        weights = weigh(counts, np.array([df[int(g)] for g in shingles]))
        assert got[i]["bands"] == sampler.keys(shingles, weights, np.array([0]))[0].astype(np.int64).tolist()


def test_numbers_of_planes():
    for values in (np.arange(300, dtype=np.uint32) * 70_001, np.array([2**63 + 5, 7], np.uint64), np.zeros(0, np.uint64)):
        assert nd.numbers(nd.planes(values), values.dtype).tolist() == values.tolist()


def test_shingles_of_many_texts_are_the_runs_of_words():
    """All texts at a time, in slices: as many distinct runs, counted as often, as by splitting each text."""
    rng = random.Random(9)
    words = ["a", "b\0", "b", "é漢", "c\x1cd", "12345678", "123456789", "x" * 33, "　", "😀"]
    texts = ["", " \t", "a", "a b c d", "a b c d e", " a\x0bb\x0cc\nd\re f ", "a " * 40, "w" * 5000]
    texts += [rng.choice([" ", "\n "]).join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(200)]
    shingler, named = nd.Shingler(), {}
    shingler.CHARS = 700
    shingles, counts, sizes = shingler.all(texts)
    assert sizes.sum() == len(shingles) == len(counts)
    for text, run in zip(texts, nd._runs(sizes)):
        held = text.encode().split()
        want = Counter(tuple(held[i : i + 5]) for i in range(max(1, len(held) - 4))) if held else {}
        assert sorted(counts[run].tolist()) == sorted(want.values()) and (np.diff(shingles[run].astype(object)) > 0).all()
        named.setdefault(tuple(shingles[run].tolist()), set()).add(tuple(sorted(want)))
        assert all((a == b).all() for a, b in zip(shingler.of(text), (shingles[run], counts[run])))
    assert all(len(v) == 1 for v in named.values())
    every = {tuple(t.encode().split()[i : i + 5]) for t in texts if t.split() for i in range(max(1, len(t.encode().split()) - 4))}
    assert len(np.unique(shingles)) == len(every - {()})


def test_runs_of_the_sampler_change_no_key(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 40, 60)
    shingles, weights = rng.integers(0, 2**63, sizes.sum()).astype(np.uint64), rng.choice([1.0, 0.7, 1.9], sizes.sum())
    starts = np.cumsum(sizes) - sizes
    whole = nd.Sampler().keys(shingles, weights, starts)
    monkeypatch.setattr(nd.Sampler, "RUN", 16)
    assert (nd.Sampler().keys(shingles, weights, starts) == whole).all() and whole.shape == (60, nd.BANDS)


def test_texts_of_a_block_are_bundled():
    batch = pd.DataFrame({"block": [1, 0, 1, 1], "row": [9, 2, 8, 7], "text": ["é a" * 50, "", "", "😀"]})
    bundles = pd.concat(nd._bundles(iter([batch, batch[:0], batch[1:2]])))
    rows, texts = nd._opened(bundles[bundles["block"] == 1])
    assert (rows.tolist(), texts) == ([9, 8, 7], ["é a" * 50, "", "😀"])
    assert nd._opened(bundles[bundles["block"] == 0])[1] == ["", ""]


def test_a_pair_is_compared_in_the_first_bucket_that_it_shares(spark, monkeypatch):
    """Members of 30 common buckets: one row for a pair, not 30; buckets beyond the listed ones lose no pair."""
    monkeypatch.setattr(nd, "HOMES", 4)
    rows = [(n, 1000 - k, 40.0, 40.0 - k) for n in (1, 2, 3) for k in range(n, 30)] + [(4, 5, 40.0, 9.0), (5, 5, 40.0, 9.0)]
    members = nd._homed(spark.createDataFrame(rows, "node long, key long, weight double, left double"))
    other = members.select("key", *[F.col(c).alias(f"_{c}") for c in ("node", "homes")])
    pairs = members.join(other, "key").where((F.col("node") < F.col("_node")) & nd._at_home())
    assert sorted((r["node"], r["_node"], r["key"]) for r in pairs.collect()) == [(1, 2, 998), (1, 3, 997), (2, 3, 997), (4, 5, 5)]


def test_steps_of_sorted_numbers():
    held = np.array([3, 2**40, 2**63 + 1, 2**64 - 1], np.uint64)
    assert np.cumsum(nd.steps(held), dtype=np.uint64).tolist() == held.tolist() and not len(nd.steps(held[:0]))
