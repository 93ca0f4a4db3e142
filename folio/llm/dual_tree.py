"""Ranked lexical search: every document ranked for each item, pruned by a pair of hierarchies.

A document's score for an item is the sum, over the item's terms, of a term's weight times the
term's impact in the document, in whole numbers. Weights and impacts are never negative, so the
sum over coordinate maxima of a group of items and of a group of documents bounds every score
between the two groups.

1. One pass over the texts writes each document's length and its frequencies of the items' terms;
   the number of documents, their length and the document frequencies are sums over that table.
2. The items' hierarchy is built once, the documents' hierarchy per Arrow batch inside the task:
   rows with the same strongest terms lie side by side, ``LEAF`` of them are a leaf, ``FANOUT`` nodes
   are a node; a node holds the maximum of each coordinate below it.
3. Both are descended together. A pair of nodes whose bound lies below the weakest k-th score
   among the node's items is pruned with all that is below; a tie is not, so the result is exact.
   Documents of a leaf are scored best bound first, which raises the k-th scores early.
4. A part of the documents, fixed by a hash, is searched first. Its k-th scores are the floor from which
   the search of all others starts; an item's floor is one number.
5. What tasks return, at most k rows per item and batch, is ranked in one window per item (Spark
   drops all but the first k of a partition before the shuffle).

Items are taken in blocks of bounded size, each block against all documents; a task holds one
block and one Arrow batch of the narrow table.

Defined results: a null or empty text has no term, so such a document is not counted and such an item
has no rows; equal scores are ranked by ascending id, null last; repeated documents are ranked one after
the other; a repeated item row has its rows once per repetition; an empty table on either side gives no
rows; other columns are not read, so no name can clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import narrow, slices, stored

TOP = 50
LEAF = 32
FANOUT = 8
#: Items and characters of items in a block.
BLOCK_ITEMS = 4096
BLOCK_CHARS = 4_000_000
#: One part in so many is searched first.
FIRST_PART = 16

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: ASCII letters in lower case, digits and bytes above 127 stay, the rest separates terms.
_TERMS = bytes(c if c > 127 or c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_TERMS).split()


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df.astype(np.float64) + 1))).astype(np.int64)


def impact(tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    m = 50 + (50 * n * n_docs) // length
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


# ---------------------------------------------------------------- hierarchies


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All indexes of several ranges, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Level:
    """Sparse rows: the coordinate maxima of one level's nodes."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, value: np.ndarray, n: int):
        """Entries sorted by owner; every node has at least one."""
        self.term, self.value, self.n = term, value, n
        self.count = np.bincount(owner, minlength=n)
        self.start = np.cumsum(self.count) - self.count

    def above(self, width: int, fan: int) -> Level:
        owner = np.repeat(np.arange(self.n), self.count) // fan
        key = owner * width + self.term
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return Level(key[first] // width, key[first] % width, np.maximum.reduceat(self.value[order], first), -(-self.n // fan))

    def dots(self, nodes: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """The product of each of ``nodes`` with a dense vector."""
        counts = self.count[nodes]
        at = _ranges(self.start[nodes], counts)
        return np.add.reduceat(vector[self.term[at]] * self.value[at], np.cumsum(counts) - counts)

    def spread(self, node: int, vector: np.ndarray) -> np.ndarray:
        """Write a node's values into ``vector``; returns the places to clear."""
        at = slice(self.start[node], self.start[node] + self.count[node])
        vector[self.term[at]] = self.value[at]
        return self.term[at]


class Tree:
    """A hierarchy over sparse rows, level 0 being the rows in the order that puts similar ones together."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, width: int, leaf: int, fan: int, strength: np.ndarray):
        by = np.lexsort((-strength, owner))
        counts = np.bincount(owner, minlength=n)
        start = np.cumsum(counts) - counts
        keys = [np.where(counts > k, term[by[np.minimum(start + k, len(by) - 1)]], -1) for k in (2, 1, 0)]
        self.order = np.lexsort(keys)  # row numbers by strongest, second and third term
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        entry = np.lexsort((term, place[owner]))
        self.levels = [Level(place[owner][entry], term[entry], value[entry], n)]
        self.fans = [1]
        while self.levels[-1].n > 1:
            fan_now = leaf if len(self.levels) == 1 else fan
            self.levels.append(self.levels[-1].above(width, fan_now))
            self.fans.append(fan_now)

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        fan = self.fans[level]
        below = (nodes[:, None] * fan + np.arange(fan)).ravel()
        return below[below < self.levels[level - 1].n]


class Search:
    """The k best rows of a document tree for every item of an item tree, by descending both."""

    def __init__(self, items: Tree, docs: Tree, width: int, floors: np.ndarray, tie: np.ndarray, k: int):
        self.items, self.docs, self.k, self.tie = items, docs, k, tie
        self.kth = floors  # per item place; rises while the search runs
        self.best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.vector = np.zeros(width, np.int64)
        self.scored = 0
        top = len(docs.levels) - 1
        self._visit(len(items.levels) - 1, 0, top, np.arange(docs.levels[top].n))

    def _visit(self, at: int, node: int, level: int, nodes: np.ndarray) -> None:
        span = math.prod(self.items.fans[1 : at + 1])
        weakest = max(int(self.kth[node * span : (node + 1) * span].min()), 1)
        used = self.items.levels[at].spread(node, self.vector)
        bounds = self.docs.levels[level].dots(nodes, self.vector)
        self.vector[used] = 0
        keep = bounds >= weakest
        nodes, bounds = nodes[keep], bounds[keep]
        if not len(nodes):
            return
        if at == 0 and level <= 1:
            self._score(node, level, nodes[np.argsort(-bounds, kind="stable")])
            return
        below = self.docs.children(level, nodes) if level > 1 else nodes
        children = [node] if at == 0 else self.items.children(at, np.array([node]))
        for child in children:
            self._visit(max(at - 1, 0), int(child), max(level - 1, min(level, 1)), below)

    def _score(self, item: int, level: int, nodes: np.ndarray) -> None:
        """Score the documents below ``nodes`` (best bound first) for one item."""
        used = self.items.levels[0].spread(item, self.vector)
        step = 4
        while len(nodes):
            now, nodes = nodes[:step], nodes[step:]
            rows = self.docs.children(1, now) if level == 1 else now
            scores = self.docs.levels[0].dots(rows, self.vector)
            self.scored += len(rows)
            enough = scores >= max(int(self.kth[item]), 1)
            self._keep(item, scores[enough], rows[enough])
            if len(nodes) and level == 1:
                nodes = nodes[self.docs.levels[1].dots(nodes, self.vector) >= max(int(self.kth[item]), 1)]
            step *= 4
        self.vector[used] = 0

    def _keep(self, item: int, scores: np.ndarray, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if item in self.best:
            scores, rows = np.r_[self.best[item][0], scores], np.r_[self.best[item][1], rows]
        order = np.lexsort((self.tie[rows], -scores))[: self.k]
        self.best[item] = scores[order], rows[order]
        if len(order) == self.k:
            self.kth[item] = max(self.kth[item], scores[order[-1]])


# ---------------------------------------------------------------- Spark


def _vectors(vocabulary: list[bytes]) -> Callable:
    """Texts -> length and frequencies of the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_binary())
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in slices(texts):
                found = [terms(t) for t in texts[part]]
                n = np.array([len(f) for f in found], np.int64)
                flat = pa.array([t for f in found for t in f], pa.large_binary())
                at = pc.index_in(flat, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                key = (np.repeat(np.arange(len(n)), n) * len(vocabulary) + at)[at >= 0]
                key, tf = np.unique(key, return_counts=True)
                row, term = key // max(len(vocabulary), 1), (key % max(len(vocabulary), 1)).astype(np.int32)
                ends = np.searchsorted(row, np.arange(len(n)), "right")
                starts = np.r_[0, ends[:-1]] if len(n) else ends
                tf = np.minimum(tf, 2**31 - 1).astype(np.int32)
                columns = [
                    ids.slice(part.start, len(n)),
                    pa.array(n),
                    pa.array([term[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    pa.array([tf[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tfs"])

    return run


def _held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Document frequencies inside one task."""
    held = np.zeros(0, np.int64)
    for batch in batches:
        count = np.bincount(np.frombuffer(b"".join(batch["terms"]), np.int32))
        held = np.pad(held, (0, max(0, len(count) - len(held))))
        held[: len(count)] += count
    at = np.flatnonzero(held)
    yield pd.DataFrame({"term": at, "df": held[at]})


def _item_tree(item_terms: list[np.ndarray], weights: np.ndarray) -> tuple[Tree, np.ndarray] | None:
    """The hierarchy of the items that have a term, and their numbers in the block."""
    with_terms = np.array([i for i, t in enumerate(item_terms) if len(t)], np.int64)
    if not len(with_terms):
        return None
    kept = [item_terms[i] for i in with_terms]
    owner = np.repeat(np.arange(len(kept)), [len(t) for t in kept])
    term = np.concatenate(kept)
    tree = Tree(owner, term, weights[term], len(kept), len(weights), 4, 4, weights[term])
    return tree, with_terms[tree.order]


def _searcher(item_terms: list[np.ndarray], weights: np.ndarray, floors: np.ndarray, n_docs: int, length: int, k: int):
    """Arrow batches of document vectors -> the best documents per item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _item_tree(item_terms, weights)
        if built is None:
            return
        items, numbers = built
        kth = floors[numbers].copy()
        width = len(weights)
        for batch in batches:
            count = np.array([len(b) // 4 for b in batch.column(2).to_pylist()], np.int64)
            rows = np.flatnonzero(count)  # documents with a term of an item
            if not len(rows):
                continue
            term = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32).astype(np.int64)
            tf = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int32).astype(np.int64)
            owner = np.repeat(np.arange(len(rows)), count[rows])
            n = batch.column(1).to_numpy()[rows]
            value = impact(tf, n[owner], n_docs, length)
            docs = Tree(owner, term, value, len(rows), width, LEAF, FANOUT, weights[term] * value)
            by_id = pc.sort_indices(batch.column(0), sort_keys=[("", "ascending")], null_placement="at_end").to_numpy()
            tie = np.empty(len(by_id), np.int64)
            tie[by_id] = np.arange(len(by_id))
            search = Search(items, docs, width, kth, tie[rows][docs.order], k)
            found = [(numbers[i], s, docs.order[r]) for i, (s, r) in search.best.items()]
            if not found:
                continue
            item = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
            taken = batch.column(0).take(pa.array(rows[np.concatenate([f[2] for f in found])]))
            columns = [pa.array(item, pa.int64()), taken, pa.array(np.concatenate([f[1] for f in found]), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, texts: list[bytes], k: int) -> DataFrame:
    """``item`` (number in the block), ``rank``, ``doc_id``, ``score`` for one block of items."""
    spark = docs.sparkSession
    of_item = [terms(t) for t in texts]
    vocabulary = sorted({t for ts in of_item for t in ts})
    number = {t: i for i, t in enumerate(vocabulary)}
    item_terms = [np.array(sorted({number[t] for t in ts}), np.int64) for ts in of_item]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    vectors = stored(docs.mapInArrow(_vectors(vocabulary), f"doc_id {id_type}, n long, terms binary, tfs binary"), "vectors")
    n_docs, length = vectors.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    held = vectors.select("terms").mapInPandas(_held, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for term, count in held.collect():  # at most one row per term of the block
        df[term] = count
    weights = weight(n_docs, df)
    schema = f"item long, doc_id {id_type}, score long"
    first = F.pmod(F.xxhash64("terms", "n"), F.lit(FIRST_PART)) == 0

    def search(part: DataFrame, floors: np.ndarray) -> DataFrame:
        return part.mapInArrow(_searcher(item_terms, weights, floors, n_docs, length, k), schema)

    floors = np.zeros(len(texts), np.int64)
    ahead = stored(_best(search(vectors.where(first), floors), k), "ahead")
    for item, score in ahead.where(F.col("rank") == k).select("item", "score").collect():  # one number per item
        floors[item] = score
    rest = search(vectors.where(~first), floors)
    return _best(ahead.select("item", "doc_id", "score").unionByName(rest), k)


def search(
    items: DataFrame, docs: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", k: int = TOP
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: each item's ``k`` best documents."""
    spark = docs.sparkSession
    text_of = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    numbered = items.select(F.col(item_id).alias("item_id"), text_of).withColumn("key", F.monotonically_increasing_id())
    numbered = stored(numbered, "items")
    count, chars = numbered.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    of_docs = narrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id")
    of_docs = of_docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    results = []
    for block in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).select("key", "text").collect()
        found = _search_block(of_docs, [bytes(r["text"]) for r in rows], k)
        keys = spark.createDataFrame([(i, r["key"]) for i, r in enumerate(rows)], "item long, key long")
        results.append(found.join(keys, "item").select("key", "rank", "doc_id", "score"))
    found = reduce(DataFrame.unionByName, results)
    return found.join(numbered.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")
