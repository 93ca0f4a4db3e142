"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words. A shingle weighs ``(1 + ln tf) * idf`` with ``idf = 1 + ln(1 + ln(n / df))``,
df being the number of the n documents (copies included) that hold it: the IDF is damped like the term frequency, so that
a large group of copies still counts as copies, but it falls with every further document, from the first one on. Weights
are divided by that of a shingle of one document, which changes no similarity.

The document frequencies are exact and no table of them is held anywhere. Documents are taken in blocks; a block's distinct
shingles go to parts of the hash range, each part adds up its blocks' counts and answers every block with the frequencies of
its shingles, in their order. A text keeps its frequencies beside it.

1. Each text gets ``bands * rows`` consistent samples (element and quantised weight, chosen with
   probability equal to the weighted Jaccard similarity of two texts) and one key per band.
2. Exact copies collapse to one node. Nodes that share a band key are compared with that bucket's
   leader, the node with the smallest hash, so that the buckets of a group mostly share their
   leader and the pair is verified once. Buckets whose nodes are not all in one class by then are
   open: each pair of two classes in them is still to be decided. That is done without loss by
   prefixes: shingles are put in one order, rare ones first, and a node is a member of the buckets
   of its first shingles, up to the one after which less than the threshold of its weight is left.
   Two texts that resemble each other share such a shingle, whatever the order is, and the weight that they
   have in common lies behind the first one that they share, which most other pairs cannot meet. Of buckets with the
   same nodes one is kept. A bucket's members are compared with the one of them that has the most
   links, unless they are of its class or share an earlier bucket with it; classes are merged, the leader leaves the bucket, and the next turn
   takes the next one (after some turns several), until what is left in a bucket is one class. So each
   pair of two classes in a bucket is compared, and a family costs one comparison a member.
3. Pairs are verified by the exact weighted Jaccard similarity of their whole texts. A leader's
   text is dealt out by salt when many texts are compared with it.
4. Verified links give classes by alternating large-star and small-star steps, until every class is a
   star; two steps are written to the shared folder at a time. A class is named by its smallest document id.

Defined results: a text of fewer than five words has one shingle, all its words; a text without
words (null, empty, white space) resembles only exact copies of itself; a null id counts as
larger than any other (a class of null ids has the class id null); repeated rows are copies; texts
are read whole; an empty table gives no rows; other columns are ignored by :func:`classes` and
returned by :func:`keep_one`.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from ._common import discard, mix64, packed, slices, stored, unpacked

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
#: Documents of a block are 2 to the power of this, and bytes of all texts for each part of the hash range.
BLOCK_BITS, PART_BYTES = 9, 24_000_000
#: Bytes of texts of a task that takes whole blocks.
TASK_BYTES = 16_000_000
#: Texts compared with one leader in one piece.
SALT_ROWS = 500
#: Turns in which an open bucket's members are compared with one of them; after these, so many times as many each turn.
SINGLE_TURNS, MORE_LEADERS = 1, 16
#: Buckets of a node that may be where a pair is compared; two nodes that share none of them meet in each that they share.
HOMES = 64
#: Cells of the table that orders shingles by how many texts hold them (collisions only cost time).
CELLS = 1 << 18
_BITS = 12


class Shingler:
    """Distinct shingles (64-bit hashes) of texts, with their counts."""

    #: Characters of texts that are taken at a time, so that the arrays of a step stay in a core's cache.
    CHARS = 150_000

    def __init__(self):
        self.white = np.zeros(256, bool)
        self.white[[0x20, *range(0x09, 0x0E)]] = True
        # The bytes of a word in a little-endian load of eight, by how many of them are left.
        self.mask = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        shingles, counts, _ = self.all([text])
        return shingles, counts

    def all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles and counts of the texts one after the other, in ascending order in each, and how many each has."""
        found = [self._some(texts[part]) for part in slices(texts, self.CHARS)]
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        return tuple(np.concatenate(x) for x in zip(empty, *found))

    def _some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        ends = np.cumsum([len(t) + 1 for t in parts])
        data = b"\n".join([*parts, b" " * 8])
        white = self.white.take(np.frombuffer(data, np.uint8))
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        edge = edge if white[0] else np.append(0, edge)
        begins, word_ends = edge[::2], edge[1::2]
        words = self._hashes(data, begins, word_ends - begins)
        # The words of text i are first[i] : first[i + 1].
        first = np.append(0, np.searchsorted(begins, ends))
        n_words = np.diff(first)
        windows = np.minimum(n_words, np.maximum(1, n_words - SHINGLE + 1))
        of = np.cumsum(windows) - windows
        at = np.arange(windows.sum()) + np.repeat(first[:-1] - of, windows)
        length = np.repeat(np.minimum(n_words, SHINGLE), windows)
        padded = np.append(words, np.zeros(SHINGLE, np.uint64))
        mixed = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE):
            new = mixed * np.uint64(0x9E3779B97F4A7C15) + padded[at + k]
            mixed = new if k == 0 else np.where(length > k, new, mixed)
        mixed = mix64(mixed)
        for a, b in zip(of.tolist(), (of + windows).tolist()):
            mixed[a:b].sort()
        new = np.ones(len(mixed), bool)
        new[1:] = mixed[1:] != mixed[:-1]
        new[of[windows > 0]] = True
        place = np.flatnonzero(new)
        counts = np.diff(np.append(place, len(mixed)))
        sizes = np.diff(np.append(0, np.searchsorted(place, of + windows)))
        return mixed[place], counts, sizes

    def _hashes(self, data: bytes, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hashes of the words: sums of the mixed loads of eight bytes, each by its place in the word, and the length."""
        if not len(begins):
            return np.zeros(0, np.uint64)
        loads = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        n = (lengths + 7) >> 3
        if n.max() == 1:
            return mix64(loads[begins] & self.mask[lengths]) + lengths.astype(np.uint64)
        of = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(of, n)
        load = loads[np.repeat(begins, n) + 8 * place] & self.mask[np.minimum(np.repeat(lengths, n) - 8 * place, 8)]
        load += place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return np.add.reduceat(mix64(load), of) + lengths.astype(np.uint64)


def _runs(sizes: np.ndarray) -> list[slice]:
    """The places of runs of these sizes that follow each other."""
    ends = np.cumsum(sizes).tolist()
    return [slice(a, b) for a, b in zip([0, *ends], ends)]


def _bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``block, rows, sizes, data`` of batches of ``block, row, text``: the texts of a block are compressed together."""
    for batch in batches:
        out = []
        for block, held in batch.groupby("block", sort=False):
            parts = [t.encode("utf-8", "surrogatepass") for t in held["text"]]
            sizes = np.array([len(t) for t in parts], np.uint64)
            data = pa.compress(b"".join(parts), codec="zstd", asbytes=True)
            out.append((block, held["row"].to_numpy(np.int64).tobytes(), sizes.tobytes(), data))
        yield pd.DataFrame(out, columns=["block", "rows", "sizes", "data"])


def _opened(bundles: pd.DataFrame) -> tuple[np.ndarray, list[str]]:
    """Rows and texts of :func:`_bundles`."""
    rows, texts = [np.zeros(0, np.int64)], []
    for of, sizes, data in zip(bundles["rows"], bundles["sizes"], bundles["data"]):
        sizes = np.frombuffer(sizes, np.uint64).astype(np.int64)
        raw = pa.decompress(data, int(sizes.sum()), codec="zstd", asbytes=True) if sizes.sum() else b""
        rows.append(np.frombuffer(of, np.int64))
        texts += [raw[run].decode("utf-8", "surrogatepass") for run in _runs(sizes)]
    return np.concatenate(rows), texts


def idf(df, n: int):
    """Inverse document frequency of shingles that ``df`` of ``n`` documents hold, damped by a second logarithm."""
    return 1.0 + np.log1p(np.log(n / np.asarray(df, np.float64)))


saturated_idf = idf  # its name in the tests


class Weights:
    """Weights of shingles from their counts in the text and their document frequencies."""

    def __init__(self, n: int):
        self.n, self.unit = n, float(idf(1, n)) if n else 1.0

    def __call__(self, counts: np.ndarray, dfs: np.ndarray) -> np.ndarray:
        return (1.0 + np.log(counts)) * (idf(dfs, self.n) / self.unit)


def planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, the first byte of all, then the second: shuffled files compress what sorted numbers share."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def steps(held: np.ndarray) -> np.ndarray:
    """Sorted numbers as the first and the steps to the next: their running sums are the numbers."""
    return np.diff(held, prepend=np.uint64(0))


def numbers(data: bytes, dtype) -> np.ndarray:
    """The numbers of :func:`planes`."""
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


@functools.cache
def _gamma2_quantiles() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, by bisection of its distribution function."""
    p = (np.arange(1 << _BITS) + 0.5) / (1 << _BITS)
    low, high = np.zeros(len(p)), np.full(len(p), 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low.astype(np.float32)


class Sampler:
    """Band keys of texts: consistent weighted samples, one hash per band of ``rows`` samples."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows = bands, rows
        self.seeds = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64))
        self.factors = self.seeds | np.uint64(1)  # odd: each sample hashes by a multiplication of its own
        self.gamma = _gamma2_quantiles()
        self.log_gamma = np.log(self.gamma)
        uniform = ((np.arange(1 << _BITS) + 0.5) / (1 << _BITS)).astype(np.float32)
        self.rest = np.float32(1) - uniform

    #: Shingles that are sampled at a time, so that the arrays of a step stay in a core's cache (whole texts).
    RUN = 32_768

    def keys(self, shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Keys [text, band] for the texts whose shingles begin at ``starts``."""
        begins = np.flatnonzero(np.diff(starts // self.RUN, prepend=-1))
        out = [np.zeros((0, self.bands), np.uint64)]
        for a, b in zip(begins, [*begins[1:], len(starts)]):
            run = slice(starts[a], starts[b] if b < len(starts) else len(shingles))
            out.append(self._keys(shingles[run], weights[run], starts[a:b] - starts[a]))
        return np.concatenate(out)

    def _keys(self, shingles: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << _BITS) - 1)
        # A weight of 1 is at step 0: only the others need their step and an element of their own.
        heavy = np.flatnonzero(weights != 1)
        log_weight = np.log(weights[heavy]).astype(np.float32)
        identity = ((shingles >> np.uint64(32)) ^ (shingles & np.uint64(0xFFFFFFFF))).view(np.int64)
        heavy_identity = identity[heavy]
        out = np.zeros((len(starts), self.bands), np.uint64)
        h, bits = np.empty_like(shingles), np.empty_like(shingles)
        r, log_a, rest, sign = (np.empty(len(h), t) for t in (np.float32, np.float32, np.float32, np.int32))
        index, order, log_bits = bits.view(np.int64), bits.view(np.int64), log_a.view(np.int32)
        for k, (seed, factor) in enumerate(zip(self.seeds, self.factors)):
            np.multiply(shingles, factor, out=h)
            np.right_shift(h, np.uint64(29), out=bits)
            np.bitwise_xor(h, bits, out=h)
            np.right_shift(h, np.uint64(52), out=bits)
            self.gamma.take(index, out=r, mode="clip")
            for shift, table, values in ((40, self.log_gamma, log_a), (28, self.rest, rest)):
                np.right_shift(h, np.uint64(shift), out=bits)
                np.bitwise_and(bits, mask, out=bits)
                table.take(index, out=values, mode="clip")
            if len(heavy):
                heavy_r = r[heavy]
                step = np.floor(log_weight / heavy_r + (np.float32(1) - rest[heavy]))
            np.multiply(r, rest, out=rest)
            np.subtract(log_a, rest, out=log_a)
            if len(heavy):
                log_a[heavy] -= heavy_r * step
                identity[heavy] = (heavy_identity + step.astype(np.int64) * 0x9E3779B1) & 0xFFFFFFFF
            # Floats as integers of the same order, above the identity of the sample.
            np.right_shift(log_bits, 31, out=sign)
            np.bitwise_and(sign, np.int32(0x7FFFFFFF), out=sign)
            np.bitwise_xor(log_bits, sign, out=log_bits)
            np.left_shift(log_bits, 32, out=order, dtype=np.int64)
            np.bitwise_or(order, identity, out=order)
            least = np.minimum.reduceat(order, starts).view(np.uint64)
            band = k // self.rows
            out[:, band] = mix64(out[:, band] ^ (least & np.uint64(0xFFFFFFFF)) + seed)
        return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - least
    return float(least / total) if total else 0.0


def _sketched(rows: DataFrame, n: int, size: int, bands: int, per_band: int) -> DataFrame:
    """``row, bands, dfs`` of ``rows(block, row, text)``, ``n`` rows of ``size`` bytes: band keys, and the document
    frequencies of the text's distinct shingles in the order of :class:`Shingler`."""
    bits = max(0, int(size // PART_BYTES).bit_length())
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(1, np.uint64)
    shingler, weigh = Shingler(), Weights(n)

    def pieces(block: pd.DataFrame) -> pd.DataFrame:
        held, times = np.unique(shingler.all(_opened(block)[1])[0], return_counts=True)
        ends = np.append(np.searchsorted(held, starts), len(held))
        some = np.flatnonzero(np.diff(ends))
        cut = [slice(ends[i], ends[i + 1]) for i in some]
        return pd.DataFrame(
            {
                "block": block["block"].iloc[0],
                "part": some.astype(np.int32),
                "shingles": [planes(steps(held[c])) for c in cut],
                "times": [planes(times[c].astype(np.uint32)) for c in cut],
            }
        )

    def added(part: pd.DataFrame) -> pd.DataFrame:
        held = [np.cumsum(numbers(b, np.uint64), dtype=np.uint64) for b in part["shingles"]]
        times = np.concatenate([numbers(b, np.uint32) for b in part["times"]])
        _, place = np.unique(np.concatenate(held), return_inverse=True)
        dfs = np.bincount(place, weights=times).astype(np.uint32)[place]
        cuts = np.split(dfs, np.cumsum([len(h) for h in held])[:-1])
        return part[["block", "part"]].assign(dfs=[planes(d) for d in cuts])

    def sketches(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        places, texts = _opened(block)
        shingles, counts, sizes = shingler.all(texts)
        held = np.unique(shingles)
        known = [numbers(b, np.uint32) for b in answers.sort_values("part")["dfs"]]
        dfs = np.concatenate([np.zeros(0, np.uint32), *known])[np.searchsorted(held, shingles)]
        sampler, keys = Sampler(bands, per_band), [None] * len(sizes)
        some = np.flatnonzero(sizes)
        if len(some):
            of = sampler.keys(shingles, weigh(counts, dfs), (np.cumsum(sizes) - sizes)[some]).astype(np.int64)
            for i, keys_of in zip(some, of):
                keys[i] = keys_of
        of = [dfs[run] for run in _runs(sizes)]
        return pd.DataFrame({"row": places, "bands": keys, "dfs": [planes(d) for d in of]})

    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    rows = rows.mapInPandas(_bundles, "block long, rows binary, sizes binary, data binary")
    rows = rows.repartition(int(tasks), "block")  # both uses of a block share this shuffle
    parts = rows.groupBy("block").applyInPandas(pieces, "block long, part int, shingles binary, times binary")
    answers = parts.groupBy("part").applyInPandas(added, "block long, part int, dfs binary")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(sketches, "row long, bands array<long>, dfs binary")


def _similarity_udf(n: int):
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        shingler, weigh = Shingler(), Weights(n)

        def weighted(texts: list[str], dfs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
            shingles, counts, sizes = shingler.all(texts)
            weights = weigh(counts, np.concatenate([np.zeros(0, np.uint32), *[numbers(d, np.uint32) for d in dfs]]))
            return [(shingles[run], weights[run]) for run in _runs(sizes)]

        last, leader = None, (np.zeros(0, np.uint64), np.zeros(0))
        for a, a_dfs, b, b_dfs in batches:
            out, texts = [], b.tolist()
            for part in slices(texts):
                for a_text, of, other in zip(a[part], a_dfs[part], weighted(texts[part], b_dfs[part])):
                    if a_text != last:  # pairs of one leader follow each other
                        last, leader = a_text, weighted([a_text], [of])[0]
                    out.append(similarity(leader, other))
            yield pd.Series(out, dtype="float64")

    return run.asNondeterministic()


def _hash_of(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def _verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """``pairs(leader, node)`` with the exact similarity ``sim``."""
    # One row for SALT_ROWS pairs at most, so it is broadcast; a leader with fewer pairs has one share.
    shares = pairs.groupBy("leader").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("shares"))
    shares = F.broadcast(shares.where("shares > 1"))
    left = pairs.join(texts, "node").join(shares, "leader", "left")
    left = left.withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    leaders = (
        texts.select(F.col("node").alias("leader"), F.col("text").alias("leader_text"), F.col("dfs").alias("leader_dfs"))
        .join(shares, "leader", "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)))
        .drop("shares")
    )
    both = left.join(leaders, ["leader", "salt"])
    sim = _similarity_udf(n)(*[F.col(c) for c in ("leader_text", "leader_dfs", "text", "dfs")])
    return both.select("leader", "node", sim.alias("sim"))


def _crowded(members: DataFrame, name: str) -> DataFrame:
    """Members (node, key, ...) of the buckets that have two nodes or more, with the bucket's ``leader``: the node with
    the smallest draw (equal buckets draw equal leaders)."""
    draw = F.struct(F.xxhash64("node").alias("draw"), F.col("node").alias("node"))
    several = members.groupBy("key").agg(F.count("*").alias("n"), F.min(draw).alias("first")).where("n > 1")
    return stored(members.join(several.select("key", F.col("first.node").alias("leader")), "key"), name)


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with ``root``, of the buckets that hold two classes or more."""
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return rooted.join(several.where(F.col("low") < F.col("high")).select("key"), "key")


def _different(members: DataFrame) -> DataFrame:
    """One bucket of each different set of nodes (told by two sums over the nodes' hashes and their number).

    Of buckets with the same nodes a node's first one counts: the weight from it on is the largest of them."""
    sums = [F.bit_xor(F.xxhash64(F.lit(s), "node")).alias(f"sum{s}") for s in (1, 2)]
    sets = members.groupBy("key").agg(F.count("*").alias("n"), *sums).where("n > 1")
    first = sets.groupBy("n", "sum1", "sum2").agg(F.min("key").alias("kept"))
    named = members.join(sets.join(first, ["n", "sum1", "sum2"]).select("key", "kept"), "key")
    kept = named.groupBy("node", F.col("kept").alias("key")).agg(F.max("weight").alias("weight"), F.max("left").alias("left"))
    return kept.select("node", "key", "weight", "left")


def _homed(members: DataFrame) -> DataFrame:
    """Members with ``homes``: the first buckets of the node, most weight first.

    Buckets have one order, that of their shingles, so two nodes agree on the first bucket that they share, and there both
    have the most weight left. The pair is compared there alone: neither leaves it before it has been compared with all
    others, unless the bucket is one class."""
    every = F.collect_list(F.struct((-F.col("left")).alias("left"), "key")).over(Window.partitionBy("node"))
    return members.withColumn("homes", F.slice(F.sort_array(every), 1, HOMES)["key"])


def _at_home() -> Column:
    """Whether the bucket ``key`` is where the nodes of ``homes`` and ``_homes`` are compared."""
    return F.coalesce(F.get(F.array_intersect("_homes", "homes"), F.lit(0)), "key") == F.col("key")


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(CELLS - 1)).astype(np.int64)


def _cell_counts(texts: DataFrame) -> np.ndarray:
    """For each cell, how often texts hold a shingle of it: no shingle is in more texts than that."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, counts = Shingler(), np.zeros(CELLS, np.int64)
        for batch in batches:
            all_texts = batch["text"].tolist()
            for part in slices(all_texts):
                counts += np.bincount(_cell(shingler.all(all_texts[part])[0]), minlength=CELLS)
        cells = np.flatnonzero(counts)
        yield pd.DataFrame({"cell": cells, "n": counts[cells]})

    found = texts.select("text").mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CELLS, np.int64)
    counts[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


def prefix(shingles: np.ndarray, weights: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a text, in the order of ``counts`` and hash, that leave less than the threshold; and for each
    the weight from it on. Two alike texts share one of these, and from the first that they share on both have at
    least the weight that they must have in common."""
    order = np.lexsort((shingles, counts[_cell(shingles)]))
    total = weights.sum()
    used = np.cumsum(weights[order])
    n = int((total - used >= threshold * total * (1 - 1e-9)).sum()) + 1
    return shingles[order[:n]], (total - used + weights[order])[:n]


def _prefixes(texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """``node, key, weight, left``: the buckets of the first shingles of each text, the text's whole weight and the
    weight from that shingle on."""
    counts = _cell_counts(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, weigh = Shingler(), Weights(n)
        for batch in batches:
            nodes, keys, left, sizes, totals = [], [], [], [], []
            texts_of = batch["text"].tolist()
            found = [shingler.all(texts_of[part]) for part in slices(texts_of)]
            found = [(s[run], c[run]) for s, c, sizes in found for run in _runs(sizes)]
            for node, (shingles, times), dfs in zip(batch["node"], found, batch["dfs"]):
                weights = weigh(times, numbers(dfs, np.uint32))
                first, after = prefix(shingles, weights, counts, threshold)
                shared = counts[_cell(first)] > 1  # the others are in no other text
                nodes.append(node)
                keys.append(first[shared].astype(np.int64))
                left.append(after[shared])
                sizes.append(int(shared.sum()))
                totals.append(weights.sum())
            if nodes:
                columns = {"node": np.repeat(nodes, sizes), "key": np.concatenate(keys), "weight": np.repeat(totals, sizes),
                           "left": np.concatenate(left)}
                yield pd.DataFrame(columns)

    return texts.select("node", "text", "dfs").mapInPandas(run, "node long, key long, weight double, left double")


def links(docs: DataFrame, nodes: DataFrame, n: int, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified pairs ``a < b`` of nodes (different texts) that resemble each other, and their classes (``node, root``).

    ``docs(row, text)``, ``n`` rows; ``nodes(node, bands, dfs)``, one row per different text, with the row that holds it.
    """
    bucket = F.posexplode("bands").alias("band", "key")
    keys = nodes.where(F.col("bands").isNotNull()).select("node", bucket)
    members = _crowded(keys.select("node", F.xxhash64("band", "key").alias("key")), "members")
    wanted = nodes.select("node", "dfs").join(members.select("node").distinct(), "node")
    texts = docs.select(F.col("row").alias("node"), "text").join(wanted, "node")
    texts = stored(texts, "texts", compression="zstd")
    pair = [F.greatest("leader", "node").alias("node"), F.least("leader", "node").alias("leader")]
    candidate = members.where(F.col("leader") != F.col("node"))
    checked = stored(_verified(candidate.select(*pair).distinct(), texts, n), "checked")

    def alike(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.col("sim") >= threshold).select(F.col("leader").alias("a"), F.col("node").alias("b"))

    roots = components(alike(checked))
    unresolved = stored(_open(members, roots).select("node").distinct(), "unresolved")
    discard(members)
    if unresolved.isEmpty():
        return alike(checked), roots
    prefixes = stored(_prefixes(texts.join(unresolved, "node"), n, threshold), "prefixes")
    members = stored(_homed(_open(_different(prefixes), roots)), "open")
    discard(unresolved, prefixes)
    leaders = 1
    for turn in itertools.count(1):
        if members.isEmpty():
            return alike(checked), roots
        ends = alike(checked).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
        order = Window.partitionBy("key").orderBy(F.desc("links"), F.xxhash64("node"), "node")
        ranked = members.join(ends, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)))
        chosen = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= leaders)
        chosen = chosen.select("key", F.col("node").alias("leader"), *[F.col(c).alias(f"_{c}") for c in ("root", "weight", "left", "homes")])
        chosen = stored(chosen, "chosen")
        # The weight that two alike texts have in common lies, for both, behind the first shingle that they share.
        common = (F.col("weight") + F.col("_weight")) * (threshold / (1 + threshold) * (1 - 1e-9))
        apart = (F.col("root") != F.col("_root")) & (F.least("left", "_left") >= common)
        candidate = members.join(chosen, "key").where(apart & _at_home())
        pairs = candidate.select(*pair).distinct().join(checked.select("leader", "node"), ["leader", "node"], "left_anti")
        added = stored(_verified(pairs, texts, n), "checked")
        checked = checked.unionByName(added)
        if not alike(added).isEmpty():  # else the classes are as they were
            before, roots = roots, merged(roots, alike(added))
            discard(before)
        # A leader has been compared with all of its bucket, so it leaves. What is left of one class needs nothing more.
        taken = chosen.select("key", F.col("leader").alias("node"))
        rest = stored(_open(members.drop("root").join(taken, ["key", "node"], "left_anti"), roots), "open")
        discard(members, chosen)
        members = rest
        if turn >= SINGLE_TURNS:
            leaders *= MORE_LEADERS


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours, linked with the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return large.where(F.col("u") != F.col("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, linked with the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    small = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every class is a star around its smallest node: a node has one smaller neighbour, or only larger ones."""
    ends = edges.select("u", F.lit(2).alias("n")).unionByName(edges.select(F.col("v").alias("u"), F.lit(1).alias("n")))
    of = ends.groupBy("u").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    return of.where("most = 2 and all > 2").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node on an edge ``(a, b)``; the root is the smallest node reached."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(edges):  # the steps do not change stars
        before, edges = edges, stored(_small_star(_large_star(edges)), "edges")
        discard(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (of :func:`components`) after further ``edges``: only the classes that these join are put together."""
    ends = edges
    for end in ("a", "b"):
        of = roots.select(F.col("node").alias(end), F.col("root").alias("_root"))
        ends = ends.join(of, end, "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    joined = components(ends.where("a <> b"))
    # What is joined here are roots and nodes without a class so far: neither stands in ``roots`` as a node.
    of = joined.select(F.col("node").alias("root"), F.col("root").alias("_root"))
    moved = roots.join(of, "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    out = stored(moved.unionByName(joined), "roots")
    discard(joined)
    return out


def classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Per document: ``doc_id, node, class_id, n_links`` (links of its text) and ``class_size``."""
    docs = spread(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    # Written once, so the row numbers are fixed from here on.
    number = F.monotonically_increasing_id().alias("row")
    docs = stored(docs.select("doc_id", number, _hash_of(F.col("text")).alias("md5"), "text"), "docs", compression="zstd")
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    blocks = docs.select(F.shiftright("row", BLOCK_BITS).alias("block"), "row", "text")
    sketches = stored(_sketched(blocks, n, size, bands, rows), "sketches")
    different = docs.groupBy("md5").agg(F.min("row").alias("node"))
    nodes = stored(different.join(sketches.withColumnRenamed("row", "node"), "node"), "nodes")
    discard(sketches)
    edges, roots = links(docs, nodes, n, threshold)
    edges = stored(edges, "links")
    ends = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    members = nodes.select("md5", "node").join(roots, "node", "left").join(ends, "node", "left")
    members = members.select("md5", F.coalesce("root", "node").alias("root"), "n_links")
    rows_ = docs.select("doc_id", "md5").join(members, "md5")
    named = rows_.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows_.join(named, "root").select(
        "doc_id", F.col("md5").alias("node"), "root", "class_id", "class_size",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, with the documents' own columns: the smallest id, then text hash."""
    found = stored(classes(docs, doc_id, text, **options), "classes")
    times = found.groupBy("root", "doc_id", "node").agg(F.count("*").alias("times"))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node", "times")
    kept = times.groupBy("root").agg(F.min(first).alias("first"))
    key = [F.col("doc_id").alias("_id"), F.col("node").alias("_of")]
    # Rows of one id and text are the same document: if kept, one of them stays.
    again = stored(kept.select("first.*").where("times > 1").select(*key), "repeated")
    lone = kept.select("first.*").where("times = 1").select(*key).toDF("lone_id", "lone")
    other = F.col("_id").eqNullSafe(F.col("lone_id")) & (F.col("_of") == F.col("lone"))
    gone = found.select(*key).distinct().join(lone, other, "left_anti")
    rows = packed(docs, id=F.col(doc_id), node=_hash_of(F.coalesce(F.col(text), F.lit(""))))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("node") == F.col("_of"))
    out = rows.join(gone, same, "left_anti")
    if not again.isEmpty():
        out = out.unionByName(rows.join(again, same, "left_semi").dropDuplicates(["id", "node"]))
    return unpacked(out, docs)
