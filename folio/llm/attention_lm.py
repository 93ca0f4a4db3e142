"""Language-model scoring with a small causal self-attention model over subword ids, trained in numpy.

Text: A-Z lower-cased, words separated by white space, each word's ids from a public byte-level
vocabulary (with its space), one end id per document.

Model: one attention head over token vectors with a bias per distance. The distribution of the
next id is a softmax over classes of ids, times the id's share of its class in the corpus. The
class logits are a table of the present id (logarithms of smoothed corpus counts) plus a linear
map of the attention's output. Classes gather ids that follow the same ids in the corpus. Ids above a fixed rank share hashed groups, so all tables are of
fixed size.

What is gathered from the corpus, over all training documents:

1. word counts, id counts and counts of successive id groups: one pass, partial sums per task, one
   aggregation, written to the shared folder;
2. attention weights: every task trains a copy, from the same start, on all its training documents;
   copies are averaged by their number of tokens in one aggregation over parameter numbers. The
   driver gets sums of fixed size. Without training documents the output map is 0.

Scoring cuts a document into blocks of new tokens, each with the tokens before it as context, and
scores every token once. Attention runs over many blocks at a time; scores that depend only on two
ids are looked up from a table.

The base (a smoothed word unigram) needs a count of every word. Words of at most ``HOT_WORDS``
(the most frequent ones, of bounded length) are summed where the text is read; a document's other
words are joined with the full table of counts, so no count is approximated and no hot word is
shuffled.

Defined results: a null or empty text has the end token only; a null id is in no remainder, so it
is learned from and not held out; repeated rows are documents each; texts of any length are scored
whole; without training documents all counts are 0; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from ._common import mix64, slices, stored

FOLDS, HELD_OUT = 5, 1
VOCABULARY, END = 50_256, 50_256  # ids, and the end of a document after them (fixed values)
#: Ids below it have a group of their own; the others share groups by hash and by word start.
OWN_GROUPS, SHARED_GROUPS = 831, 96
GROUPS = OWN_GROUPS + 2 * SHARED_GROUPS + 1  # the last: the end
CLASSES, OWN_CLASSES = 64, 16
DIM, BLOCK, CONTEXT = 16, 24, 16
WIDTH = BLOCK + CONTEXT
SMOOTH_ID, SMOOTH_CLASS = 0.5, 5.0
STEP_BLOCKS, LEARNING_RATE = 256, 0.1
HOT_WORDS, HOT_LENGTH = 200_000, 64
TABLE_ENTRIES = 300_000
#: Kinds of counts in the gathered table.
WORDS, IDS, PAIRS, DOCUMENTS = 0, 1, 2, 3


def held_out(doc_id: Column, folds: int = FOLDS, remainder: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == remainder, F.lit(False))


def words_of(text: str) -> list[bytes]:
    """UTF-8 words, A-Z in lower case (bytes split at exactly the six white space characters)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Subwords:
    """Ids of words, split once per distinct word and task (table of bounded size)."""

    def __init__(self, ranks: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}
        )
        self.starts = np.zeros(VOCABULARY + 1, bool)
        for token, i in known.items():
            self.starts[i] = token.startswith(b" ")
        shared = OWN_GROUPS + 2 * (np.arange(VOCABULARY + 1) % SHARED_GROUPS) + self.starts
        self.group = np.where(np.arange(VOCABULARY + 1) < OWN_GROUPS, np.arange(VOCABULARY + 1), shared)
        self.group[END] = GROUPS - 1
        self.table: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        if len(self.table) > TABLE_ENTRIES:
            self.table.clear()
        new = [w for w in words if w not in self.table]
        for at in range(0, len(new), 5_000):
            part = new[at : at + 5_000]
            ids = np.array(self.encoding.encode_ordinary((b" " + b" ".join(part)).decode("utf-8", "replace")), np.uint16)
            begins = np.flatnonzero(self.starts[ids])  # a space begins exactly one token: the first of a word
            if len(begins) == len(part):
                data, ends = ids.tobytes(), (2 * begins).tolist()
                self.table.update((w, data[a:b]) for w, a, b in zip(part, ends, [*ends[1:], len(data)]))
            else:
                for w in part:
                    ids = self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace"))
                    self.table[w] = np.array(ids, np.uint16).tobytes()

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of the words, with an end before (what the first id follows) and after."""
        data = b"".join(map(self.table.__getitem__, words))
        out = np.full(len(data) // 2 + 2, END, np.uint16)
        out[1:-1] = np.frombuffer(data, np.uint16)
        return out


# ---------------------------------------------------------------- counts


def gather(train: DataFrame) -> DataFrame:
    """``kind, word, cell, n``: counts over the training texts (``text``), written to the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subwords, counts = Subwords(), Counter()
        ids, pairs, documents = np.zeros(VOCABULARY + 1, np.int64), np.zeros(GROUPS * GROUPS, np.int64), 0

        def words() -> pd.DataFrame:
            out = pd.DataFrame({"kind": WORDS, "word": list(counts), "cell": 0, "n": list(counts.values())})
            counts.clear()
            return out

        for batch in batches:
            texts = batch["text"].tolist()
            documents += len(texts)
            for part in slices(texts):
                split = [words_of(t) for t in texts[part]]
                for w in split:
                    counts.update(w)
                subwords.learn(set().union(*split))
                seen = [subwords.ids(w) for w in split]
                every = np.concatenate(seen)
                ids += np.bincount(every, minlength=VOCABULARY + 1)
                ids[END] -= len(seen)  # the end before a text is no token of it
                group = subwords.group[every]
                follows = np.ones(len(every), bool)
                follows[np.cumsum([len(s) for s in seen]) - 1] = False  # after the end of a text
                at = np.flatnonzero(follows)
                pairs += np.bincount(group[at] * GROUPS + group[at + 1], minlength=GROUPS * GROUPS)
            if len(counts) > TABLE_ENTRIES:
                yield words()
        yield words()
        for kind, values in ((IDS, ids), (PAIRS, pairs), (DOCUMENTS, np.array([documents]))):
            cells = np.flatnonzero(values)
            yield pd.DataFrame({"kind": kind, "word": b"", "cell": cells, "n": values[cells]})

    found = train.mapInPandas(run, "kind int, word binary, cell long, n long")
    return stored(found.groupBy("kind", "word", "cell").agg(F.sum("n").alias("n")), "lm-counts")


@dataclass
class Tables:
    """Fixed-size tables from the corpus counts."""

    class_of: np.ndarray  # class of each group
    id_share: np.ndarray  # log of an id's share of its class
    table: np.ndarray  # log of the class's share after a group [group, class]


def cluster(pairs: np.ndarray, own: int = OWN_CLASSES, classes: int = CLASSES, rounds: int = 15) -> np.ndarray:
    """Class of each group: the ``own`` most frequent followers alone, the others by what they follow.

    Spherical k-means over the square roots of the shares of predecessors, started from the most
    frequent of the others; ``pairs`` [predecessor, follower] has fixed size.
    """
    size = pairs.sum(axis=0)
    order = np.lexsort((np.arange(len(size)), -size))
    out = np.zeros(len(size), np.int64)
    out[order[:own]] = np.arange(own)
    rest = order[own:]
    x = np.sqrt(pairs[:, rest].T / np.maximum(size[rest], 1)[:, None])
    centres = x[: classes - own].copy()
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        for c in range(classes - own):
            centre = (x[nearest == c] * size[rest][nearest == c, None]).sum(axis=0)
            length = np.linalg.norm(centre)
            centres[c] = centre / length if length else centres[c]
    out[rest] = own + nearest
    return out


def tables(counts: DataFrame) -> Tables:
    subwords = Subwords()
    ids, pairs = np.zeros(VOCABULARY + 1), np.zeros(GROUPS * GROUPS)
    for kind, values in ((IDS, ids), (PAIRS, pairs)):  # at most one row per id, and per pair of groups
        found = counts.where(F.col("kind") == kind).select("cell", "n").toPandas()
        values[found["cell"]] = found["n"]
    pairs = pairs.reshape(GROUPS, GROUPS)
    class_of = cluster(pairs)
    of_id = class_of[subwords.group]
    smooth = ids + SMOOTH_ID
    id_share = np.log(smooth / np.bincount(of_id, weights=smooth, minlength=CLASSES)[of_id])
    after = np.zeros((GROUPS, CLASSES))
    np.add.at(after.T, class_of, pairs.T)
    whole = after.sum(axis=0) + 1.0
    table = (after + SMOOTH_CLASS * whole / whole.sum()) / (after.sum(axis=1, keepdims=True) + SMOOTH_CLASS)
    return Tables(class_of, id_share.astype(np.float32), np.log(table).astype(np.float32))


# ---------------------------------------------------------------- attention

_SHAPES = {"q": (GROUPS + 1, DIM), "k": (GROUPS + 1, DIM), "v": (GROUPS + 1, DIM), "far": (WIDTH,), "out": (DIM, CLASSES)}
_PARAMETERS = sum(int(np.prod(s)) for s in _SHAPES.values())


def start_weights() -> dict[str, np.ndarray]:
    """The same small numbers everywhere (seeded), vectors of padding at 0."""
    rng = np.random.default_rng(7)
    out = {n: (rng.standard_normal(s) * 0.3).astype(np.float32) for n, s in _SHAPES.items()}
    out["far"][:] = 0
    out["out"] *= 0.3
    return out


def _unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


#: Distance from each query of a block to each key, and which keys it may see.
_DISTANCE = CONTEXT + np.arange(BLOCK)[:, None] - np.arange(WIDTH)[None, :]
_SEEN = _DISTANCE >= 0


def blocks(texts: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of all texts: groups of the keys [block, WIDTH] (padding: GROUPS), ids that follow the
    queries [block, BLOCK] (0 where there is none), and the text of each block."""
    lengths = np.array([len(t) - 1 for t in texts])  # queries: all but the last end
    per = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(texts)), per)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    every = np.concatenate(texts)
    begin = (np.cumsum(lengths + 1) - lengths - 1)[owner]
    place = number[:, None] * BLOCK - CONTEXT + np.arange(WIDTH)
    known = (place >= 0) & (place < lengths[owner][:, None])
    keys = np.where(known, group[every[np.where(known, begin[:, None] + place, 0)]], GROUPS)
    place = place[:, CONTEXT:]
    known = known[:, CONTEXT:]
    follows = np.where(known, every[np.where(known, begin[:, None] + place + 1, 0)], 0)
    return keys, follows, owner


def _summed(groups: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows of each group (padding: 0)."""
    groups = groups.ravel()
    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    out = np.zeros((GROUPS + 1, rows.shape[-1]), np.float32)
    out[ordered[begins]] = np.add.reduceat(rows.reshape(len(groups), -1)[order], begins, axis=0)
    out[GROUPS] = 0
    return out


def train_step(w: dict[str, np.ndarray], grown: dict[str, np.ndarray], t: Tables, keys: np.ndarray, target: np.ndarray) -> None:
    """One Adagrad step on the blocks; ``target`` has the class that follows each query (-1: none)."""
    query = keys[:, CONTEXT:]
    q, k, v = w["q"][query], w["k"][keys], w["v"][keys]
    scale = np.float32(DIM**-0.5)
    s = q @ k.transpose(0, 2, 1) * scale + w["far"][np.maximum(_DISTANCE, 0)]
    s = np.where(_SEEN & (keys != GROUPS)[:, None, :], s, np.float32(-1e9))
    a = np.exp(s - s.max(axis=2, keepdims=True))
    a /= a.sum(axis=2, keepdims=True)
    o = a @ v
    logits = t.table[np.minimum(query, GROUPS - 1)] + o @ w["out"]
    p = np.exp(logits - logits.max(axis=2, keepdims=True))
    p /= p.sum(axis=2, keepdims=True)
    known = target >= 0
    b, i = np.nonzero(known)
    p[b, i, target[b, i]] -= 1
    d = p * (known / np.float32(max(known.sum(), 1)))[:, :, None].astype(np.float32)
    grad = {"out": o.reshape(-1, DIM).T @ d.reshape(-1, CLASSES)}
    do = d @ w["out"].T
    da = do @ v.transpose(0, 2, 1)
    ds = a * (da - (da * a).sum(axis=2, keepdims=True))
    grad["far"] = np.bincount(np.maximum(_DISTANCE, 0).ravel(), weights=ds.sum(axis=0).ravel(), minlength=WIDTH)
    grad["q"] = _summed(query, ds @ k * scale)
    of_keys = np.concatenate([ds.transpose(0, 2, 1) @ q * scale, a.transpose(0, 2, 1) @ do], axis=2)
    grad["k"], grad["v"] = np.split(_summed(keys, of_keys), 2, axis=1)
    for name, g in grad.items():
        grown[name] += g * g
        w[name] -= (LEARNING_RATE * g / np.sqrt(grown[name] + 1e-8)).astype(np.float32)


def train(texts: DataFrame, t: Tables) -> dict[str, np.ndarray]:
    """Weights averaged over the tasks, each trained on its own part of ``texts(text)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subwords, w, tokens = Subwords(), start_weights(), 0
        grown = {n: np.zeros(s, np.float64) for n, s in _SHAPES.items()}
        of_id = t.class_of[subwords.group]
        for batch in batches:
            all_texts = batch["text"].tolist()
            for part in slices(all_texts):
                split = [words_of(x) for x in all_texts[part]]
                subwords.learn(set().union(*split))
                keys, follows, _ = blocks([subwords.ids(x) for x in split], subwords.group)
                known = keys[:, CONTEXT:] != GROUPS
                target = np.where(known, of_id[follows], -1)
                tokens += int(known.sum())
                # Neighbouring blocks are of one text: deal them out over the steps.
                steps = max(1, len(keys) // STEP_BLOCKS)
                for s in range(steps):
                    train_step(w, grown, t, keys[s::steps], target[s::steps])
        flat = np.concatenate([w[n].ravel() for n in _SHAPES]).astype(float)
        if tokens:
            yield pd.DataFrame({"i": np.arange(-1, _PARAMETERS), "x": np.append(1.0, flat) * tokens})

    sums = texts.mapInPandas(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
    sums = sums.toPandas().sort_values("i")  # one row per parameter
    if not len(sums):
        start = start_weights()
        start["out"][:] = 0  # nothing was learned: no part in the scores
        return start
    values = sums["x"].to_numpy()
    return _unpacked(values[1:] / values[0])


class Scorer:
    """Log-probabilities of ids with lookups instead of products where only two ids matter."""

    def __init__(self, w: dict[str, np.ndarray], t: Tables, subwords: Subwords):
        self.t, self.subwords, self.out = t, subwords, w["out"]
        pair = np.exp(np.clip(w["q"] @ w["k"].T * np.float32(DIM**-0.5), -30, 30)).astype(np.float32)
        pair[:, GROUPS] = 0  # padding is never seen
        self.pair = pair.ravel()
        self.far = np.where(_SEEN, np.exp(np.clip(w["far"][np.maximum(_DISTANCE, 0)], -30, 30)), 0).astype(np.float32)
        self.v = w["v"]
        self.table = np.vstack([t.table, t.table[:1]])
        self.of_id = t.class_of[subwords.group].astype(np.int64)

    def __call__(self, texts: list[np.ndarray], step: int = 256) -> np.ndarray:
        """Natural logarithm of the probability of each text (ids with the ends)."""
        keys, follows, owner = blocks(texts, self.subwords.group)
        total = np.zeros(len(keys))
        for at in range(0, len(keys), step):
            key, follow = keys[at : at + step], follows[at : at + step]
            query = key[:, CONTEXT:]
            a = np.take(self.pair, query[:, :, None] * (GROUPS + 1) + key[:, None, :], mode="clip")
            a *= self.far
            o = a @ np.take(self.v, key, axis=0, mode="clip")
            o /= np.maximum(a.sum(axis=2, keepdims=True), np.float32(1e-30))
            logits = o.reshape(-1, DIM) @ self.out
            logits += np.take(self.table, query.ravel(), axis=0, mode="clip")
            follow = follow.ravel()
            right = logits[np.arange(len(logits)), self.of_id[follow]]
            np.exp(logits, out=logits)
            value = right - np.log(logits.sum(axis=1)) + self.t.id_share[follow]
            value[query.ravel() == GROUPS] = 0
            total[at : at + step] = value.reshape(query.shape).sum(axis=1, dtype=float)
        return np.bincount(owner, weights=total, minlength=len(texts))


# ---------------------------------------------------------------- scoring


def hot_words(counts: DataFrame, k: int = HOT_WORDS) -> dict[bytes, int]:
    """Counts of the most frequent words: all that occur at least so often that there are at most ``k``."""
    words = counts.where((F.col("kind") == WORDS) & (F.length("word") <= HOT_LENGTH))
    step = F.floor(F.log2("n") * 4).alias("step")
    sizes = words.groupBy(step).agg(F.count("*").alias("size"), F.min("n").alias("least")).collect()
    held, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["step"]):
        held += r["size"]
        if held > k:
            break
        least = r["least"]
    if least is None:
        return {}
    found = words.where(F.col("n") >= least).select("word", "n").toPandas()
    return dict(zip(map(bytes, found["word"]), found["n"].tolist()))


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    spark = docs.sparkSession
    rows = spread(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            held_out(F.col(doc_id)).alias("held_out"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        )
    )
    learned = rows.where(~F.col("held_out"))
    counts = gather(learned.select("text"))
    t = tables(counts)
    weights = train(learned.select("text"), t)

    totals = {r["kind"]: (r["n"], r["size"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("size")).collect()}
    ends = totals.get(DOCUMENTS, (0, 0))[0]
    train_tokens = totals.get(WORDS, (0, 0))[0] + ends
    distinct = totals.get(WORDS, (0, 0))[1] + (ends > 0)
    mass = train_tokens + 0.5 * (distinct + 1)
    end_score = float(np.log10((ends + 0.5) / mass))
    # At most HOT_WORDS words of at most HOT_LENGTH bytes, and tables of fixed size.
    shared = spark.sparkContext.broadcast((hot_words(counts), vars(t), weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, of_corpus, learned_weights = shared.value
        subwords = Subwords()
        scorer = Scorer(learned_weights, Tables(**of_corpus), subwords)
        place = dict(zip(hot, range(len(hot))))
        logs = np.append(np.log10((np.fromiter(hot.values(), float, len(hot)) + 0.5) / mass), 0.0)
        first, number = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            texts, out = batch["text"].tolist(), []
            for part in slices(texts):
                split = [words_of(x) for x in texts[part]]
                subwords.learn(set().union(*split))
                found = scorer([subwords.ids(x) for x in split])
                for words, score in zip(split, found):
                    at = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
                    rare = Counter(words[i] for i in np.flatnonzero(at < 0))
                    base = float(logs[at].sum()) + end_score
                    known = len(words) - rare.total() + (ends > 0)
                    out.append((first + number, len(words) + 1, known, base, score / np.log(10), list(rare), list(rare.values())))
                    number += 1
            made = pd.DataFrame(out, columns=["row", "n_tokens", "known", "base", "score", "rare", "times"])
            yield pd.concat([batch[["doc_id", "held_out"]].reset_index(drop=True), made], axis=1)

    kept = rows.schema["doc_id"].dataType.simpleString()
    scored = stored(
        rows.mapInPandas(
            run,
            f"doc_id {kept}, held_out boolean, row long, n_tokens long, known long, base double, score double, "
            "rare array<binary>, times array<int>",
        ),
        "lm-scored",
    )
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r"))
    rare = rare.select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    known = counts.where(F.col("kind") == WORDS).select("word", F.col("n").alias("c"))
    joined = rare.join(known, "word", "left").select(
        "row",
        (F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / mass)).alias("base"),
        F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known"),
    )
    rest = joined.groupBy("row").agg(F.sum("base").alias("rest_base"), F.sum("known").alias("rest_known"))
    return scored.drop("rare", "times").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
