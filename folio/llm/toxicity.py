"""Toxicity by a subsequence string kernel with Nyström landmarks and a linear support vector machine.

Words are compared by the gap-weighted subsequence kernel (order 3, decay 0.6), so an insult with
characters inserted or left out, or with another ending, still resembles its landmark (words carry
marks at both ends, so where the shared letters stand counts too). A sentence
is described by its largest kernel value per landmark; the Nyström map turns that into features
whose dot products approximate the kernel, and a squared-hinge SVM is trained on sentences. A
document is judged by the margins of its three worst sentences; a logistic map of them, monotone
in each, gives a score of 0..1.

Fitting uses a bounded sample of labelled training rows (``sample_rows``, the smallest hashes of
their ids), read from the documents by a broadcast of its ids. Landmarks are words that are more
frequent in its toxic documents. A label marks a document, not a sentence, so the sentences to
learn from are chosen in turn with the model: each document gives its worst sentence. Only these
sentences' kernel values reach the driver. Scoring reads every text whole, in one pass without a
shuffle; kernel values are computed once per distinct word and task (table of bounded size), and
only for words that share enough ordered character pairs with a landmark.

Defined results: a null or empty text is scored like a text without insults; a null id is kept
(it is in no fold's remainder and counts as not held out, and no label can belong to it);
rows without a label are scored only; an id labelled several times counts as toxic if any label
is; repeated rows score alike; without labels of both kinds every score is 0; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from ._common import packed, slices, stored, unpacked

SAMPLE_ROWS = 20_000
LANDMARKS, CANDIDATES = 64, 2_000
ORDER, DECAY = 3, 0.6
#: Kernel values below this count as 0; a word this near to a chosen landmark is no other landmark.
LEAST_KERNEL, SAME_KERNEL = 0.5, 0.75
#: A landmark is so many times more frequent in toxic documents, in so many of them, with so many letters.
LEAST_ODDS, LEAST_DOCUMENTS, LEAST_LETTERS = 5.0, 3, 4
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
#: Characters of a word in one piece, with its end marks; longer words are compared in overlapping pieces.
PIECE, OVERLAP = 24, 12
BEGIN_MARK, END_MARK = "\x02", "\x03"
#: Sentences of a document whose margins enter its score.
WORST = 3
#: Share of a landmark's ordered character pairs that a word must have to be compared with it.
PAIR_SHARE = 0.6
TABLE_ENTRIES = 200_000
ROUNDS = 3
#: Sentences end at white space after their marks, so their tokens are those of the text.
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_MARKS = re.compile(r"[\W_]+")
#: Three or more single letters one after the other, each with punctuation or none.
_ALONE = re.compile(r"(?:(?<=\s)|^)(?:[\W_]*[^\W_][\W_]*(?:\s+|$)){3,}")


def held_out(doc_id: Column, folds: int = FOLDS, remainder: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == remainder, F.lit(False))


def bare(token: str) -> str:
    """A lower-case token without punctuation ("" if it has fewer than three letters)."""
    word = token if token.isalnum() else _MARKS.sub("", token)
    return word if len(word) > 2 else ""


def joined_letters(lower: str) -> list[str]:
    """Runs of three or more letters that stand alone, each joined to a word."""
    return [_MARKS.sub("", run) for run in _ALONE.findall(lower)]


def tokens_of(text: str) -> tuple[set[str], bool]:
    """Distinct lower-case tokens, joined letters among them; whether there are joined letters."""
    lower = text.lower()
    tokens = set(lower.split())
    joined = joined_letters(lower) if sum(len(t) < 3 for t in tokens) > 2 else []
    tokens.update(joined)
    return tokens, bool(joined)


def _pieces(word: str) -> list[str]:
    word = BEGIN_MARK + word + END_MARK
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word) - OVERLAP, OVERLAP)]


def _codes(words: list[str]) -> np.ndarray:
    """Code points [word, place], 0 after the end."""
    return np.array(words, f"U{PIECE}").view(np.uint32).reshape(len(words), PIECE)


def kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of the pairs (s[i], t[i]) of code arrays, not normalised."""
    n, lam = len(s), np.float32(decay)
    wide_s, wide_t = (int((x != 0).sum(axis=1).max(initial=0)) for x in (s, t))
    # prime[i][y]: kernel of order i of s so far and the first y characters of t, ending at their ends.
    prime = [np.ones((wide_t + 1, n), np.float32)] + [np.zeros((wide_t + 1, n), np.float32) for _ in range(order - 1)]
    total = np.zeros(n, np.float32)
    for x in range(wide_s):
        alive = s[:, x] != 0
        match = [(s[:, x] == t[:, y]) & alive for y in range(wide_t)]
        for y in range(wide_t):
            total += np.where(match[y], lam * lam * prime[order - 1][y], 0)
        for i in range(order - 1, 0, -1):
            run = np.zeros(n, np.float32)
            for y in range(wide_t):
                run = lam * run + np.where(match[y], lam * lam * prime[i - 1][y], 0)
                prime[i][y + 1] = np.where(alive, lam * prime[i][y + 1] + run, prime[i][y + 1])
    return total


def own_kernel(s: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(kernel(s, s), np.float32(1e-30)))


def normalised(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    return kernel(s, t) / (own_kernel(s) * own_kernel(t))


def _pair_masks(codes: np.ndarray, gaps: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """A set of 128 bits per word (two integers) of its ordered character pairs so many places apart."""
    masks = np.zeros((len(codes), 2), np.uint64)
    for gap in gaps:
        for x in range(PIECE - gap):
            a, b = codes[:, x], codes[:, x + gap]
            if not b.any():
                break
            h = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) >> np.uint32(25)
            bit = (b != 0).astype(np.uint64) << (h & np.uint32(63)).astype(np.uint64)
            low = h < 64
            masks[:, 0] |= bit * low
            masks[:, 1] |= bit * ~low
    return masks


class Landmarks:
    """Kernel values of tokens against the landmarks, computed once per distinct token."""

    def __init__(self, words: list[str]):
        self.words = words
        self.codes = _codes([_pieces(w)[0] for w in words])
        self.adjacent = _pair_masks(self.codes, gaps=(1,))
        self.needed = np.ceil(PAIR_SHARE * np.bitwise_count(self.adjacent).sum(axis=1))
        self.own = own_kernel(self.codes)
        self.seen: set[str] = set()
        #: Only tokens near a landmark: landmarks and values.
        self.near: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def learn(self, texts: list[str]) -> list[tuple[set[str], bool]]:
        """The distinct tokens of each text; those not yet seen are compared with the landmarks."""
        if len(self.seen) > TABLE_ENTRIES:
            self.seen.clear()
            self.near.clear()
        found = [tokens_of(t) for t in texts]
        new = set().union(*(t for t, _ in found)) - self.seen
        self.seen |= new
        new = sorted(filter(bare, new), key=len)  # tokens of like length have arrays of like width
        for at in range(0, len(new), 10_000):
            self._add(new[at : at + 10_000])
        return found

    def _add(self, tokens: list[str]) -> None:
        pieces = [_pieces(bare(w)) for w in tokens]
        owner = np.repeat(np.arange(len(tokens)), [len(p) for p in pieces])
        codes = _codes([x for p in pieces for x in p])
        masks = _pair_masks(codes)
        rows, cols = [], []
        for k, (mask, needed) in enumerate(zip(self.adjacent, self.needed)):
            shared = np.bitwise_count(masks[:, 0] & mask[0]) + np.bitwise_count(masks[:, 1] & mask[1])
            found = np.flatnonzero(shared >= needed)
            rows.append(found)
            cols.append(np.full(len(found), k))
        rows, cols = np.concatenate(rows), np.concatenate(cols)
        values = np.zeros(len(rows), np.float32)
        compared, place = np.unique(rows, return_inverse=True)
        own = own_kernel(codes[compared])[place] * self.own[cols]
        for at in range(0, len(rows), 10_000):
            part = slice(at, at + 10_000)
            values[part] = kernel(codes[rows[part]], self.codes[cols[part]]) / own[part]
        keep = values >= LEAST_KERNEL
        best: dict[int, dict[int, float]] = {}
        for i, k, v in zip(owner[rows[keep]].tolist(), cols[keep].tolist(), values[keep].tolist()):
            of = best.setdefault(i, {})
            of[k] = max(v, of.get(k, 0.0))
        for i, of in best.items():
            self.near[tokens[i]] = (np.array(list(of), np.int64), np.array(list(of.values()), np.float32))

    def sentences(self, text: str, tokens: set[str], joined: bool) -> np.ndarray:
        """Kernel values [sentence, landmark] of the sentences that have a token near a landmark."""
        out = []
        if not tokens.isdisjoint(self.near):
            for sentence in _SENTENCE.split(text.lower()):
                words = sentence.split() + (joined_letters(sentence) if joined else [])
                hits = [h for w in words if (h := self.near.get(w))]
                if hits:
                    values = np.zeros(len(self.words), np.float32)
                    for k, v in hits:
                        values[k] = np.maximum(values[k], v)
                    out.append(values)
        return np.array(out, np.float32).reshape(len(out), len(self.words))


def worst_margins(margins: np.ndarray) -> np.ndarray:
    """The largest margins of a document's sentences, in falling order (0 where it has fewer)."""
    top = np.sort(margins)[::-1][:WORST]
    return np.concatenate([top, np.zeros(WORST - len(top))])


@dataclass
class Model:
    """Landmarks, the weight of each kernel value (Nyström map times SVM weights), calibration."""

    landmarks: list[str]
    weight: np.ndarray
    calibration: np.ndarray

    def score(self, sentences: np.ndarray) -> float:
        """Probability for a document from its sentences' kernel values."""
        x = np.append(worst_margins(sentences @ self.weight), 1.0)
        return float(1 / (1 + np.exp(-np.clip(x @ self.calibration, -60, 60))))


def nystroem(landmarks: list[str]) -> np.ndarray:
    """The map from kernel values to features: the inverse square root of the landmarks' kernel."""
    codes, m = _codes(landmarks), len(landmarks)
    i, j = np.divmod(np.arange(m * m), m)
    gram = normalised(codes[i], codes[j]).reshape(m, m).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 1e-3 * np.eye(m))
    return vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a squared-hinge SVM by Newton steps; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    cost = penalty * np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        inside = y * (x @ w) < 1
        a = x[inside] * cost[inside, None]
        new = np.linalg.solve(ridge + a.T @ x[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic model by damped Newton steps; those of the margins are held at 0 or above.

    The offset is moved half way from the sample's share of toxic documents to equal shares.
    """
    positive, negative = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (target - p) - 0.01 * w)
        new = w + np.clip(step, -2, 2)
        new[:-1] = np.maximum(new[:-1], 0)
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    w[-1] += 0.5 * np.log(negative / positive)
    return w


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``toxic, text`` of at most ``rows`` labelled training documents (smallest hashes of ids)."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text")  # at most ``rows`` ids


def _word_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen = {0: Counter(), 1: Counter()}
        for toxic, text in zip(batch["toxic"], batch["text"]):
            words = {bare(w) for w in tokens_of(text)[0]}
            seen[int(toxic > 0)].update(w for w in words if LEAST_LETTERS <= len(w) <= PIECE - 2)
        words = list(seen[0] | seen[1])
        yield pd.DataFrame({"word": words, "clean": [seen[0][w] for w in words], "bad": [seen[1][w] for w in words]})


def choose_landmarks(rows: DataFrame, clean: int, bad: int, k: int = LANDMARKS) -> list[str]:
    """At most ``k`` words whose frequency in toxic documents stands out, none too near another."""
    counts = rows.mapInPandas(_word_documents, "word string, clean long, bad long").groupBy("word")
    counts = counts.agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).where(F.col("bad") >= LEAST_DOCUMENTS)
    p0, p1 = (F.col("clean") + 0.5) / (clean + 1), (F.col("bad") + 0.5) / (bad + 1)
    p = (F.col("clean") + F.col("bad") + 1) / (clean + bad + 2)
    z = (p1 - p0) / F.sqrt(p * (1 - p) * (1 / clean + 1 / bad))
    best = counts.where(p1 >= LEAST_ODDS * p0).orderBy(z.desc(), "word").limit(CANDIDATES)
    chosen: list[str] = []
    for word in (r["word"] for r in best.collect()):
        if len(chosen) == k:
            break
        if chosen:
            mine = np.repeat(_codes(_pieces(word)[:1]), len(chosen), axis=0)
            if normalised(mine, _codes([_pieces(c)[0] for c in chosen])).max() >= SAME_KERNEL:
                continue
        chosen.append(word)
    return chosen


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """Fit on the labelled training rows; None without labels of both kinds or without landmarks."""
    rows = stored(spread(sample(docs, labels, sample_rows)), "toxic-sample")
    size = {r["bad"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    if not size.get(True) or not size.get(False):
        return None
    chosen = choose_landmarks(rows, size[False], size[True], landmarks)
    if not chosen:
        return None

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = Landmarks(chosen)
        for batch in batches:
            texts, out = batch["text"].tolist(), []
            for part in slices(texts):
                out += [near.sentences(t, *w).tobytes() for t, w in zip(texts[part], near.learn(texts[part]))]
            yield pd.DataFrame({"toxic": batch["toxic"].astype(int), "values": out})

    # Per sampled document the kernel values of its sentences that are near a landmark.
    found = rows.mapInPandas(describe, "toxic int, values binary")
    bags, y = [], []
    for r in found.toLocalIterator():
        bags.append(np.frombuffer(r["values"], np.float32).reshape(-1, len(chosen)))
        y.append(1.0 if r["toxic"] > 0 else -1.0)
    return train(chosen, bags, np.array(y))


def train(landmarks: list[str], bags: list[np.ndarray], y: np.ndarray) -> Model:
    """Choose each document's worst sentence, train on these, and again; then calibrate documents."""
    to_features = nystroem(landmarks)
    weight = np.ones(len(landmarks))  # first choice: the sentence nearest to the landmarks
    none = np.zeros(len(landmarks))
    for _ in range(ROUNDS):
        worst = np.array([b[np.argmax(b @ weight)] if len(b) else none for b in bags])
        weight = to_features @ svm(worst @ to_features, y)[:-1]
    x = np.array([np.append(worst_margins(b @ weight), 1.0) for b in bags])
    return Model(landmarks, weight, logistic(x, y))


def score_udf(model: Model | None):
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        near = Landmarks(model.landmarks) if model else None
        for batch in batches:
            texts, out = batch.tolist(), []
            for part in slices(texts):
                if near:
                    pairs = zip(texts[part], near.learn(texts[part]))
                    out += [model.score(near.sentences(t, *w)) for t, w in pairs]
                else:
                    out += [0.0] * len(texts[part])
            yield pd.Series(out, dtype="float64")

    return run.asNondeterministic()  # evaluated once per row


def scores(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    rows = spread(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_udf(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_toxic(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents below the threshold, with their own columns."""
    rows = spread(packed(docs, text=F.coalesce(F.col("text"), F.lit(""))))
    rows = rows.select("row", score_udf(model)(F.col("text")).alias("score"))
    return unpacked(rows.where(F.col("score") < threshold), docs)
