"""Quality rules by tokeniser fertility, with simple word statistics as a base.

A public vocabulary splits the words of a text into pieces. Three measures follow: characters
per token, the share of byte-fallback tokens, and the entropy (bits) of the text's token
distribution. A text is rejected when a measure leaves the band of
its language (or, for other languages, of the script most of its letters have). Each distinct
word is split once per task (table of bounded size); only the measures are shuffled.

The bands come from the corpus: for each language (or script), quartiles of each measure over all
documents that pass the base rules and the fixed limits, equal measurements counted once, found by one aggregation over
small steps of the measures. A limit lies :data:`SPREADS` spreads from the median, a spread being
the distance to the quartile on that side as that of a normal distribution, and never outside the
fixed, wide limits of :data:`BANDS`. With n such documents it goes n / (n + :data:`TRUST`) of the way from the
wide limit: one rule for every size, without a step. Bands given as a parameter are used as they are. Base
rules: too few words, or more than half of the words inside repeated three-word windows.

Defined results: a null or empty text has no words and fails the base; a null id or language is
kept (the script decides); repeated rows are judged alike; whole texts are read, in slices of
bounded size; an empty table gives no rows; other columns of the documents are ignored by
:func:`measures`, and :func:`keep_clean` returns the documents' own columns.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from ._common import WORD, packed, slices, stored, unpacked
from .token_counts import model_path

_WORD = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
VOCABULARY = 300_000


@dataclass(frozen=True)
class Band:
    """Limits of the measures; a text outside any of them is rejected."""

    min_chars_per_token: float
    max_chars_per_token: float
    max_byte_share: float
    min_entropy: float


#: Default bands by language, then by script; "other" is for every other script.
BANDS: Mapping[str, Band] = {
    "en": Band(1.3, 8.0, 0.10, 3.5),
    "de": Band(1.3, 8.0, 0.10, 3.5),
    "fr": Band(1.3, 8.0, 0.10, 3.5),
    "es": Band(1.3, 8.0, 0.10, 3.5),
    "latin": Band(1.2, 9.0, 0.20, 3.0),
    "cyrillic": Band(1.0, 9.0, 0.20, 3.0),
    "other": Band(0.25, 9.0, 0.95, 3.0),
}
#: Spreads between the median and a limit, and documents at which a limit is halfway from the wide one.
SPREADS, TRUST = 4, 30
#: Steps that measures are counted in, and the least distance of a limit from the median.
STEPS = {"chars_per_token": 0.001, "byte_share": 0.001, "entropy": 0.01}
LEAST_DISTANCE = {"chars_per_token": 0.05, "byte_share": 0.10, "entropy": 0.5}
_SCRIPTS = {"latin": re.compile("[A-Za-zÀ-ɏ]"), "cyrillic": re.compile("[Ѐ-ӿ]")}


def script_of(words: list[str]) -> str:
    """``latin``, ``cyrillic`` or ``other``: the script of most letters."""
    text = "".join(words)
    found = {k: sum(1 for _ in p.finditer(text)) for k, p in _SCRIPTS.items()}
    letters = sum(map(str.isalpha, text))
    best = max(found, key=found.__getitem__)
    return best if 2 * found[best] >= max(letters, 1) else "other"


class Fertility:
    """Word codes and, per distinct word, the pieces of a vocabulary."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        self.bytes = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = defaultdict(count().__next__)
        self.ids: list[np.ndarray] = []

    def codes(self, texts_words: list[list[str]]) -> list[np.ndarray]:
        """Codes of the words of each text; new words are split into pieces."""
        if len(self.code) > VOCABULARY:
            self._clear()
        get = self.code.__getitem__
        out = [np.fromiter(map(get, w), np.int64, len(w)) for w in texts_words]
        if len(self.code) > len(self.ids):
            new = list(self.code)[len(self.ids) :]
            self.ids += [np.array(x, np.int32) for x in self.model.encode(new, num_threads=1)]
        return out

    def measure(self, codes: np.ndarray) -> tuple[int, float, float]:
        """Tokens, byte-fallback share, entropy in bits of one text."""
        distinct, times = np.unique(codes, return_counts=True)
        pieces = [self.ids[c] for c in distinct]
        weight = np.repeat(times, [len(p) for p in pieces])
        if not len(weight):
            return 0, 0.0, 0.0
        ids = np.concatenate(pieces)
        counts = np.bincount(ids, weights=weight)
        counts = counts[counts > 0]
        total = counts.sum()
        entropy = float(np.log2(total) - (counts * np.log2(counts)).sum() / total)
        return int(total), float(weight[self.bytes[ids]].sum() / total), entropy


def repeat_words(codes: np.ndarray) -> int:
    """Words inside a three-word window that the text holds twice or more (first one included)."""
    n = len(codes) - 2
    if n < 2:
        return 0
    if codes.max() >> 21:  # re-number per pair, so that the key stays exact
        pair = np.unique(codes[:-1] << 32 | codes[1:], return_inverse=True)[1].astype(np.int64)
        key = pair[:-1] << 32 | codes[2:]
    else:
        key = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
    _, place, times = np.unique(key, return_inverse=True, return_counts=True)
    found = np.flatnonzero(times[place] > 1)
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[found + k] = True
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return len(lines) - len(set(lines))


#: What :func:`measures_udf` returns for a text.
MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
    "chars_per_token double, byte_share double, entropy double, band string, fertility_ok boolean"
)
_NAMES = [f.split()[0] for f in MEASURES.split(", ")]


def judge(text: str, lang: str | None, words: list[str], codes: np.ndarray, table: Fertility, bands) -> tuple:
    tokens, byte_share, entropy = table.measure(codes)
    chars = sum(map(len, words))
    name = lang if lang in bands else script_of(words)
    band, fertility = bands[name], chars / tokens if tokens else 0.0
    ok = (
        tokens > 0
        and band.min_chars_per_token <= fertility <= band.max_chars_per_token
        and byte_share <= band.max_byte_share
        and entropy >= band.min_entropy
    )
    symbols = sum(map(text.count, SYMBOLS))
    repeats = repeat_words(codes)
    lines = duplicate_lines(text)
    return len(words), chars, symbols, lines, repeats, tokens, fertility, byte_share, entropy, name, ok


def measures_udf(bands: Mapping[str, Band] = BANDS, model: str | None = None):
    """Arrow UDF (text, language) -> struct of :data:`MEASURES`; one vocabulary per task."""
    bands = dict(bands)

    @F.pandas_udf(MEASURES)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = Fertility(model)
        for texts, langs in batches:
            texts, langs, out = texts.tolist(), langs.tolist(), []
            for part in slices(texts):
                words = [_WORD.findall(t) for t in texts[part]]
                rows = zip(texts[part], langs[part], words, table.codes(words))
                out += [judge(t, lang, w, c, table, bands) for t, lang, w, c in rows]
            yield pd.DataFrame(out, columns=_NAMES)

    return run.asNondeterministic()  # evaluated once per row, never copied into a filter


def base_failed(n_words: Column, n_repeat_words: Column, min_words: int, max_repeat_percent: int) -> Column:
    return (n_words < min_words) | (n_repeat_words * 100 > n_words * max_repeat_percent)


def found_bands(found: DataFrame, bands: Mapping[str, Band] = BANDS) -> dict[str, Band]:
    """Limits from the measures of documents that pass the base rules and ``bands``, inside ``bands``."""
    once = found.select("band", "n_words", "word_chars", "n_tokens", "chars_per_token", "byte_share", "entropy").distinct()
    steps = [
        F.struct(F.lit(m).alias("measure"), F.least(F.round(F.col(m) / s), F.lit(100_000)).cast("int").alias("step"))
        for m, s in STEPS.items()
    ]
    cells = once.select("band", F.explode(F.array(*steps)).alias("cell")).select("band", "cell.*")
    # One row per band, measure and step: a bounded number.
    counts = cells.groupBy("band", "measure", "step").agg(F.count("*").alias("n")).toPandas()
    out = dict(bands)
    for name, rows in counts.groupby("band"):
        limits = {}
        for measure, cell in rows.groupby("measure"):
            cell = cell.sort_values("step")
            below, size = np.cumsum(cell["n"].to_numpy()), STEPS[measure]
            low, mid, high = (cell["step"].to_numpy()[np.searchsorted(below, q * below[-1])] * size for q in (0.25, 0.5, 0.75))
            reach = [max(LEAST_DISTANCE[measure], SPREADS * 1.4826 * d) for d in (mid - low, high - mid)]
            limits[measure] = mid - reach[0], mid + reach[1], int(below[-1])
        out[name] = shrunk(bands[name], limits, limits["entropy"][2])
    return out


def shrunk(wide: Band, limits: Mapping[str, tuple[float, float, int]], n: int) -> Band:
    """The wide limits moved towards those found in ``n`` documents, further the more there are."""
    part = n / (n + TRUST)
    inward = lambda limit, found: limit + part * max(0.0, found - limit)
    down = lambda limit, found: limit - part * max(0.0, limit - found)
    return Band(
        inward(wide.min_chars_per_token, limits["chars_per_token"][0]),
        down(wide.max_chars_per_token, limits["chars_per_token"][1]),
        down(wide.max_byte_share, limits["byte_share"][1]),
        inward(wide.min_entropy, limits["entropy"][0]),
    )


def within(bands: Mapping[str, Band]) -> Column:
    """Whether the measures of a row lie in its band."""
    out = F.lit(False)
    for name, b in bands.items():
        inside = F.col("chars_per_token").between(b.min_chars_per_token, b.max_chars_per_token)
        inside = inside & (F.col("byte_share") <= b.max_byte_share) & (F.col("entropy") >= b.min_entropy)
        out = F.when(F.col("band") == name, inside).otherwise(out)
    return out & (F.col("n_tokens") > 0)


def measures(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    bands: Mapping[str, Band] | None = None,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    model: str | None = None,
) -> DataFrame:
    """Per document: the base counts, the fertility measures, ``base_failed`` and ``kept``."""
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang")))
    found = measures_udf(bands or BANDS, model)(F.coalesce("_text", F.lit("")), F.col("_lang"))
    rows = rows.select("doc_id", found.alias("_found")).select("doc_id", "_found.*")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"), min_words, max_repeat_percent)
    if bands is None:
        rows = stored(rows, "measures")
        rows = rows.withColumn("fertility_ok", within(found_bands(rows.where(F.col("fertility_ok") & ~failed))))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("fertility_ok"))


def keep_clean(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    bands: Mapping[str, Band] | None = None,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    model: str | None = None,
) -> DataFrame:
    """The documents that pass, with their own columns."""
    rows = spread(packed(docs, text=F.coalesce(F.col(text), F.lit("")), lang=F.col(lang)))
    rows = rows.select("row", measures_udf(bands or BANDS, model)(F.col("text"), F.col("lang")).alias("found"))
    rows = rows.select("row", "found.*")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"), min_words, max_repeat_percent)
    rows = rows.where(F.col("fertility_ok") & ~failed)
    if bands is None:
        # Written once, so texts are split once.
        rows = stored(rows, "measured")
        rows = rows.where(within(found_bands(rows)))
    return unpacked(rows, docs)
