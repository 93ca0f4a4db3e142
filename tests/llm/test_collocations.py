"""Phrases against plain counting; tiles, salts, ranks and the filter on their own."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import collocations as C


def plain_phrases(rows, min_count=10, cover=50, top=2000):
    """All phrases by dictionaries: rows of (lang, text)."""
    counts, sizes = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            ws = re.findall("[^\x20\x09]+", piece)
            sizes[lang] = sizes.get(lang, 0) + len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    g = (lang, *ws[i : i + k])
                    counts[g] = counts.get(g, 0) + 1
    found = {}
    for (lang, *g), a in counts.items():
        if len(g) > 1 and a >= min_count:
            cuts = []
            for k in range(1, len(g)):
                left, right = counts[(lang, *g[:k])], counts[(lang, *g[k:])]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            found[(lang, *g)] = (a, *min(cuts))
    out = []
    for lang in sizes:
        mine = []
        for (of, *g), (a, score, _, left, right) in found.items():
            longer = [v[0] for (o, *h), v in found.items() if of == o == lang and len(h) > len(g) and (h[:2] == g or h[1:] == g)]
            if of == lang and not any(100 * n >= cover * a for n in longer):
                mine.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, r + 1, p.decode(), -a, left, right, sizes[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(mine)[:top])]
    return sorted(out)


def _found(df, **more):
    got = C.phrases(df, **more)
    return sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = [f"W{i}" if i % 7 == 0 else f"w{i}é" for i in range(60)]
    out = []
    for i in range(160):
        text = "".join(rng.choices(words, [1 / (j + 1) for j in range(60)])[0] + rng.choice([" ", " ", " ", "\t", ", ", "\n", "  "]) for _ in range(60))
        out.append((rng.choice(["en", "de", None, "und", ""]), text + ("New York City hall" if i % 3 else "new york")))
    out += [("en", "copy of one text") for _ in range(400)]  # a large group of equal rows
    return out


def test_equals_plain_counting(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string")
    want = plain_phrases(rows)
    assert len(want) > 80 and any(w[2] == "new york city" for w in want) and any(len(w[2].split()) == 2 for w in want)
    assert _found(df) == want
    assert _found(df.repartition(7), top=5, min_count=12, cover_percent=80) == plain_phrases(rows, 12, 80, 5)


def test_small_chunks_tiles_and_buckets_change_nothing(spark, rows, monkeypatch):
    for name, value in {"CHUNK_BYTES": 3000, "HELD_BYTES": 5000, "HELD_PAIRS": 400, "SIDE": 4, "DENSE_TILES": 3, "FILTER_BITS": 64, "SALTS": 3}.items():
        monkeypatch.setattr(C, name, value)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(9)
    assert _found(df) == plain_phrases(rows)


def test_odd_rows(spark, odd_docs, no_docs, odd_rows):
    assert _found(odd_docs) == plain_phrases([(r[2], r[1]) for r in odd_rows])
    assert C.phrases(no_docs).count() == 0
    nothing = spark.createDataFrame([("en", None), ("en", " ,;\n"), (None, "")], "lang string, text string")
    assert C.phrases(nothing).count() == 0


def test_words_and_pieces():
    words = [w for w in C.words("Ab\tÄB c\x1cd,e..f\x0bg\r\n h".encode()) if w]
    assert [w.decode() if w != b"\xff" else "|" for w in words] == ["ab", "ÄB", "c\x1cd", "|", "e", "|", "|", "f", "|", "g", "|", "|", " h"]


def test_ranks_are_places(spark):
    df = spark.range(5000).select(F.concat(F.lit("l"), F.col("id") % 3).alias("lang"), (F.col("id") % 17).alias("f"), F.col("id").cast("string").alias("word"))
    got = C._ranks(df, "word").collect()
    for lang in ("l0", "l1", "l2"):
        mine = sorted((r for r in got if r.lang == lang), key=lambda r: (-r.f, r.word))
        assert [r["rank"] for r in mine] == list(range(len(mine)))


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 987_654_321_987, 998_877_665_544_332, 999_999_999_999_937
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(C._score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 1_000_000 * a * a // (left * right)


def test_packing_reverses():
    for n in (0, 1, 1000):
        numbers = np.arange(n, dtype=np.int64) * 7
        assert list(C._unpack(C._pack(numbers), np.int64)) == list(numbers)
