"""Word statistics against a plain count, and the verdict's bands."""

import random
import re

from folio.llm import fertility as fe

WORD = re.compile("[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = {}
    for g in grams:
        times[g] = times.get(g, 0) + 1
    inside = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, lines, len(inside), failed


def test_base_equals_plain_counts(documents, odd_docs, no_docs):
    for frame in (documents, odd_docs):
        want = sorted(((r["doc_id"], *plain(r["text"])) for r in frame.collect()), key=str)
        cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        got = fe.measures(frame).collect()
        assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == want
        assert all(r["kept"] == (not r["base_failed"] and r["fertility_ok"]) for r in got)
    assert fe.measures(no_docs).count() == 0
    assert fe.keep_clean(no_docs).count() == 0


def test_many_distinct_words_stay_exact():
    import numpy as np

    codes = np.array([3 << 21, 5, 7, 3 << 21, 5, 7, 9], np.int64)
    assert fe.repeat_words(codes) == 6
    assert fe.repeat_words(codes[:2]) == 0


def test_measures_by_hand():
    table = fe.Fertility()
    words = ["hello", "wörld", "hello", ""]
    codes = table.codes([words])[0]
    tokens, byte_share, entropy = table.measure(codes)
    ids = [i for w in words for i in table.model.encode(w)]
    assert tokens == len(ids)
    assert abs(byte_share - sum(map(table.model.is_byte, ids)) / len(ids)) < 1e-12
    share = [ids.count(i) / len(ids) for i in set(ids)]
    from math import log2

    assert abs(entropy + sum(p * log2(p) for p in share)) < 1e-9


def test_verdict(spark):
    clean = " ".join(random.Random(1).choices("the house of people went to see another film about history and music".split(), k=200))
    noise = " ".join(chr(0xE000 + i % 500) * 3 for i in range(300))  # private use: only byte fallback
    codes = " ".join(f"{i * 7919 % 1000003:x}{i * 104729 % 999983:x}" for i in range(300))
    dull = " ".join(random.Random(2).choices(["hm", "ha"], [1, 1], k=7)) + " " + " ".join(["no"] * 60)
    frame = spark.createDataFrame([(1, clean, "en"), (2, noise, "en"), (3, dull, "en"), (4, codes, None)], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in fe.measures(frame).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}
    assert fe.script_of(["Привет", "мир"]) == "cyrillic" and fe.script_of(["中文"]) == "other"
    strict = {**fe.BANDS, "en": fe.Band(99.0, 100.0, 0.1, 3.5)}
    assert not any(r["kept"] for r in fe.measures(frame.where("doc_id = 1"), bands=strict).collect())


def test_keep_clean_keeps_columns(odd_docs):
    kept = fe.keep_clean(odd_docs)
    assert kept.schema == odd_docs.schema
    ids = {r["doc_id"] for r in fe.measures(odd_docs).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == ids >= {None, 4, 7}
    assert [r["score"] for r in kept.collect()] == [0.5] * kept.count()


def test_bands_follow_the_corpus(spark):
    """Shouted texts split into more tokens than the others of their language."""
    words = "the house of people went to see another film about history and music every morning".split()
    rng = random.Random(3)
    clean = [(i, " ".join(rng.choices(words, k=120)), "en") for i in range(300)]
    shouted = [(1000 + i, " ".join(rng.choices(words, k=120)).upper(), "en") for i in range(30)]
    frame = spark.createDataFrame(clean + shouted, "doc_id long, text string, lang string")
    rows = fe.measures(frame).collect()
    assert not any(r["base_failed"] for r in rows)
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert not kept & {i for i, _, _ in shouted} and len(kept) >= 295
    assert {r["doc_id"] for r in fe.keep_clean(frame).collect()} == kept
    assert fe.measures(frame, bands=fe.BANDS).where("kept").count() == 330


def test_bands_move_without_a_step():
    wide = fe.Band(1.3, 8.0, 0.1, 3.5)
    limits = {"chars_per_token": (2.3, 3.0, 0), "byte_share": (0.0, 0.05, 0), "entropy": (2.0, 9.0, 0)}
    made = [fe.shrunk(wide, limits, n) for n in (0, 99, 100, 101, 10**9)]
    assert made[0] == wide and abs(made[4].min_chars_per_token - 2.3) < 1e-6 and abs(made[4].max_byte_share - 0.05) < 1e-6
    assert all(m.min_entropy == 3.5 for m in made)  # a looser limit found in the corpus does not widen the band
    for a, b in zip(made[1:3], made[2:4]):
        assert a.min_chars_per_token < b.min_chars_per_token < a.min_chars_per_token + 0.01
        assert a.max_chars_per_token > b.max_chars_per_token > a.max_chars_per_token - 0.05


def test_one_document_more_changes_no_verdict(spark):
    """The same texts with 99, 100 and 101 documents of their language."""
    words = "the house of people went to see another film about history and music every morning".split()
    rng = random.Random(8)
    clean = [(i, " ".join(rng.choices(words, k=120)), "en") for i in range(99)]
    shouted = [(1000 + i, " ".join(rng.choices(words, k=120)).upper(), "en") for i in range(5)]
    more = [(500 + i, " ".join(rng.choices(words, k=120)), "en") for i in range(2)]
    frames = [spark.createDataFrame(clean[: 94 + 5] + shouted + more[:k], "doc_id long, text string, lang string") for k in range(3)]
    kept = [{r["doc_id"] for r in fe.measures(f).where("kept").collect()} for f in frames]
    assert kept[0] == kept[1] - {500} == kept[2] - {500, 501} and not kept[0] & {i for i, _, _ in shouted}
