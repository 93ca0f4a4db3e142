"""Phrase places against a plain search, and the labels of the method."""

import re

from folio.llm import licenses as li

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain(text):
    words = WORD.findall((text or "").translate(FOLD))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
TEXTS = [
    "GNU General Public License, GNU general\npublic-license; cc BY. CC-BY!",
    "The MIT License (MIT). mit license mit licenses",
    MIT,
    MIT.replace("any person", "every human"),  # near enough
    MIT.replace("granted", "taken"),  # the key phrase is broken
    "hereby",
    "Licensed under the Apache License, Version 2.0",
    "x" * 50 + " cc by nc",
    "cc bÿ, ccby, cc  é by",
    "cc by " * 500,
]


def test_places_and_labels(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in li.scan(frame).collect()}
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(text)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert got[2]["labels"] == got[3]["labels"] == "mit" and got[2]["score"] == 1.0
    assert got[4]["labels"] == "" and 0 < got[4]["score"] < 1
    assert got[6]["labels"] == "apache" and got[7]["labels"] == "cc-by,cc-by-nc"


def test_odd_rows(odd_docs, odd_rows, no_docs, documents):
    cols = ["n_words", "n_base", "first_word", "last_word", "base_labels"]
    for frame in (odd_docs, documents):
        want = sorted(((r["doc_id"], *plain(r["text"])) for r in frame.collect()), key=str)
        got = sorted(((r["doc_id"], *(r[c] for c in cols)) for r in li.scan(frame).collect()), key=str)
        assert got == want
    assert li.scan(no_docs).count() == 0


def test_key_phrases_lie_in_their_templates():
    for t in li.TEMPLATES:
        assert t.words[t.key_at : t.key_at + len(t.key.split())] == t.key.split()


def test_main_path_is_native(spark, sf_small):
    from folio.llm.queries import QUERIES

    plan = QUERIES["op8_license_scan"](spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_anchors_are_the_rarest_words_of_key_phrases():
    t = (li.Template("x", "the licence of rare words", "of rare words"), li.Template("y", "the the", "the the"))
    assert li.key_anchors({"the": 100, "licence": 5, "of": 90, "words": 7, "rare": 9}, t) == [4, 0]
    assert li.key_anchors({}, t) == [2, 0]


def test_a_reworded_notice_is_found_whatever_the_corpus(spark):
    """The words that were changed are the rarest of the corpus: the places do not depend on them."""
    isc = next(t for t in li.TEMPLATES if t.label == "isc").text
    reworded = isc.replace("distribute", "hand on").replace("hand on", "spread").replace("any purpose", "whatever purpose")
    assert sum(a != b for a, b in zip(isc.split(), reworded.split())) == 2
    filler = " ".join(w for w in isc.split() if w not in ("distribute", "any"))
    texts = [reworded] + [f"{filler[::-1]} {w} to use copy and permission" for w in isc.split() for _ in range(2) if w not in ("distribute", "any")]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in li.scan(frame).collect()}
    assert got[0]["labels"] == "isc" and got[0]["score"] == 11 / 13
    assert all(got[i]["labels"] == "" for i in range(1, len(texts)))


def test_texts_are_read_once(spark, sf_small):
    """Document frequencies and places both come from the written table of occurrences."""
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    plan = li.scan(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan and "regexp_extract_all" not in plan


def test_no_letter_folds_to_a_letter_of_the_templates():
    import sys

    letters = {c for t in li.TEMPLATES for c in t.text}
    assert not [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.lower() in letters]
