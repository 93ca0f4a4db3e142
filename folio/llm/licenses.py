"""Licence scan with a positional rare-token index (DataFrame functions only).

The index is a table of postings (word, template, position) of a fixed set of licence templates.

1. One pass over the texts keeps, per document, its number of words and every occurrence (position and
   word) of a word of the index. That narrow table is written to the shared folder; texts are read
   once and never shuffled.
2. Document frequencies of the index's words come from that table.
3. Each file looks up its own words: its ``TOP_WORDS`` highest-IDF licence words, and, for each template all
   of whose mandatory key phrase's words the file holds, the rarest word of that phrase. An occurrence meets its
   postings on the word; the position in the text minus the position in the template is where the template
   would begin.
4. Occurrences around it that stand at the same relative position in the template are counted. A place
   counts when enough of the template matches and every word of its key phrase does. A place that
   counts holds the whole key phrase, so step 3 finds every one of them.

The score is the best coverage over the places that hold their key phrase or were reached by one of the file's
highest-IDF words. The postings are a constant table, so broadcasting them is safe.

Defined results: a null or empty text has no words and no labels; a null id is kept; repeated rows
are scanned each (rows carry a number of their own); whole texts are read; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from ._common import stored

#: Words of a text whose A-Z are lower-cased: runs of 0-9, a-z and everything beyond ASCII
#: (fixed value; A-Z are in the class because the case is folded afterwards).
WORD_JAVA = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A licence text (lower-case words), its label and its mandatory key phrase."""

    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key.split()
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def _base(label: str, phrase: str) -> Template:
    return Template(label, phrase, phrase, base=True)


#: The base phrases, and wordings of public licences and their notices.
TEMPLATES: tuple[Template, ...] = (
    _base("gpl", "gnu general public license"),
    _base("apache", "apache license"),
    _base("cc-by", "cc by"),
    _base("mit", "mit license"),
    Template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    Template("lgpl", "gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license", "gnu affero general public license"),
    Template("apache", "licensed under the apache license version 2 0", "apache license version"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use"),
    Template("bsd", "bsd license", "bsd license"),
    Template("mpl", "mozilla public license", "mozilla public license"),
    Template("epl", "eclipse public license", "eclipse public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0"),
    Template("cc-by-sa", "cc by sa", "cc by sa"),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd", "cc by nd"),
    Template("cc-by", "creative commons attribution", "creative commons attribution"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
)
#: A file's highest-IDF licence words that are looked up besides the key phrases.
TOP_WORDS = 2
MIN_COVERAGE = 0.8


def words_of(text: Column) -> Column:
    """The words, in lower case (folded once per text; no word of the templates holds a letter that another folds to)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_JAVA), F.lit(0))


def key_anchors(frequencies: dict[str, int], templates: Sequence[Template]) -> list[int]:
    """Per template the position of its key phrase's rarest word (of equal ones the first)."""
    spans = [range(t.key_at, t.key_at + len(t.key.split())) for t in templates]
    return [min(s, key=lambda i: (frequencies.get(t.words[i], 0), i)) for t, s in zip(templates, spans)]


def _postings(spark: SparkSession, templates: Sequence[Template], at: list[int]) -> DataFrame:
    rows = [
        (w, i, j, j == at[i], t.words, t.label, t.base, t.key_at, t.key_at + len(t.key.split()))
        for i, t in enumerate(templates)
        for j, w in enumerate(t.words)
    ]
    return spark.createDataFrame(
        rows,
        "word string, template int, j int, is_key boolean, wording array<string>, label string, base boolean, key_from int, key_to int",
    )


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    templates: Sequence[Template] = TEMPLATES,
    min_coverage: float = MIN_COVERAGE,
) -> DataFrame:
    """Per document: words, places of the base phrases, labels and the best coverage."""
    spark = docs.sparkSession
    docs = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    vocabulary = sorted({w for t in templates for w in t.words})
    # Words of the index only become structs; the array of words is staged, as it is referred to twice.
    found = F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("pos"), w.alias("word"))))
    read = docs.select("doc_id", words_of(F.col("text")).alias("words")).select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.filter(found, lambda x: x.isNotNull()).alias("hits"),
    )
    scanned = stored(read, "licence-words")

    known = F.array_distinct(F.transform("hits", lambda x: x["word"]))
    each = scanned.select(F.explode(known).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    # At most one row per word of the templates reaches the driver.
    frequencies = {r["word"]: r["df"] for r in each.collect()}
    at = key_anchors(frequencies, templates)
    postings = _postings(spark, templates, at)
    reach = max(len(t.words) for t in templates)

    df_of = F.create_map(*[F.lit(x) for w in vocabulary for x in (w, frequencies.get(w, 0))])
    by_idf = F.array_sort(F.transform("known", lambda w: F.struct(F.element_at(df_of, w).alias("df"), w.alias("word"))))
    keys = F.array(*[
        F.struct(F.lit(i).alias("template"), F.array(*[F.lit(w) for w in t.key.split()]).alias("key"), F.lit(t.words[at[i]]).alias("word"))
        for i, t in enumerate(templates)
    ])
    able = F.filter(keys, lambda t: F.size(F.array_except(t["key"], F.col("known"))) == 0)
    files = (
        scanned.where(F.size("hits") > 0)
        .select("row", "hits", known.alias("known"))
        .withColumns({"top": F.transform(F.slice(by_idf, 1, TOP_WORDS), lambda x: x["word"]), "able": able})
        .withColumn("able_words", F.transform("able", lambda t: t["word"]))
        .withColumn("able", F.transform("able", lambda t: t["template"]))
    )
    spots = F.filter(
        F.transform(
            "hits",
            lambda x, i: F.when(
                F.array_contains("top", x["word"]) | F.array_contains("able_words", x["word"]),
                F.struct(
                    x["pos"].alias("pos"),
                    x["word"].alias("word"),
                    # The occurrences within reach are among as many entries before and after this one.
                    F.slice("hits", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1)).alias("around"),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    begun = files.select("row", "top", "able", F.explode(spots).alias("hit")).join(F.broadcast(postings), F.col("hit.word") == F.col("word"))
    by_top = F.array_contains("top", F.col("word"))
    by_key = F.col("is_key") & F.array_contains("able", F.col("template"))
    begun = begun.where(by_top | by_key).withColumns({"start": F.col("hit.pos") - F.col("j"), "by_top": by_top, "by_key": by_key})
    # Words of the text that stand where the template has them.
    same = F.filter(
        F.transform("hit.around", lambda x: F.when(F.get(F.col("wording"), x["pos"] - F.col("start")) == x["word"], x["pos"] - F.col("start"))),
        lambda k: k.isNotNull(),
    )
    in_key = F.filter("same", lambda k: (k >= F.col("key_from")) & (k < F.col("key_to")))
    places = (
        begun.withColumn("same", same)
        .select(
            "row",
            "start",
            "label",
            "base",
            "by_top",
            "by_key",
            (F.size("same") / F.size("wording")).alias("coverage"),
            (F.size(in_key) == F.col("key_to") - F.col("key_from")).alias("key_found"),
        )
    )
    # Every place that counts is reached by its key anchor, and by that once: these rows are its only ones.
    base = F.col("base") & (F.col("coverage") == 1) & F.col("by_key")
    accepted = F.when(F.col("base"), base).otherwise((F.col("coverage") >= min_coverage) & F.col("key_found"))
    found = places.groupBy("row").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(accepted, F.col("label")))), ",").alias("labels"),
        F.max(F.when(F.col("by_top") | F.col("key_found"), F.col("coverage"))).alias("score"),
    )
    return (
        scanned.drop("hits")
        .join(found, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            "first_word",
            "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"),
            F.coalesce("labels", F.lit("")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )
