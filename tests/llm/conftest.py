"""Small tables with everything that the operators must survive."""

import random

import pytest

LONG = " ".join(f"wort{i % 977}" for i in range(30_000))
PLAIN = "house river people window garden letter summer morning teacher doctor island market winter bridge village station paper kitchen minute country".split()
CLEAN = " ".join(random.Random(0).choices(PLAIN, k=160))


@pytest.fixture(scope="session")
def odd_rows():
    """doc_id, text, lang, source: nulls, empty and white-space texts, a very long one, repeated rows."""
    return [
        (1, "", "en", "a"),
        (2, None, None, None),
        (None, CLEAN + " with a null id", "en", "b"),
        (3, LONG, "de", "a"),
        (4, CLEAN, "en", None),
        (4, CLEAN, "en", None),
        (5, " \t\n ", "xx", ""),
        (6, "😀 <|endoftext|> </s>[INST] a　b c \x1c\\ %", "en", "b"),
        (7, CLEAN, "en", "b"),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with further columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, row int, node string, score double, _id long, n_tokens long, found int, `a.b` int"
    return spark.createDataFrame([(*r, 1, "n", 0.5, 9, 8, 7, 6) for r in odd_rows], schema)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


@pytest.fixture(scope="session")
def documents(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")
