"""Token counts without ids: pieces per distinct pre-token, joined to per-document frequencies.

A pre-token is a run of spaces with the characters up to the next space. No piece of the
vocabulary has a word mark after another character, so no merge crosses the start of such a run,
and the pieces of a text are the sum over its pre-tokens. Each task works in slices of bounded
size: it counts the pre-tokens of each document, counts the pieces of each distinct pre-token
once, looks the frequencies up in that table and sums. The table is kept between slices up to a
fixed number of entries. Nothing is shuffled, and no array of ids leaves the tokenizer call of a
distinct pre-token. (A table of pre-tokens for the whole corpus would have to be shuffled and
joined against every document's rare words, which moves more bytes than the documents have.)

Defined results: a null or empty text has 0 bytes and 0 tokens; a null id is kept; repeated rows
are counted each; a text of any length is counted whole; an empty table gives no rows; other
columns of the documents are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import narrow, slices

LIMIT = 4096
TABLE_ENTRIES = 250_000
LONGEST_KEPT = 64
_RUN = re.compile(" +[^ ]+| +\\Z")
_MARK = "▁"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, each without its first space (the library puts one in front)."""
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return [run[1:] for run in _RUN.findall(" " + text)]


class PieceTable:
    """Pieces of each distinct pre-token, counted once."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        self.pieces: dict[str, int] = {}

    def learn(self, wanted: set[str]) -> None:
        if len(self.pieces) > TABLE_ENTRIES:
            self.pieces.clear()
        new = [p for p in wanted if p not in self.pieces]
        self.pieces.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
        self.pieces[""] = 1  # a single space at the end of a text: its mark alone

    def forget_long(self, wanted: set[str]) -> None:
        for p in wanted:
            if len(p) > LONGEST_KEPT:
                self.pieces.pop(p, None)

    def whole(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))


def count_slice(table: PieceTable, texts: list[str]) -> list[int]:
    # A literal word mark in the text reads as a space to the library: such texts go to it whole.
    frequencies = [None if not t or _MARK in t else Counter(pretokens(t)) for t in texts]
    wanted = set().union(*(f for f in frequencies if f))
    table.learn(wanted)
    get = table.pieces.__getitem__
    out = []
    for t, f in zip(texts, frequencies):
        out.append(table.whole(t) if f is None else sum(n * k for n, k in zip(map(get, f), f.values())))
    table.forget_long(wanted)
    return out


def token_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, model: str | None = None
) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` of each document."""
    rows = narrow(docs, F.col(doc_id).alias("doc_id"), text=text)
    schema = T.StructType(
        [rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = PieceTable(model)
        for batch in batches:
            texts = batch["text"].tolist()
            counts: list[int] = []
            for part in slices(texts):
                counts += count_slice(table, texts[part])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": counts})

    counted = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInPandas(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
