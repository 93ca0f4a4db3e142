"""Sum-of-squares online packing of documents into token windows.

Every scan task tokenises its documents and packs them as they come; no row is shuffled. A
document's whole windows are emitted at once. Its rest goes to the fill level that minimises the
sum over levels of (number of partially filled windows at that level) squared. The counts live
in a level array, so one placement costs one pass over at most ``window`` counters. Memory is
bounded: when more than ``max_open`` windows are open, and at the end of the task, the emptiest
windows are cut and poured into the fullest ones. What is left at the end of a task (less than
one window) is cut into sequences whose lengths are powers of two, which need no padding.

Sequence ids are ``partition << 40 | number``: unique, and the same when a lost task runs again
over the same split.

Defined results: a null or empty text is a document of one token, the end id; a null id is kept;
repeated rows are documents of their own; a text of any length is cut into whole windows and a
rest; an empty table gives no rows; other columns of the documents are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import narrow, slices

WINDOW = 2048
END_ID = 1
MAX_OPEN = 256
TABLE_ENTRIES = 250_000
LONGEST_KEPT = 64
#: White space with the word after it: byte-level pre-tokens never reach over such a start.
_PART = re.compile(r"\s*\S+|\s+\Z")
#: Characters that Python takes for white space and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteIds:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, tokenised once per distinct part.

    Parts go to the vocabulary's rank form, which is several times faster on short strings; texts
    with special strings or odd white space go to the tokenizer whole. Both give the same ids.
    """

    def __init__(self, path: str | None = None, ranks: str | None = None):
        import base64
        import os

        import public_tokenizers
        import tiktoken

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks or tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.parts = tiktoken.Encoding(
            "byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}
        )
        self.table: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.table) > TABLE_ENTRIES:
            self.table.clear()
        parts = [None if _ODD.search(t) or any(s in t for s in self.special) else _PART.findall(t) for t in texts]
        new = set().union(*(p for p in parts if p)).difference(self.table)
        for p in new:
            self.table[p] = array("I", self.parts.encode_ordinary(p)).tobytes()
        get = self.table.__getitem__
        out = [self.whole(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts)]
        for p in new:
            if len(p) > LONGEST_KEPT:
                del self.table[p]
        return out


class SumOfSquares:
    """Open windows by fill level. A piece is (document, start, ids as bytes); ``done`` holds closed windows."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.level = np.zeros(window + 1, np.int64)  # open windows at each fill level
        self.at: dict[int, list[list]] = {}
        self.done: list[list] = []

    def add(self, doc, ids: bytes) -> None:
        tokens, cut = len(ids) // 4, len(ids) // 4 // self.window * self.window
        for start in range(0, cut, self.window):
            self.done.append([(doc, start, ids[4 * start : 4 * (start + self.window)])])
        if cut < tokens:
            self._place((doc, cut, ids[4 * cut :]), tokens - cut)
            if self.level.sum() > self.max_open:
                self._pour(self.max_open // 2)

    def _place(self, piece, size: int) -> None:
        level, window = self.level, self.window
        held = np.flatnonzero(level[1 : window - size + 1]) + 1
        best, least = 0, 2 * level[size] + 1  # a new window
        if len(held):
            after = held + size
            # Change of the sum of squares; a full window leaves the array.
            change = np.where(after == window, 1 - 2 * level[held], 2 * (level[after] - level[held]) + 2)
            k = len(held) - 1 - int(np.argmin(change[::-1]))  # ties: the fullest
            if change[k] <= least:
                best = int(held[k])
        pieces = self._take(best) if best else []
        pieces.append(piece)
        self._put(best + size, pieces)

    def _take(self, fill: int) -> list:
        self.level[fill] -= 1
        return self.at[fill].pop()

    def _put(self, fill: int, pieces: list) -> None:
        if fill == self.window:
            self.done.append(pieces)
        elif fill:
            self.level[fill] += 1
            self.at.setdefault(fill, []).append(pieces)

    def _pour(self, keep: int) -> None:
        """Cut the emptiest windows into the fullest until at most ``keep`` are open."""
        while self.level.sum() > keep:
            held = np.flatnonzero(self.level)
            low, high = int(held[0]), int(held[-1])
            source, target = self._take(low), self._take(high)
            while high < self.window and source:
                doc, start, ids = source.pop()
                room, size = self.window - high, len(ids) // 4
                if size > room:  # the last tokens of the piece move; its first stay
                    source.append((doc, start, ids[: 4 * (size - room)]))
                    start, ids, size = start + size - room, ids[4 * (size - room) :], room
                target.append((doc, start, ids))
                high, low = high + size, low - size
            self._put(high, target)
            self._put(low, source)

    def close(self) -> None:
        """Close everything: full windows, then the rest in lengths that are powers of two."""
        self._pour(1)
        if not self.level.any():
            return
        rest = self._take(int(np.flatnonzero(self.level)[0]))
        left = sum(len(ids) // 4 for _, _, ids in rest)
        while left:
            room, part = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc, start, ids = rest.pop()
                take = min(room, len(ids) // 4)
                part.append((doc, start, ids[: 4 * take]))
                if 4 * take < len(ids):
                    rest.append((doc, start + take, ids[4 * take :]))
                room -= take
            self.done.append(part)


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    max_open: int = MAX_OPEN,
    tokenizer: str | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``offset``
    and ``ids`` (binary, little-endian unsigned 32-bit)."""
    rows = narrow(docs, F.col(doc_id).alias("doc_id"), text=text)
    names = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType(
        [rows.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in names), T.StructField("ids", T.BinaryType())]
    )
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, packer = ByteIds(tokenizer), SumOfSquares(window, max_open)
        first, number = TaskContext.get().partitionId() << 40, 0

        def flush() -> pd.DataFrame:
            nonlocal number
            out = []
            for pieces in packer.done:
                offset = 0
                for (key, tokens), start, ids in pieces:
                    out.append((key, start, len(ids) // 4, tokens, first + number, offset, ids))
                    offset += len(ids) // 4
                number += 1
            packer.done.clear()
            frame = pd.DataFrame(out, columns=["doc_id", *names, "ids"])
            frame["doc_id"] = pd.array(frame["doc_id"].tolist(), dtype=keys) if keys else frame["doc_id"]
            return frame

        keys = None
        for batch in batches:
            batch_keys, texts = batch["doc_id"], batch["text"].tolist()
            if batch_keys.dtype.kind in "if":  # a column with nulls arrives as floats
                keys = "Int64"
                batch_keys = batch_keys.astype("Int64")
            batch_keys = [None if k is pd.NA else k for k in batch_keys.tolist()]
            for part in slices(texts):
                for key, ids in zip(batch_keys[part], encoder.encode(texts[part])):
                    packer.add((key, len(ids) // 4 + 1), ids + end)
                yield flush()
        packer.close()
        yield flush()

    return rows.mapInPandas(run, schema)
