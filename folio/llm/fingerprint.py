"""Quartile bucket digests of whole texts, and a bounded difference between two digests.

A five-byte window runs over the UTF-8 bytes; six triplets of each window that hold its newest
byte are hashed into 128 buckets. The digest keeps, per bucket, the quartile of its count (two
bits), plus the logarithm of the length and the ratios of the quartiles. Two digests differ by
the sum over buckets of the quartile distance (three quartiles apart counts double), plus the
differences of length and ratios; the sum is bounded, and likeness is one minus its share of the
bound.

:func:`next_documents` pairs every document with the next one in descending id order without a
global window: ids are cut into blocks of fixed width, a window runs inside each block, and the
first document of each block is copied into the block before it (the first of all into the last
block). Texts are shuffled once, as long as the table of blocks (two numbers per 1,024 ids) is
small enough to be broadcast under the session's threshold; beyond it they are shuffled twice.

Defined results: a null or empty text has the digest of no bytes; equal texts have equal digests;
texts of any length are read whole; a null id comes last; rows that share an id follow each other
in text order; a single document is its own next; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import mix64, narrow, stored

BUCKETS = 128
#: Offsets back from the newest byte of the window of the two other bytes of each triplet.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
WINDOW = 5
#: A difference of this size or more is a likeness of 0.
BOUND = 300
#: Weight of one step of length (a tenth) and of one step of a quartile ratio, and their largest steps.
LENGTH_WEIGHT, LENGTH_STEPS, RATIO_WEIGHT = 2, 40, 2
#: Ids per block of :func:`next_documents`, and blocks per block of blocks.
BLOCK, BLOCKS = 1024, 4096
_LAST = -(2**62)  # the block of null ids


def _tables() -> np.ndarray:
    """Seven-bit hash tables [triplet, byte of the triplet, value], from a fixed mixing rule."""
    n = len(TRIPLETS) * 3 * 256
    return (mix64(np.arange(1, n + 1, dtype=np.uint64)) & np.uint64(BUCKETS - 1)).astype(np.uint8).reshape(-1, 3, 256)


_HASH = _tables()


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of the hashed triplets of all windows."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - WINDOW + 1
    if n <= 0:
        return np.zeros(BUCKETS, np.int64)
    newest = b[WINDOW - 1 :]
    counts = np.zeros(BUCKETS, np.int64)
    for (i, j), (t0, t1, t2) in zip(TRIPLETS, _HASH):
        hashed = t0[newest] ^ t1[b[WINDOW - 1 - i : len(b) - i]] ^ t2[b[WINDOW - 1 - j : len(b) - j]]
        counts += np.bincount(hashed, minlength=BUCKETS)
    return counts


def digest(text: str) -> str:
    """Hexadecimal: length (2 digits), quartile ratios (2), quartile codes (64)."""
    data = text.encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    order = np.sort(counts)
    q1, q2, q3 = (int(order[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    length = min(255, int(np.log1p(len(data)) / np.log(1.1)))
    ratios = [15 * q // q3 if q3 else 0 for q in (q1, q2)]
    return f"{length:02x}{ratios[0]:x}{ratios[1]:x}{packed.astype(np.uint8).tobytes().hex()}"


def _byte_differences() -> np.ndarray:
    """Difference of two packed bytes (four quartile codes each)."""
    codes = np.arange(256)[:, None] >> np.array([6, 4, 2, 0]) & 3
    steps = np.abs(codes[:, None, :] - codes[None, :, :])
    return np.where(steps == 3, 6, steps).sum(axis=2).astype(np.uint8)


_DIFFERENCE = _byte_differences()


def difference(a: list[str], b: list[str]) -> np.ndarray:
    """Unbounded difference of digests, pair by pair."""
    x, y = (np.frombuffer(bytes.fromhex("".join(d)), np.uint8).reshape(len(d), -1) for d in (a, b))
    length = np.minimum(np.abs(x[:, 0].astype(int) - y[:, 0]), LENGTH_STEPS) * LENGTH_WEIGHT
    ratio = np.abs((x[:, 1] >> 4).astype(int) - (y[:, 1] >> 4)) + np.abs((x[:, 1] & 15).astype(int) - (y[:, 1] & 15))
    return _DIFFERENCE[x[:, 2:], y[:, 2:]].sum(axis=1, dtype=int) + length + ratio * RATIO_WEIGHT


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 for equal digests, 0 at the bound and beyond."""
    return 1.0 - np.minimum(difference(a, b), BOUND) / BOUND if len(a) else np.zeros(0)


def digest_udf():
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(t) for t in texts], index=texts.index, dtype=object)

    return run.asNondeterministic()  # evaluated once per row


def _comparison_udf():
    @F.pandas_udf("edited_fingerprint string, near_edited double, near_next double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for edited, own, after in batches:
            made, own = [digest(t) for t in edited], own.tolist()
            yield pd.DataFrame(
                {
                    "edited_fingerprint": pd.Series(made, dtype=object),
                    "near_edited": likeness(own, made),
                    "near_next": likeness(own, after.tolist()),
                }
            )

    return run.asNondeterministic()


def _block_of(doc_id: Column) -> Column:
    return F.coalesce(F.floor(doc_id / BLOCK), F.lit(_LAST))


def _copies(ids: DataFrame) -> DataFrame:
    """``_first`` (first id of a block) and ``_home`` (the block before it, which gets a copy)."""
    blocks = ids.groupBy(_block_of(F.col("doc_id")).alias("_block")).agg(F.max("doc_id").alias("_first"))
    blocks = blocks.withColumn("_group", F.floor(F.col("_block") / BLOCKS))
    inside = Window.partitionBy("_group").orderBy(F.col("_block").desc())
    blocks = blocks.withColumn("_before", F.lag("_block").over(inside))
    # One row per group of blocks: the only window over everything.
    groups = blocks.groupBy("_group").agg(F.min("_block").alias("_end"))
    groups = groups.select(
        "_group",
        F.coalesce(
            F.lag("_end").over(Window.orderBy(F.col("_group").desc())), F.min("_end").over(Window.partitionBy())
        ).alias("_end_before"),
    )
    return blocks.join(groups, "_group").select(
        F.col("_first"), F.coalesce("_before", "_end_before").alias("_home")
    )


def next_documents(rows: DataFrame, *carried: str) -> DataFrame:
    """``rows`` (doc_id, text, ...) with ``next_<column>`` of the next document for each carried column."""
    # Written, so that its size is known when the join is planned: below the session's broadcast
    # threshold the texts stay where they are; an estimate would have shuffled them once more.
    copies = stored(_copies(rows.select("doc_id")), "block-starts")
    own = F.struct(_block_of(F.col("doc_id")).alias("at"), F.lit(False).alias("copy"))
    other = F.struct(F.col("_home").alias("at"), F.lit(True).alias("copy"))
    placed = rows.join(copies, F.col("doc_id").eqNullSafe(F.col("_first")), "left").withColumn(
        "_place", F.explode(F.when(F.col("_home").isNull(), F.array(own)).otherwise(F.array(own, other)))
    )
    order = Window.partitionBy("_place.at").orderBy(
        F.col("_place.copy"), F.col("doc_id").desc_nulls_last(), F.col("text")
    )
    led = placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return led.where(~F.col("_place.copy")).drop("_place", "_first", "_home")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of every text, of the text edited with its next document, and both likenesses."""
    rows = narrow(docs, F.col(doc_id).alias("doc_id"), text=text).withColumn(
        "fingerprint", digest_udf()(F.col("text"))
    )
    paired = next_documents(rows, "text", "fingerprint").withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substr("next_text", F.lit(1), half)
    )
    made = paired.select("doc_id", "n_chars", "fingerprint", "next_fingerprint", edited.alias("_edited"))
    made = made.withColumn("_c", _comparison_udf()(F.col("_edited"), F.col("fingerprint"), F.col("next_fingerprint")))
    return made.select(
        "doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "_c.*"
    )
