"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, spread

#: Word of the whitespace-separated contracts: a run of anything but space and \t..\r (fixed value).
WORD = "[^\x20\x09-\x0D]+"
#: The same as a Java regular expression.
WORD_JAVA = r"[^\x20\x09-\x0D]+"
#: Characters per slice of a batch that a Python task holds at once.
SLICE_CHARS = 2_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(docs: DataFrame, *cols: str, text: str = "text") -> DataFrame:
    """The named columns and the text (null: empty), spread over the cores if it has few splits."""
    return spread(docs.select(*cols, F.coalesce(F.col(text), F.lit("")).alias("text")))


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``row`` (all columns of ``docs`` as one struct) and the named columns: no name can clash."""
    names = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*names).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of ``row``."""
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read back.

    The files cut the lineage (a lost executor does not recompute it) and fix what depends on
    the order of rows or on partition numbers. ``options`` go to the Parquet writer.
    """
    spark = df.sparkSession
    path = shared_path(spark, "llm", spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables written by :func:`stored` that nothing reads any more (a later one replaced them)."""
    for table in tables:
        spark = table.sparkSession
        for path in {p.rsplit("/", 1)[0] for p in table.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[slice]:
    """Slices of a batch with about ``limit`` characters each (one longer text is a slice of its own)."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(t) + 64
    if begin < len(texts):
        yield slice(begin, len(texts))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (xor-shift and multiply rounds); fixed multipliers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))
