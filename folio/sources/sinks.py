"""Sinks (S11-S13): results by run identity, plain text, CSV export."""

from __future__ import annotations

import urllib.parse
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RESULT_ROW

PARTITIONS = ("doc", "prompt_version", "model", "run_ts")
RUN_PARTITIONS = ("doc", "prompt_version", "model")


#: A folder cannot be named by an empty text: it is written as this mark, and texts that begin with
#: the mark get another one.
EMPTY_MARK = "~"


def encode_identity(c: Column) -> Column:
    """Run identity as a folder name: reversible, NULL and empty text stay apart."""
    return F.when((c == "") | c.startswith(EMPTY_MARK), F.concat(F.lit(EMPTY_MARK), c)).otherwise(c)


def decode_identity(df: DataFrame, cols) -> DataFrame:
    """Marked folder names back to texts.

    Only when there are any, so that filters usually stay on the bare partition columns; looking
    for them prunes partitions, and without marked folders it reads no file.
    """
    marked = [F.col(c).startswith(EMPTY_MARK) for c in cols]
    if not cols or df.select(*cols).where(reduce(or_, marked)).isEmpty():
        return df
    return df.withColumns({c: F.when(m, F.substr(F.col(c), F.lit(2))).otherwise(F.col(c)) for c, m in zip(cols, marked)})


def _encoded(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: encode_identity(F.col(c).cast("string")) for c in cols})


#: Rows of a run file, at most: cells hold line ends, so one task reads a file from its first row to its last.
ROWS_PER_FILE = 100_000


def _csv(writer):
    # Cells may hold newlines, commas and quotes: quote them and double inner quotes. Spark's
    # CSV writer trims leading / trailing spaces of values by default; answers keep theirs.
    return (
        writer.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", ROWS_PER_FILE)
    )


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """One directory per run identity (doc / prompt version / model / run time).

    Readers prune partitions on these columns instead of parsing file names. The rows are
    rebalanced by run identity: a run that holds most rows is split over many tasks, and small
    runs share one, so a run gets few files of good size instead of one per task.
    """
    cols = [c for c in PARTITIONS if c in df.columns]
    _encoded(df, cols).hint("rebalance", *[F.col(c) for c in cols]).write.mode(mode).partitionBy(*cols).parquet(path)


def write_run_files(df: DataFrame, path: str, partition_by=RUN_PARTITIONS, mode: str = "overwrite") -> None:
    """S11 in the run-file dialect: a CSV folder per run identity, result columns in M8 order.

    Every run folder holds the same columns in the same order, missing ones empty.
    The run identity is in the folder names (``doc=…/prompt_version=…/model=…``) rather than in
    a file name; :func:`folio.sources.experiments.read_run_files` reads every run in one scan.
    Rows are rebalanced by run, as in :func:`write_results`: few files per run, a large run over many tasks.
    """
    parts = [c for c in partition_by if c in df.columns]
    # Every M8 column is written (NULL where the input lacks it), so the file layout is fixed.
    data = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in RESULT_ROW.fields
        if f.name not in parts
    ]
    rows = _encoded(df.select(*data, *parts), parts).hint("rebalance", *[F.col(c) for c in parts])
    _csv(rows.write.mode(mode).partitionBy(*parts)).csv(path)


def write_run_csv(df: DataFrame, path: str, name_col: str = "run_name") -> list[str]:
    """Run files named as runs are: ``<run>.csv``, or ``<run>_1.csv``, ``<run>_2.csv`` ... where a run fills several.

    ``name_col`` (not written) is the run's name, e.g. from :func:`folio.operators.experiment.run_name`. The rows are
    written below a folder that readers skip and the finished files are renamed, so a run is never read half
    written. Returns the files.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    named = df.withColumnRenamed(name_col, "_run").hint("rebalance", F.col("_run"))
    _csv(named.write.partitionBy("_run")).csv(staged)
    made = []
    for folder in sorted(str(s.getPath()) for s in store.globStatus(hadoop.Path(f"{staged}/_run=*")) or []):
        parts = sorted(str(s.getPath()) for s in store.globStatus(hadoop.Path(f"{folder}/part-*")))
        name = urllib.parse.unquote(folder.rsplit("_run=", 1)[1])
        for k, part in enumerate(parts):
            target = f"{path}/{name}.csv" if len(parts) == 1 else f"{path}/{name}_{k + 1}.csv"
            store.delete(hadoop.Path(target), False)  # the run's earlier file, if any
            if not store.rename(hadoop.Path(part), hadoop.Path(target)):
                raise OSError(f"cannot rename {part} to {target}")
            # A local store leaves the checksum of a file beside it; a folder of runs holds the runs.
            store.delete(hadoop.Path(f"{path}/.{target.rsplit('/', 1)[1]}.crc"), False)
            made.append(target)
    store.delete(hadoop.Path(staged), True)
    return made


def write_text(df: DataFrame, text_col: str, path: str) -> None:
    """One line per row (bullet lines, extracted texts). Line ends inside a text are escaped
    with a backslash, so a text of many lines is still one record; see :func:`read_text`."""
    text = F.replace(F.col(text_col).cast("string"), F.lit("\\"), F.lit("\\\\"))
    text = F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    df.select(text.alias("value")).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """The texts of :func:`write_text` as ``value``."""
    parts = F.split(F.col("value"), r"\\\\", -1)  # between two backslashes: a backslash
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return spark.read.text(path).select(F.array_join(plain, "\\").alias("value"))
