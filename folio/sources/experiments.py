"""Run files (S2-S4): read every run, union by name, keep the known columns, newest first."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import scan_path
from ..operators.experiment import prompt_version_from_name
from ..schemas import DETAIL_COLS, DISPLAY_COLS, RESULT_ROW
from .sinks import PARTITIONS, decode_identity

NUMERIC = {"execution_time": "double", "correct_fields": "double"}
# Fixed value: the read-side null marker for run-file sinks (never written by the sink).
NULL_MARKER = "\u0000"


def empty_results(spark: SparkSession) -> DataFrame:
    """S3: no run files still gives the full schema."""
    return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType(), True) for c in DISPLAY_COLS + DETAIL_COLS]))


def _names(header: str) -> list[str]:
    """Column names of a header line; a name that comes again gets a number, as data frames need."""
    names, seen = [], set()
    for name in next(csv.reader([header.lstrip("\ufeff").rstrip("\r")]), []):
        unique, n = name, 0
        while unique in seen:
            n += 1
            unique = f"{name}.{n}"
        seen.add(unique)
        names.append(unique)
    return names


def run_headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """The different header lines of run files, each with its files: one pass over all files, whatever their number."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), "value",
        F.monotonically_increasing_id().alias("at"),
    )
    first = lines.where(F.col("begin") == 0).groupBy("path").agg(F.min_by("value", "at").alias("header"))
    by_header: dict[str, list[str]] = {}
    for path, header in sorted(first.select(scan_path(F.col("path")), "header").collect()):  # one row per file
        by_header.setdefault(header, []).append(path)
    return by_header


def _cells(spark: SparkSession, header: str, paths: Sequence[str]) -> DataFrame:
    """All cells, as text, of files with the same header: one scan. Cells hold newlines and doubled quotes; ``multiLine``
    makes a file one task, so a run of many rows should be several files (see ``sinks.write_run_csv``) or Parquet."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in _names(header)])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(list(paths))


def read_runs(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All run files, unioned by column name; one scan per different header, not per file.

    Blank cells are NULL, and so are cells of numeric columns that hold no number (see :func:`rejected_numbers`).
    ``prompt_version`` comes from each file's name. A file without any line has no rows.
    """
    frames = []
    for header, files in run_headers(spark, paths).items():
        df = _cells(spark, header, files)
        df = df.withColumns({c: F.col(c).try_cast(t) for c, t in NUMERIC.items() if c in df.columns})
        frames.append(df.withColumn("prompt_version", prompt_version_from_name(scan_path(F.col("_metadata.file_name")))))
    return union_runs(frames) if frames else empty_results(spark)


def read_run_csv(spark: SparkSession, path: str) -> DataFrame:
    """One run file."""
    return read_runs(spark, [path])


def rejected_numbers(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per numeric column, how many non-blank cells of the run files are no numbers."""
    frames = [_cells(spark, header, files) for header, files in run_headers(spark, paths).items()]
    cells = union_runs(frames)
    known = [(c, t) for c, t in NUMERIC.items() if c in cells.columns]
    bad = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in known]
    return cells.agg(*bad)


def union_runs(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; a column missing from a run is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def project_known(df: DataFrame) -> DataFrame:
    """The display columns, then the detail columns, that exist."""
    available = [c for c in DISPLAY_COLS + DETAIL_COLS if c in df.columns]
    return df.select(*available)


def newest_first(df: DataFrame) -> DataFrame:
    """Sort on the timestamp text, descending, nulls last; ``id`` breaks ties."""
    return df.orderBy(F.col("timestamp").desc_nulls_last(), F.col("id").asc())


def load_experiments(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Every run file in ``paths`` (sorted), unioned, projected and sorted newest first."""
    if not paths:
        return empty_results(spark)
    return newest_first(project_known(read_runs(spark, paths)))


def read_run_files(spark: SparkSession, path: str, partition_by: Sequence[str] = ("doc", "prompt_version", "model")) -> DataFrame:
    """S2 over a run-file sink (:func:`folio.sources.sinks.write_run_files`): all runs in one scan.

    The schema is given: the M8 columns in the order they were written, then the run identity
    from the folder names as text (no type inference, so a model named ``007`` keeps its
    zeros). ``multiLine`` reads each file as one split; a sink holds one file per (task, run),
    so the scan still has many splits.
    """
    data = [f for f in RESULT_ROW.fields if f.name not in partition_by]
    schema = T.StructType(data + [T.StructField(c, T.StringType(), True) for c in partition_by])
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        # The writer leaves a NULL cell empty and quotes an empty text (""). With the default
        # null marker ("") both would read as NULL; a marker no cell holds keeps them apart.
        .option("nullValue", NULL_MARKER)
        .csv(path)
    )
    return decode_identity(df, list(partition_by))


def load_results_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Results written by :func:`folio.sources.sinks.write_results`, run identity as it was written.

    The run identity is read from the folder names as text (``007`` stays ``007``) and decoded
    (an empty text is not NULL). One footer gives the other columns: every run is written with
    the same ones.
    """
    found = spark.read.parquet(path).schema
    text = [T.StructField(f.name, T.StringType()) if f.name in PARTITIONS else f for f in found]
    df = spark.read.schema(T.StructType(text)).parquet(path)
    return decode_identity(df, [c for c in PARTITIONS if c in df.columns])
