"""Dataset manifests and ground truth."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import resolve, scan_path
from ..schemas import MANIFEST


def load_dataset(spark: SparkSession, datasets_dir: str, doc: str) -> DataFrame:
    """Read ``<doc>/<doc>.csv`` with the fixed manifest schema; resolve ``in`` / ``out``."""
    base = os.path.join(datasets_dir, doc)
    df = spark.read.schema(MANIFEST).option("header", True).option("escape", "\"").csv(os.path.join(base, f"{doc}.csv"))
    return df.withColumns({"in": resolve(base, F.col("in")), "out": resolve(base, F.col("out"))})


def read_truth_files(spark: SparkSession, glob: str) -> DataFrame:
    """Ground-truth JSON files as (path, content), one row per file."""
    df = spark.read.option("wholetext", True).text(glob)
    path = scan_path(F.col("_metadata.file_path"))
    return df.select(path.alias("path"), F.col("value").alias("content"))


def attach_truth(manifest: DataFrame, truth_files: DataFrame, out_col: str = "out") -> DataFrame:
    """Left join each manifest row to its ground-truth text on the path (``expected`` NULL when absent).

    A plain equi-join: Spark broadcasts the truth side when its size estimate is small and
    otherwise shuffles both sides on the path (AQE splits a hot path).
    """
    t = truth_files.select(F.col("path").alias("_truth_path"), F.col("content").alias("expected"))
    return manifest.join(t, manifest[out_col] == t["_truth_path"], "left").drop("_truth_path")


def missing_inputs(manifest: DataFrame, files: DataFrame, in_col: str = "in") -> DataFrame:
    """Manifest rows whose input file is absent from a file listing (left anti join on the path)."""
    return manifest.join(files.select(F.col("path").alias("_p")), manifest[in_col] == F.col("_p"), "left_anti")
