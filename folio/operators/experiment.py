"""Experiment grid and backend comparison (I9, I11), run identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import file_name, stem


def experiment_grid(manifest: DataFrame, models: Sequence[str], prompt_versions: Sequence[str], doc: str = "cin",
                    run_ts: str = "19700101_000000") -> DataFrame:
    """Every manifest row x (model, prompt version), with the run identity stamped.

    The (model, prompt) pairs are a short literal list, so each row is expanded by a generator
    (``explode`` of a literal array) inside the scan stage: no join, no shuffle.
    """
    pairs = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(v).alias("prompt_version")) for m in models for v in prompt_versions]
    )
    return (
        manifest.select("*", F.explode(pairs).alias("_run"))
        .select("*", F.col("_run.model").alias("model"), F.col("_run.prompt_version").alias("prompt_version"))
        .drop("_run")
        .withColumn("run_name", run_name(F.lit(doc), F.col("prompt_version"), F.col("model"), F.lit(run_ts)))
    )


def run_name(doc: Column, prompt_version: Column, model: Column, run_ts: Column) -> Column:
    """M9: ``<doc>_prompt_<version>_<model>_<YYYYmmdd_HHMMSS>``."""
    return F.concat_ws("_", doc, F.lit("prompt"), prompt_version, model, run_ts)


def prompt_version_from_name(path: Column) -> Column:
    """Version from a run file name; ``''`` when the stem does not split in two on ``_prompt_``.

    A version containing ``_`` is cut at its first ``_`` (the name cannot tell them apart).
    """
    parts = F.split(stem(path), "_prompt_", -1)
    return F.when(F.size(parts) == 2, F.split(F.element_at(parts, 2), "_", 2).getItem(0)).otherwise(F.lit(""))


def run_file_name(path: Column) -> Column:
    return file_name(path)


def model_pivot(results: DataFrame, models: Sequence[str], key: str = "case_key") -> DataFrame:
    """Per document, each backend's mean time and mean correct fields side by side
    (columns ``<model>_avg_time``, ``<model>_avg_fields``, as ``pivot`` names them).

    The models are given, and each cell is a conditional average, so this is one aggregation
    with one shuffle on the key (partial averages before it). ``pivot`` would aggregate by
    (key, model) first and shuffle a second time.
    """
    cells = []
    for m in models:
        mine = F.col("model") == F.lit(m)
        cells += [
            F.round(F.avg(F.when(mine, F.col("execution_time"))), 6).alias(f"{m}_avg_time"),
            F.round(F.avg(F.when(mine, F.col("correct_fields"))), 6).alias(f"{m}_avg_fields"),
        ]
    return results.groupBy(key).agg(*cells)
