"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "folio") -> SparkSession:
    """Build (or reuse) a session with the settings the jobs assume.

    On a cluster the session normally exists already and ``getOrCreate`` returns it; the
    settings below only take effect for a fresh local session (tests, bench).
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only a local session that leaves it unset
    gets a scratch folder; on a cluster each executor would write to its own disk, so that is an
    error.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="folio-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for written tables and stream state)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "folio", *parts) if "://" not in base else "/".join([base.rstrip("/"), "folio", *parts])


def written(df, name: str):
    """``df`` written once under the shared folder and read back: the files cut its lineage and fix what depends on the
    order of rows, on partition numbers or on calls that must not be made twice."""
    spark = df.sparkSession
    path = shared_path(spark, "written", spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df, *keys: str):
    """Hash-spread a scan that has fewer splits than the cluster has cores.

    Per-row work here (JSON parsing, regexes, layout flattening) is CPU-bound; a small table
    stored as one row group would otherwise run as one task. A scan that already has enough
    splits (any large table) is returned unchanged, so no shuffle is added at scale.
    """
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= parallelism:
        return df
    return df.repartition(parallelism, *keys) if keys else df.repartition(parallelism)


def dealt(df, rows: int, rows_per_task: int, *keys: str):
    """``df`` of about ``rows`` rows in tasks of about ``rows_per_task`` each, where that gives more tasks than cores.

    Adaptive execution merges shuffle partitions by the bytes that they hold. Before a projection that makes rows many
    times wider (texts, JSON, parsed values) that leaves a few tasks whose output does not fit in memory; a number of
    partitions that is named is not merged.
    """
    n = -(-rows // rows_per_task)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def broadcast_limit(spark) -> int:
    """The session's own broadcast threshold (``spark.sql.autoBroadcastJoinThreshold``)."""
    value = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    units = {"b": 1, "k": 1024, "m": 1024**2, "g": 1024**3}
    v = value.strip().lower().rstrip("b") or "0"
    return int(float(v[:-1]) * units[v[-1]]) if v[-1] in units else int(v)


def estimated_bytes(df) -> int:
    """The optimizer's size estimate of a plan (from file sizes for scans; no job is run)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df, limit: int | None = None, growth: float = 1.0) -> bool:
    """True when ``growth`` x the estimated size of ``df`` is within the broadcast threshold.

    Use it on the scan that bounds a join side (for example the dimension table before its
    own small lookups): Spark estimates a join's size as the product of its inputs, which
    hides a small side behind an inflated number. ``growth`` bounds how much wider the
    broadcast rows are than the scanned ones (derived columns). A threshold of -1 disables
    broadcasting.
    """
    limit = broadcast_limit(df.sparkSession) if limit is None else limit
    return limit >= 0 and estimated_bytes(df) * growth <= limit
