"""The results table as a clustered store: rows in time order, and small tables that say where things are.

``rows``: sorted by time (newest first, unknown last) and key over all files, one folder ``_part=k`` per range and
``_place``, the row's number inside it; a bloom filter on the key per row group.
``parts``: per folder the number of rows, the rows before it, and the bounds of what filters compare.
``tags``: in which folders a tag occurs, and how often.

A page by its number is a lookup in ``parts`` and the read of one range of places (A17); bounds of a column are a look
at ``parts`` (A13); a date, score or tag filter opens only the folders that can hold a row (A6, A9), and a key opens only
row groups whose bloom filter knows it (A18). The table is written once and not changed: a new state is a new store.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.analytics import FilterSpec

ROWS_PER_PART = 1_000_000
ROW_GROUP_BYTES = 16 * 1024 * 1024
#: More folders than this are not named in a filter: the scan's own statistics prune then.
NAMED_PARTS = 2000
#: More keys than this are compared with their bounds only (no bloom filter).
NAMED_KEYS = 100


def _bounds_of(column: str, kind: str) -> list[Column]:
    c = F.col(column)
    if kind in ("double", "float"):  # NaN would be the largest value of its folder
        c = F.nanvl(c, F.lit(None).cast(kind))
    return [F.min(c).alias(f"min_{column}"), F.max(c).alias(f"max_{column}")]


def write_store(df: DataFrame, path: str, time: str = "timestamp", key: str = "id", bounded: Sequence[str] = (),
                tags: str | None = "tag_list", rows_per_part: int = ROWS_PER_PART) -> None:
    """Write ``df`` as a clustered store under ``path``. ``bounded``: further columns whose bounds are kept per folder.

    One range shuffle (a time that a third of the rows share is split by the key); the small tables are counted from
    the narrow columns of what was written.
    """
    spark = df.sparkSession
    n = df.count()
    order = [F.col(time).desc_nulls_last(), F.col(key).asc()]
    dealt = df.repartitionByRange(max(1, -(-n // rows_per_part)), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    writer = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", place).write.mode("overwrite")
    writer = writer.option("parquet.block.size", ROW_GROUP_BYTES).option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer = writer.option(f"parquet.bloom.filter.expected.ndv#{key}", min(max(n, 1), rows_per_part))
    writer.partitionBy("_part").parquet(f"{path}/rows")
    rows = _rows(spark, path, df)
    kinds = dict(df.dtypes)
    known = [c for c in dict.fromkeys([time, key, *bounded]) if c in kinds]
    bounds = [b for c in known for b in _bounds_of(c, kinds[c])]
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"), *bounds)
    before = F.sum("rows").over(Window.orderBy("_part")) - F.col("rows")  # one row per folder
    parts.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
    if tags in kinds:
        listed = rows.select("_part", F.explode(F.array_distinct(tags)).alias("tag"))
        listed.groupBy("tag", "_part").agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/tags")


def _rows(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    own = [T.StructField("_place", T.LongType()), T.StructField("_part", T.IntegerType())]
    return spark.read.schema(T.StructType([*like.schema.fields, *own])).parquet(f"{path}/rows")


@dataclass(frozen=True)
class ResultStore:
    rows: DataFrame
    parts: DataFrame
    tags: DataFrame | None
    time: str
    key: str

    @property
    def data(self) -> list[str]:
        return [c for c in self.rows.columns if c not in ("_part", "_place")]

    def table(self) -> DataFrame:
        return self.rows.select(self.data)

    def _in_parts(self, parts: DataFrame) -> DataFrame:
        """The rows of the folders named by ``parts`` (a column ``_part``), by partition pruning."""
        found = [r["_part"] for r in parts.select("_part").distinct().limit(NAMED_PARTS + 1).collect()]
        return self.rows if len(found) > NAMED_PARTS else self.rows.where(F.col("_part").isin(found))

    def count(self) -> int:
        return self.parts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def score_bounds(self, score: str = "correct_fields") -> DataFrame:
        """A13 from the folders' bounds: no row is read. 0 / 15 when there is nothing."""
        low, high = f"min_{score}", f"max_{score}"
        if low not in self.parts.columns:
            return self.rows.sparkSession.createDataFrame([(0, 15)], "n_min int, n_max int")
        return self.parts.agg(F.coalesce(F.min(low).cast("int"), F.lit(0)).alias("n_min"),
                              F.coalesce(F.max(high).cast("int"), F.lit(15)).alias("n_max"))

    def page(self, number: int, size: int = 25) -> DataFrame:
        """Page ``number`` (from 0) in time order, at the same cost for every page."""
        low, high = number * size, (number + 1) * size
        hit = self.parts.where((F.col("before") < high) & (F.col("before") + F.col("rows") > low)).select("_part", "before")
        inside = [
            (F.col("_part") == r["_part"]) & F.col("_place").between(max(0, low - r["before"]), high - 1 - r["before"])
            for r in hit.collect()  # at most one row per row of the page
        ]
        rows = self.rows.where(reduce(or_, inside) if inside else F.lit(False))
        return rows.orderBy("_part", "_place").limit(size).select(self.data)  # a top-k: no range sampling

    def lookup(self, keys: Sequence) -> DataFrame:
        """The rows of some keys; equality comparisons, so bloom filters decide which row groups are read."""
        keys = list(dict.fromkeys(keys))
        k = F.col(self.key)
        if len(keys) > NAMED_KEYS:
            return self.table().where(k.isin(keys))
        return self.table().where(reduce(or_, [k == F.lit(v) for v in keys]) if keys else F.lit(False))

    def facet_tags(self) -> DataFrame:
        """Sorted distinct tags, from the tag table."""
        return self.tags.select("tag").distinct().orderBy("tag")

    def filter(self, spec: FilterSpec) -> DataFrame:
        """A5-A10: the rows a filter keeps; folders that cannot hold one are not opened."""
        parts, names = self.parts, set(self.parts.columns)
        conditions: list[Column] = []
        low, high = f"min_{spec.timestamp_col}", f"max_{spec.timestamp_col}"
        if low in names and dict(self.rows.dtypes)[spec.timestamp_col].startswith("timestamp"):
            kind = dict(parts.dtypes)[low]
            if spec.start_date:
                dt.datetime.fromisoformat(spec.start_date)
                conditions.append(F.col(high) >= F.lit(spec.start_date).cast(kind))
            if spec.end_date:
                end = dt.datetime.fromisoformat(spec.end_date) + dt.timedelta(days=1)
                conditions.append(F.col(low) <= F.lit(end.isoformat(" ")).cast(kind))
        if f"min_{spec.score_col}" in names:
            if spec.ncorrect_min is not None:
                conditions.append(F.col(f"max_{spec.score_col}") >= float(spec.ncorrect_min))
            if spec.ncorrect_max is not None:
                conditions.append(F.col(f"min_{spec.score_col}") <= float(spec.ncorrect_max))
        if spec.tags and spec.tag_mode == "json" and self.tags is not None:
            tagged = self.tags.where(F.col("tag").isin(list(spec.tags))).select("_part").distinct()
            parts = parts.join(tagged, "_part", "left_semi")
        elif not conditions:
            return spec.apply(self.rows).select(self.data)
        kept = parts.where(reduce(and_, conditions)) if conditions else parts
        return spec.apply(self._in_parts(kept)).select(self.data)


def open_result_store(spark: SparkSession, path: str, like: DataFrame, time: str = "timestamp", key: str = "id",
                      tags: str | None = "tag_list") -> ResultStore:
    """The store written under ``path`` from a table like ``like``."""
    listed = spark.read.parquet(f"{path}/tags") if tags in like.columns else None
    return ResultStore(_rows(spark, path, like), spark.read.parquet(f"{path}/parts"), listed, time, key)
