"""Frame-level layout operators (L3): one row per page of a layout tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions._util import posexplode_rows
from ..functions.layout import page_text


def page_explode(df: DataFrame, key: str = "doc_id", pages: str = "pages") -> DataFrame:
    """L3: one row per page with its 1-based number and text.

    Page-level rows let a later ``repartition`` balance documents of very different lengths
    before per-page inference.
    """
    return posexplode_rows(df, [key], pages, value="page").select(
        key,
        (F.col("pos") + 1).alias("page_no"),
        F.size(F.flatten(F.transform(F.col("page.blocks"), lambda b: b["lines"]))).alias("n_lines"),
        page_text(F.col("page")).alias("page_text"),
    )
