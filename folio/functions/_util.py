"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def posexplode_rows(df: DataFrame, keep: Sequence, array, pos: str = "pos", value: str = "value") -> DataFrame:
    """``df.select(*keep, posexplode(array))`` that evaluates ``array`` once per row.

    For an inner ``posexplode`` Catalyst infers ``size(array) > 0 AND array IS NOT NULL`` and
    pushes it below the generator (and below a shuffle), so a computed array (a parse, a
    layout built from text) is evaluated twice. The outer form gets no inferred filter; the
    rows it adds for NULL or empty arrays are the only ones with a NULL position, and they are
    dropped, which gives exactly the inner rows.
    """
    out = df.select(*keep, F.posexplode_outer(as_col(array)).alias(pos, value))
    return out.where(F.col(pos).isNotNull())
