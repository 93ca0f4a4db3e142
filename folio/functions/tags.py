"""Tag-cell parsing and tag predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import as_col
from .text import py_strip


# Tag modes. ``json``: a cell holding a JSON array gives its elements (the recorded cells are
# JSON arrays such as ["background"]). ``split``: the dashboard's own rule, comma split and
# strip, so ["background"] is one tag spelled with its brackets and quotes (trap T1).
TAG_MODES = ("json", "split")


def _split_strip(c: Column) -> Column:
    return F.transform(F.split(c.cast("string"), ",", -1), lambda t: py_strip(t))


def parse_tags(c, mode: str = "json") -> Column:
    """Tags of a cell, empties dropped. ``json``: the JSON array when the text is one, else comma
    split + strip. ``split``: always comma split + strip, as the dashboard's tag options do.

    NULL cells stay NULL (so a tag filter drops them, an unfiltered view keeps them).
    """
    c = as_col(c)
    if mode == "split":
        return F.filter(_split_strip(c), lambda t: t != "")
    if mode != "json":
        raise ValueError(f"unknown tag mode {mode!r}; known: {TAG_MODES}")
    as_json = F.when(py_strip(c).startswith("["), F.from_json(c, T.ArrayType(T.StringType())))
    as_split = F.transform(F.split(c, ",", -1), lambda t: py_strip(t))
    tags = F.coalesce(as_json, as_split)
    return F.filter(F.transform(tags, lambda t: py_strip(t)), lambda t: t.isNotNull() & (t != ""))


def has_any_tag(c, wanted: Sequence[str], mode: str = "json") -> Column:
    """Dashboard filter: at least one wanted tag (ANY); a NULL cell is false. In ``split`` mode
    the pieces are compared as the dashboard does, without dropping empty ones."""
    want = F.array(*[F.lit(t) for t in wanted])
    have = _split_strip(as_col(c)) if mode == "split" else parse_tags(c, mode)
    return F.coalesce(F.arrays_overlap(have, want), F.lit(False))


def has_all_tags(tags_array, wanted: Sequence[str]) -> Column:
    """Catalogue mode: every wanted tag present (array column in, ALL semantics)."""
    want = F.array(*[F.lit(t) for t in wanted]).cast(T.ArrayType(T.StringType()))
    return F.size(F.array_except(want, F.coalesce(as_col(tags_array), F.array().cast("array<string>")))) == 0
