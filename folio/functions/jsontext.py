"""JSON-text column functions: lenient (Column-only) and strict (pandas UDF) object parsing, pretty print."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import as_col
from .text import fence_strip

STRING_MAP = T.MapType(T.StringType(), T.StringType())


# Fixed value: JSON's insignificant whitespace (space, tab, line feed, carriage return).
JSON_SPACE = " \t\n\r"


def looks_like_object(c) -> Column:
    """Text starts with ``{`` and ends with ``}`` once JSON whitespace is trimmed (so an answer
    with a trailing newline is an object; the trailing prose ``from_json`` accepts is not)."""
    c = as_col(c)
    t = F.btrim(c, F.lit(JSON_SPACE))
    # Texts without space around them, usually most of them, are not trimmed (as an OR, both sides' parts are made first).
    return F.when(c.startswith("{") & c.endswith("}"), F.lit(True)).otherwise(t.startswith("{") & t.endswith("}"))


def parse_object(c, strip_fence: bool = True) -> Column:
    """Lenient parse of a JSON object into ``map<string,string>``; NULL when it is not an object.

    Nested values come back as their JSON text and JSON ``null`` as NULL. A repeated key is in the
    map as often as in the text: see :func:`last_wins`.
    """
    text = fence_strip(c) if strip_fence else as_col(c)
    return F.when(looks_like_object(text), F.from_json(text, STRING_MAP))


def last_wins(c) -> Column:
    """A parsed map with each repeated key reduced to its last value (give it a column, not a parse)."""
    m = as_col(c)
    keys, entries = F.map_keys(m), F.map_entries(m)
    later = lambda e, i: F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"])
    kept = F.map_from_entries(F.filter(entries, lambda e, i: ~later(e, i)))
    return F.when(F.size(F.array_distinct(keys)) < F.size(keys), kept).otherwise(m)


def raw_valid_json(c) -> Column:
    """The raw text (no fence stripping) is a JSON object."""
    return F.coalesce(parse_object(c, strip_fence=False).isNotNull(), F.lit(False))


def _strict_one(s):
    if s is None:
        return None
    try:
        v = json.loads(s)
    except (ValueError, TypeError):
        return None
    if not isinstance(v, dict):
        return None
    return {
        k: (None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False))
        for k, x in v.items()
    }


@F.pandas_udf(STRING_MAP)
def parse_object_strict(s: pd.Series) -> pd.Series:
    """Strict parse (Python ``json.loads``): trailing text is an error; NULL for errors and non-objects."""
    return s.map(_strict_one)


def _pretty_one(s):
    try:
        return json.dumps(json.loads(s), indent=2, ensure_ascii=False)
    except (ValueError, TypeError):
        return str(s) if s else ""


@F.pandas_udf(T.StringType())
def pretty_json(s: pd.Series) -> pd.Series:
    """Indented JSON (2 spaces, non-ASCII kept) when the text parses, else the raw text, else ``""``."""
    return s.map(lambda v: _pretty_one(None if v is None or (isinstance(v, float) and pd.isna(v)) else v))
