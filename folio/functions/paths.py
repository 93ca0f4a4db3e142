"""Path and media-type column functions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import API_MEDIA_TYPES
from ._util import as_col


def resolve(base: str, p) -> Column:
    """Join a relative path onto ``base``; an absolute right side replaces the base (pathlib rule)."""
    p = as_col(p)
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), p))


def scan_path(uri) -> Column:
    """A ``_metadata.file_path`` / ``file_name`` value as the path a manifest names.

    Those values are URIs: a space is ``%20`` and ``%`` is ``%25``. The local ``file:`` scheme
    is dropped and the escapes decoded (``+`` is literal in a URI, so it is kept, not read as a
    space). Other schemes stay, so ``s3a://…`` paths compare as written.
    """
    u = F.regexp_replace(as_col(uri), r"^file:(//)?", "")
    return F.url_decode(F.replace(u, F.lit("+"), F.lit("%2B")))


def file_name(p) -> Column:
    return F.regexp_extract(as_col(p), r"([^/]*)$", 1)


def suffix(p) -> Column:
    """pathlib ``suffix``: last ``.xxx`` of the final component, ``''`` when none (or a dot file)."""
    return F.regexp_extract(file_name(p), r".(\.[^.]+)$", 1)


def stem(p) -> Column:
    """pathlib ``stem``: file name without its suffix."""
    name = file_name(p)
    return name.substr(F.lit(1), F.length(name) - F.length(suffix(p)))


def media_type(p) -> Column:
    """Media type for the case-folded suffix, NULL when the suffix is not accepted by the API."""
    media = F.create_map(*[F.lit(x) for x in chain.from_iterable(API_MEDIA_TYPES.items())])
    return F.try_element_at(media, F.lower(suffix(p)))


def block_type(p) -> Column:
    """``document`` for PDF inputs, ``image`` otherwise."""
    return F.when(F.lower(suffix(p)) == ".pdf", F.lit("document")).otherwise(F.lit("image"))
