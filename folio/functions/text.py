"""String column functions. All are JVM-side expressions (whole-stage codegen, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import as_col

# The characters Python's str.strip() removes (str.isspace).
PY_WHITESPACE = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove all leading/trailing whitespace (Spark ``trim`` only removes spaces)."""
    return F.btrim(as_col(c).cast("string"), F.lit(PY_WHITESPACE))


def is_fenced(c) -> Column:
    """True when the text opens with a markdown code fence (optionally after whitespace)."""
    return as_col(c).rlike(r"^\s*```")


def fence_strip(c) -> Column:
    """Remove a markdown code fence (```` ``` ```` or ```` ```json ````) around a JSON answer."""
    c = as_col(c)
    head = F.regexp_replace(c, r"^\s*```(?:json|JSON)?[ \t]*\r?\n?\s*", "")
    # Texts without a mark, usually most of them, are not searched.
    return F.when(F.contains(c, F.lit("```")), F.regexp_replace(head, r"\s*```\s*$", "")).otherwise(c)


def preview(c, n: int = 1000, always_ellipsis: bool = False) -> Column:
    """First ``n`` characters; ``...`` appended only when longer (or always, in the second mode)."""
    c = as_col(c)
    if always_ellipsis:
        return F.concat(F.substring(c, 1, n), F.lit("..."))
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def demote_headings(c) -> Column:
    """Prefix one more ``#`` to every line that starts with 1 to 5 ``#`` (so ``######`` becomes 7)."""
    return F.regexp_replace(as_col(c), r"(?m)^(#{1,5})", "#$1")


def strip_echo(text, prompt) -> Column:
    """Drop an echoed prompt at the start of a generation, then strip; unchanged when there is no echo."""
    text, prompt = as_col(text), as_col(prompt)
    rest = text.substr(F.length(prompt) + 1, F.greatest(F.length(text), F.lit(1)))
    return F.when(text.startswith(prompt), py_strip(rest)).otherwise(text)


# Timestamp texts are built from the TIMESTAMP_NTZ string form ('yyyy-MM-dd HH:mm:ss[.f]'),
# which involves no time zone. ``date_format`` would read a naive value in the session zone,
# and a wall clock inside a daylight-saving gap would move by an hour.
def _ntz_text(ts) -> Column:
    return as_col(ts).cast("timestamp_ntz").cast("string")


def iso_seconds(ts) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` of a naive timestamp (a TIMESTAMP is taken in the session zone)."""
    s = _ntz_text(ts)
    return F.concat(F.substring(s, 1, 10), F.lit("T"), F.substring(s, 12, 8))


def iso_text(ts) -> Column:
    """Python ``datetime.isoformat()`` of a naive timestamp: the fraction only when it is not zero."""
    text = _ntz_text(ts)
    frac = F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise(F.lit(""))
    whole = iso_seconds(ts)
    return F.when(frac == "", whole).otherwise(F.concat(whole, F.lit("."), F.rpad(frac, 6, "0")))


def stamp_text(ts) -> Column:
    """``yyyyMMdd_HHmmss`` of a naive timestamp (the run-time part of a run name)."""
    s = _ntz_text(ts)
    return F.concat(F.translate(F.substring(s, 1, 10), "-", ""), F.lit("_"), F.translate(F.substring(s, 12, 8), ":", ""))


def utc_wall_clock(ts) -> Column:
    """An instant (TIMESTAMP) as its UTC wall clock (TIMESTAMP_NTZ), whatever the session zone."""
    us = F.unix_micros(as_col(ts))
    days = F.floor(us / F.lit(86_400_000_000))
    secs = ((us - days * F.lit(86_400_000_000)).cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(days.cast("int"), F.lit(0), F.lit(0), secs)


def iso_utc_text(ts) -> Column:
    """Python ``isoformat()`` of a UTC-aware datetime: ``…T…[.ffffff]+00:00`` for an instant."""
    return F.concat(iso_text(utc_wall_clock(ts)), F.lit("+00:00"))
