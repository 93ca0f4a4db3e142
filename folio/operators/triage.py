"""Input triage (T-1 to T-10): per-row checks as Column expressions, no exception leaves a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import block_type, media_type, suffix
from ..schemas import API_MEDIA_TYPES, VALIDATION_FORMATS

# Status codes of the error classes.
STATUS = {"ok": 200, "invalid": 400, "not_found": 404, "download": 422, "processing": 500}

# Formats the chat API accepts, as decoder names (suffix without the dot).
API_FORMATS = tuple(s.lstrip(".") for s in API_MEDIA_TYPES)


def normalise_format(fmt: Column) -> Column:
    """Decoder format name, lower case, ``jpg`` folded into ``jpeg``."""
    f = F.lower(fmt)
    return F.when(f == "jpg", F.lit("jpeg")).otherwise(f)


def format_ok(fmt: Column, accepted=VALIDATION_FORMATS) -> Column:
    """T-4: NULL format passes (nothing to check); otherwise the normalised name must be accepted."""
    names = sorted({("jpeg" if a == "jpg" else a) for a in accepted})
    return fmt.isNull() | normalise_format(fmt).isin(names)


def decoded_size_mb(width: Column, height: Column, channels: Column) -> Column:
    """T-5: decoded size in MiB, ``w * h * bands / 2**20``."""
    return width.cast("double") * height.cast("double") * channels.cast("double") / F.lit(1024.0 * 1024.0)


def size_ok(width: Column, height: Column, channels: Column, max_mb: float = 10) -> Column:
    """Exactly ``max_mb`` passes; only larger fails."""
    return ~(decoded_size_mb(width, height, channels) > F.lit(float(max_mb)))


def media_type_dispatch(df: DataFrame, path_col: str = "in") -> DataFrame:
    """T-1 / T-2: suffix -> media type and block type; unsupported suffixes get an error text."""
    p = F.col(path_col)
    sfx = F.lower(suffix(p))
    mt = media_type(p)
    return df.select(
        "id",
        sfx.alias("suffix"),
        mt.alias("media_type"),
        F.when(mt.isNotNull(), block_type(p)).alias("block_type"),
        F.when(mt.isNull(), F.concat(F.lit("Unsupported file type '"), sfx, F.lit("'"))).alias("error"),
    )


def content_block(content: Column, path: Column) -> Column:
    """T-3: base64 content block ``{type, source: {type: base64, media_type, data}}``.

    Spark's ``base64`` may wrap lines (``\\r\\n`` every 76 characters); the API wants one line.
    """
    data = F.replace(F.replace(F.base64(content), F.lit("\r")), F.lit("\n"))
    return F.struct(
        block_type(path).alias("type"),
        F.struct(F.lit("base64").alias("type"), media_type(path).alias("media_type"), data.alias("data")).alias("source"),
        F.lit(None).cast("string").alias("text"),
    )


def status_of(missing: Column, fmt: Column, width: Column, height: Column, channels: Column, max_mb: float = 10,
              accepted=VALIDATION_FORMATS, decodable: Column | None = None) -> tuple[Column, Column]:
    """T-7 as columns: (status, error class); the first failing check in order missing ->
    not decodable -> format -> size decides, else 200 with no error class.

    ``decodable``: whether the bytes are an image at all (NULL counts as no). A NULL format passes
    the format check only for a decoded image. Without ``decodable`` the rows are taken as decoded.
    """
    missing = F.coalesce(missing, F.lit(False))
    broken = F.lit(False) if decodable is None else ~F.coalesce(decodable, F.lit(False))
    bad_format = ~format_ok(fmt, accepted)
    too_big = ~size_ok(width, height, channels, max_mb)
    error_class = (
        F.when(missing, F.lit("not_found"))
        .when(broken, F.lit("invalid_image"))
        .when(bad_format, F.lit("unsupported_format"))
        .when(too_big, F.lit("too_large"))
    )
    status = (
        F.when(missing, F.lit(STATUS["not_found"]))
        .when(broken | bad_format | too_big, F.lit(STATUS["invalid"]))
        .otherwise(F.lit(STATUS["ok"]))
    )
    return status, error_class


def triage_status(df: DataFrame, max_mb: float = 10, accepted=VALIDATION_FORMATS) -> DataFrame:
    """T-7: first failing check gives the status; else 200. A ``decodable`` column, if there is one,
    is checked before the format."""
    status, error_class = status_of(F.col("missing"), F.col("format"), F.col("width"), F.col("height"),
                                    F.col("channels"), max_mb, accepted,
                                    F.col("decodable") if "decodable" in df.columns else None)
    return df.select("id", status.alias("status"), error_class.alias("error_class"))


def triage_summary(status: DataFrame) -> DataFrame:
    """T-8: rows per status and error class."""
    return status.groupBy("status", "error_class").agg(F.count(F.lit(1)).alias("n"))


def split_accepted(status: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T-8: accepted rows and rejected rows (two filters over the same plan; cache upstream if reused)."""
    return status.where(F.col("status") == STATUS["ok"]), status.where(F.col("status") != STATUS["ok"])


def prompt_ok(prompt: Column) -> Column:
    """T-9: a prompt needs at least one character; whitespace counts."""
    return F.coalesce(F.length(prompt) >= 1, F.lit(False))


def source_xor(path: Column, url: Column) -> Column:
    """T-10: exactly one of path / url is given (empty text counts as not given)."""
    return F.nullif(path, F.lit("")).isNull() != F.nullif(url, F.lit("")).isNull()


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Scheme, host and validity of an http(s) URL (bad URLs give NULL parts, not errors)."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.try_parse_url(url, F.lit("HOST"))
    valid = F.coalesce(
        scheme.isin("http", "https") & host.isNotNull() & (F.length(host) > 0) & (F.length(url) <= 2083),
        F.lit(False),
    )
    return scheme, host, valid
