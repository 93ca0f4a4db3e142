"""Result analytics (A1-A21): leaderboards, filters, facets, table sort / filter / page, reasons."""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import posexplode_rows
from ..functions.tags import has_any_tag, parse_tags
from ..functions.text import py_strip
from . import scoring

GROUP_KEYS = ("model", "prompt_version")


def _nan_to_null(c: Column) -> Column:
    """pandas means skip NaN; Spark ``avg`` keeps it (and ``NaN >= 5`` is true), so NaN becomes NULL first."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def _grouped(df: DataFrame, keys: Sequence[str], doc: str | None) -> "DataFrame":
    if doc is not None:
        df = df.where(F.col("doc") == doc)
    # pandas groupby drops NULL keys.
    return df.where(reduce(operator.and_, [F.col(k).isNotNull() for k in keys])).groupBy(*keys)


def avg_correct_fields(df: DataFrame, score: str = "correct_fields", keys=GROUP_KEYS, doc: str | None = "cin") -> DataFrame:
    """A1: mean correct fields per model x prompt version (NaN skipped, NULL keys dropped)."""
    return _grouped(df, keys, doc).agg(F.round(F.avg(_nan_to_null(F.col(score))), 6).alias("avg_correct_fields"))


def _pct_incorrect(c: Column) -> Column:
    # NULL verdicts stay in the denominator, as ``(g == "incorrect").mean() * 100`` does.
    return F.round(F.avg(F.when(c == "incorrect", F.lit(100.0)).otherwise(F.lit(0.0))), 6)


def pct_format_incorrect(df: DataFrame, verdict: str = "format_compliance", keys=GROUP_KEYS,
                         doc: str | None = "cin") -> DataFrame:
    """A2: share of rows judged ``incorrect``, in percent."""
    return _grouped(df, keys, doc).agg(_pct_incorrect(F.col(verdict)).alias("pct_format_incorrect"))


def avg_execution_time(df: DataFrame, keys=GROUP_KEYS, doc: str | None = "cin") -> DataFrame:
    """A3: mean execution time; no rows at all when the column is absent."""
    if "execution_time" not in df.columns:
        return df.sparkSession.createDataFrame(
            [], T.StructType([T.StructField(k, T.StringType()) for k in keys] + [T.StructField("avg_execution_time", T.DoubleType())])
        )
    return _grouped(df, keys, doc).agg(F.round(F.avg(_nan_to_null(F.col("execution_time"))), 6).alias("avg_execution_time"))


def leaderboard(df: DataFrame, keys=GROUP_KEYS, doc: str | None = "cin", score: str = "correct_fields",
                verdict: str = "format_compliance") -> DataFrame:
    """A4: the three dashboard metrics in one aggregation (one shuffle: partial then final)."""
    return _grouped(df, keys, doc).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(_nan_to_null(F.col(score))), 6).alias("avg_correct_fields"),
        _pct_incorrect(F.col(verdict)).alias("pct_format_incorrect"),
        F.round(F.avg(_nan_to_null(F.col("execution_time"))), 6).alias("avg_execution_time"),
        F.round(F.min("execution_time"), 6).alias("min_execution_time"),
    )


@dataclass(frozen=True)
class FilterSpec:
    """A5-A10: the nine dashboard filters. Empty list / None means "no filter"; 0 is a real bound."""

    models: tuple[str, ...] = ()
    docs: tuple[str, ...] = ()
    prompt_versions: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    start_date: str | None = None
    end_date: str | None = None
    ncorrect_min: float | None = None
    ncorrect_max: float | None = None
    format_compliance: tuple[str, ...] = ()
    tag_mode: str = "json"
    timestamp_col: str = "timestamp"
    score_col: str = "correct_fields"
    verdict_col: str = "format_compliance"

    def predicates(self, columns: Sequence[str], types: dict[str, str] | None = None) -> list[Column]:
        """One predicate per filter. With the column types (``dict(df.dtypes)``) typed columns are
        compared as they are, so that the comparisons reach the scan."""
        cols, types = set(columns), types or {}
        out: list[Column] = []
        if self.models:
            out.append(F.col("model").isin(list(self.models)))
        if self.docs:
            out.append(F.col("doc").isin(list(self.docs)))
        if self.prompt_versions and "prompt_version" in cols:
            out.append(F.col("prompt_version").isin(list(self.prompt_versions)))
        if self.tags and "tags" in cols:
            # A table that stores the parsed tags needs no parse per row and query.
            parsed = self.tag_mode == "json" and types.get("tag_list") == "array<string>"
            wanted = F.array(*[F.lit(t) for t in self.tags])
            out.append(
                F.coalesce(F.arrays_overlap(F.col("tag_list"), wanted), F.lit(False))
                if parsed
                else has_any_tag(F.col("tags"), self.tags, self.tag_mode)
            )
        if self.timestamp_col in cols and (self.start_date or self.end_date):
            typed = types.get(self.timestamp_col) == "timestamp_ntz"
            ts = F.col(self.timestamp_col) if typed else parse_timestamp(F.col(self.timestamp_col))
            # Bounds are naive (TIMESTAMP_NTZ) literals: comparing with a Python datetime would
            # bring the session and driver time zones in.
            if self.start_date:
                out.append(ts >= _ntz_literal(self.start_date))
            if self.end_date:
                # Inclusive of midnight of the next day: ts <= end + 1 day.
                out.append(ts <= _ntz_literal(self.end_date) + F.make_dt_interval(F.lit(1)))
        if self.ncorrect_min is not None and self.score_col in cols:
            # NaN is larger than any number here, so the lower bound excludes it by a second
            # conjunct; the comparison itself stays on the bare column.
            x = F.col(self.score_col)
            x = x if types.get(self.score_col, "double") == "double" else x.cast("double")
            out += [x >= F.lit(float(self.ncorrect_min)), ~F.isnan(x)]
        if self.ncorrect_max is not None and self.score_col in cols:
            x = F.col(self.score_col)
            x = x if types.get(self.score_col, "double") == "double" else x.cast("double")
            out.append(x <= F.lit(float(self.ncorrect_max)))
        if self.format_compliance and self.verdict_col in cols:
            out.append(F.col(self.verdict_col).isin(list(self.format_compliance)))
        return out

    def to_column(self, columns: Sequence[str]) -> Column:
        """One conjunct, so Catalyst can push it into the Parquet scan and prune partitions."""
        preds = self.predicates(columns)
        return reduce(operator.and_, preds) if preds else F.lit(True)

    def apply(self, df: DataFrame) -> DataFrame:
        preds = self.predicates(df.columns, dict(df.dtypes))
        return df.where(reduce(operator.and_, preds)) if preds else df


def reset_filters() -> FilterSpec:
    """A10: every filter empty, i.e. all rows."""
    return FilterSpec()


def _ntz_literal(value: str) -> Column:
    dt.datetime.fromisoformat(value)  # a malformed bound fails here, on the driver
    return F.lit(value).cast("timestamp_ntz")


def parse_timestamp(c: Column) -> Column:
    """Text or timestamp to TIMESTAMP_NTZ; unparseable text becomes NULL (dropped only when a date filter is on)."""
    # A cast to TIMESTAMP_NTZ reads ISO text with or without fractions and with 'T' or a space,
    # and does not depend on the session time zone.
    return c.cast("string").try_cast("timestamp_ntz")


def facet_values(df: DataFrame, columns: Sequence[str] = ("model", "doc", "prompt_version")) -> DataFrame:
    """Sorted distinct non-null values of each facet column, as text.

    One pass: the facet columns are unpivoted by a generator and deduplicated by a single
    aggregation (partial dedupe before the shuffle), instead of one distinct job per column.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return (
        df.select(pairs.alias("p"))
        .select("p.facet", "p.value")
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("facet", "value")
    )


def facet_tags(df: DataFrame, mode: str = "json") -> DataFrame:
    """Sorted distinct tags over all cells (``mode`` as in :func:`parse_tags`)."""
    return (
        posexplode_rows(df, [], parse_tags(F.col("tags"), mode), value="tag")
        .select("tag")
        .distinct()
        .orderBy("tag")
    )


def score_bounds(df: DataFrame, score: str = "correct_fields") -> DataFrame:
    """Integer bounds of the score for the range inputs; 0 / 15 when there is nothing."""
    if score not in df.columns:
        return df.sparkSession.createDataFrame([(0, 15)], "n_min int, n_max int")
    x = _nan_to_null(F.col(score))
    return df.agg(
        F.coalesce(F.min(x).cast("int"), F.lit(0)).alias("n_min"),
        F.coalesce(F.max(x).cast("int"), F.lit(15)).alias("n_max"),
    )


def table_sort(df: DataFrame, by: Sequence[tuple[str, bool]], tiebreak: str = "id") -> DataFrame:
    """User sort (column, ascending) with a tie-break for a total order."""
    order = [F.col(c).asc_nulls_last() if asc else F.col(c).desc_nulls_last() for c, asc in by]
    if tiebreak not in [c for c, _ in by]:
        order.append(F.col(tiebreak).asc())
    return df.orderBy(*order)


_OPS = {
    "=": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}


def table_filter(df: DataFrame, predicates: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Per-column filters ``(column, op, value)`` with ops ``= != < <= > >= contains``."""
    preds = []
    for col, op, value in predicates:
        c = F.col(col)
        if op == "contains":
            preds.append(F.coalesce(c.cast("string").contains(str(value)), F.lit(False)))
        elif op in _OPS:
            preds.append(F.coalesce(_OPS[op](c, F.lit(value)), F.lit(False)))
        else:
            raise ValueError(f"unknown operator {op!r}; known: {sorted(_OPS) + ['contains']}")
    return df.where(reduce(operator.and_, preds)) if preds else df


#: Rows that an offset may skip: every task sorts and keeps as many.
MAX_OFFSET = 10_000


def table_page(df: DataFrame, page: int, page_size: int = 25, order=(("timestamp", False),), tiebreak: str = "id") -> DataFrame:
    """One page of the sorted table (a top-k: each task keeps only offset + limit rows).

    For the first pages of any order. Deep pages are refused: take :func:`table_page_after`, or the clustered store's
    ``page``, which finds any page of the time order by its number."""
    if page * page_size > MAX_OFFSET:
        raise ValueError(f"page {page} skips more than {MAX_OFFSET} rows: use table_page_after or ResultStore.page")
    return table_sort(df, order, tiebreak).offset(page * page_size).limit(page_size)


def table_page_after(df: DataFrame, after: tuple | None, page_size: int = 25, ts_col: str = "timestamp",
                     key_col: str = "id") -> DataFrame:
    """A17 for deep pages: keyset pagination on (timestamp desc, id asc) after the last row shown.

    Unlike an offset, the cost does not grow with the page number: the predicate is pushed to
    the scan and each task keeps only ``page_size`` rows.
    """
    ordered = df
    if after is not None:
        last_ts, last_id = after
        ts, key = F.col(ts_col), F.col(key_col)
        if last_ts is None:
            ordered = df.where(ts.isNull() & (key > F.lit(last_id)))
        else:
            ordered = df.where(ts.isNull() | (ts < F.lit(last_ts)) | ((ts == F.lit(last_ts)) & (key > F.lit(last_id))))
    return table_sort(ordered, ((ts_col, False),), key_col).limit(page_size)


def row_detail(df: DataFrame, keys, key_col: str = "id") -> DataFrame:
    """Detail of the rows of one key or several, with blanks shown as ``—`` / ``""``, reasons as text and
    pretty JSON. Over a :class:`folio.sources.store.ResultStore` pass ``store.lookup(keys)``: the key filter is then
    answered by bloom filters."""
    from ..functions.jsontext import pretty_json

    keys = list(keys) if isinstance(keys, (list, tuple, set)) else [keys]
    dash = F.lit("—")
    cols = set(df.columns)

    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in cols else F.lit(None).cast("string")

    header = F.concat(
        F.lit("id: "), F.coalesce(F.col(key_col).cast("string"), dash),
        F.lit("  |  doc: "), F.coalesce(F.col("doc").cast("string"), dash) if "doc" in cols else dash,
        F.lit("  |  model: "), F.coalesce(F.col("model").cast("string"), dash) if "model" in cols else dash,
        F.lit("  |  correct_fields: "),
        F.coalesce(F.col("correct_fields").cast("string"), dash) if "correct_fields" in cols else dash,
    )
    return df.where(F.col(key_col).isin(keys)).select(
        F.col(key_col),
        header.alias("header"),
        text("correct_fields_reason").alias("correct_fields_reason"),
        text("format_compliance_reason").alias("format_compliance_reason"),
        pretty_json(text("expected")).alias("expected_pretty"),
        pretty_json(text("generated")).alias("generated_pretty"),
    )


REASON_COLUMNS = {"correct_fields": "correct_fields_reason", "format_compliance": "format_compliance_reason"}


def reason_bullets(df: DataFrame, key_col: str = "id") -> DataFrame:
    """Non-blank reasons of each metric as bullet lines ``- reason``.

    The bullet list stays distributed (one row per line, ordered by ``metric, key``); a sink
    writes it as text. Nothing is gathered into one row, so the list can be any length.
    """
    pairs = [
        F.struct(F.lit(metric).alias("metric"), F.col(reason).cast("string").alias("reason"))
        for metric, reason in REASON_COLUMNS.items()
        if reason in df.columns
    ]
    # One scan: the reasons of a row are unpivoted by a generator.
    rows = df.select(F.col(key_col), F.explode(F.array(*pairs)).alias("r"))
    said = F.col("r.reason")
    return rows.where(said.isNotNull() & (py_strip(said) != "")).select(
        F.col("r.metric").alias("metric"), F.col(key_col), F.concat(F.lit("- "), said).alias("line")
    )


def summary_prompt(metric_name: str) -> str:
    """The header of the summary prompt; the bullet lines follow it."""
    # Summary prompt text.
    return (
        "You are analyzing evaluation results for an OCR/LLM document extraction system.\n"
        f"The following are judge LLM explanations for the metric '{metric_name}'"
        " across multiple test cases.\n"
        "Summarize the most common mistakes or patterns concisely and actionably.\n\n"
        "Reasons:\n"
    )


# Messages for empty inputs.
NO_DATA = "No data to summarize."
NO_REASONS = "No reasons available to summarize."


def top_mistakes(verdicts: DataFrame, k: int | None = 3, by: str = "model") -> DataFrame:
    """The most frequent non-correct (field, verdict) pairs per model (``k=None``: all of them).

    Aggregate first (partial + final), then rank: the window only sees one row per
    (model, field, verdict), so its partitions stay tiny whatever the input size.
    """
    counts = (
        verdicts.where(F.col("verdict") != scoring.CORRECT)
        .groupBy(by, "field", "verdict")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    w = Window.partitionBy(by).orderBy(F.col("n").desc(), F.col("field"), F.col("verdict"))
    ranked = counts.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def summary_status(df: DataFrame) -> DataFrame:
    """Per metric, how many non-blank reasons there are and the message to show instead of
    a summary when there are none (or when the table is empty). One aggregate, no collection."""
    known = {m: r for m, r in REASON_COLUMNS.items() if r in df.columns}
    said = {m: F.col(r).cast("string") for m, r in known.items()}
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(t.isNotNull() & (py_strip(t) != "")).alias(m) for m, t in said.items()],
    )
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("n")) for m in known]
    rows = counts.select("n_rows", F.explode(F.array(*pairs)).alias("r"))
    message = F.when(F.col("n_rows") == 0, F.lit(NO_DATA)).when(F.col("r.n") == 0, F.lit(NO_REASONS))
    return rows.select("r.metric", F.col("r.n").cast("bigint").alias("n_reasons"), message.alias("message"))
