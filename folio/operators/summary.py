"""A20 in levels: a summary of all counted mistakes, whatever their number, from prompts of bounded length.

Mistakes are counted per key and kind (or per reason, where a judge writes free text), ranked by count over range
partitions, and cut into parts of ``PART_LINES`` lines. Each part is summarised on its own; then ``FAN`` summaries at a
time are summarised together, level by level, until each group has one. Every counted line is in exactly one part, and
every summary in exactly one prompt of the next level. Each level's answers are written before the next one starts, so a
lost executor costs no finished call.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..schemas import Settings
from ..session import written
from . import inference as I
from .analytics import summary_prompt

PART_LINES = 100
FAN = 20
_SIDES = r"(?s)^missing: (.*?); extra: (.*)$"


def format_mistakes(scored: DataFrame, by: str = "model") -> DataFrame:
    """A20 for the second metric: per model how often each key is missing or extra, and how often each other
    format reason occurs, in the shape of :func:`folio.operators.analytics.top_mistakes` (``field``, ``verdict``, ``n``)."""
    reason = F.col("format_compliance_reason").cast("string")
    side = lambda k, kind: F.transform(
        F.filter(F.split(F.regexp_extract(reason, _SIDES, k), ","), lambda x: x != ""),
        lambda x: F.struct(x.alias("field"), F.lit(kind).alias("verdict")),
    )
    other = F.array(F.struct(F.lit("format").alias("field"), reason.alias("verdict")))
    found = F.when(reason.rlike(_SIDES), F.concat(side(1, "missing"), side(2, "extra"))).otherwise(other)
    said = scored.where(reason.isNotNull() & (py_strip(reason) != ""))
    rows = said.select(by, F.explode(found).alias("m")).select(by, "m.field", "m.verdict")
    return rows.groupBy(by, "field", "verdict").agg(F.count(F.lit(1)).alias("n"))


def mistake_lines(counted: DataFrame, metric: str, by: str = "model") -> DataFrame:
    """Counted mistakes as the lines of a summary: ``by``, ``metric``, ``line`` and what they are ranked by."""
    line = F.concat(F.lit("- "), F.col("field"), F.lit(": "), F.col("verdict"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return counted.select(by, F.lit(metric).alias("metric"), "field", "verdict", "n", line.alias("line"))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with each row's number (from 0) inside its group, by range partitions with running counts.

    Like ``row_number`` over a window per group, but a group may be larger than a task: only one row per group and
    range partition is summed up in a window.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    by = [*[F.col(g) for g in group], *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", place), "numbered")
    parts = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    before = F.sum("_rows").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_rows") - F.col("_first")
    parts = parts.select(*[F.col(c).alias(f"_{c}_of") for c in (*group, "_part")], before.alias("_shift"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in (*group, "_part")]  # a NULL group is a group
    out = dealt.join(parts, reduce(Column.__and__, same)).withColumn(name, F.col("_place") + F.col("_shift"))
    return out.select(*df.columns, name)


def _prompts(rows: DataFrame, group: Sequence[str], before: Column, after: str = "\n\nSummary:", between: str = "\n") -> DataFrame:
    """One prompt per group and part of ``rows(group, part, rank, line)``; a part has a bounded number of lines."""
    lines = F.array_sort(F.collect_list(F.struct("rank", "line")))
    joined = F.array_join(F.transform(lines, lambda x: x["line"]), between)
    grouped = rows.groupBy(*group, "part").agg(joined.alias("_lines"), F.max("failed").alias("failed"), F.sum("calls").alias("calls"))
    return grouped.select(*group, "part", F.concat(before, F.col("_lines"), F.lit(after)).alias("prompt"), "failed", "calls")


def _metric_header() -> Column:
    head, tail = summary_prompt("\0").split("\0")
    return F.concat(F.lit(head), F.col("metric"), F.lit(tail))


#: The header of a prompt over summaries.
MERGE = (
    "The following are summaries of evaluation mistakes, each over another part of them. Merge them into one"
    " concise and actionable summary; no mistake is in two of them.\n\nSummaries:\n"
)


def summarize(lines: DataFrame, make_backend: Callable[[], I.Backend], by: str = "model", part_lines: int = PART_LINES,
              fan: int = FAN, settings: Settings = Settings(), **batch) -> DataFrame:
    """One summary per (``by``, metric) over all ``lines`` (of :func:`mistake_lines`): ``summary``, ``success``,
    ``calls`` (of the model) and ``levels``.

    A part whose call failed is left out of the next prompt and makes the whole ``success`` false. ``batch``: further
    arguments of :func:`folio.operators.inference.run_batch`.
    """
    group = [by, "metric"]
    order = [F.col("n").desc(), F.col("field"), F.col("verdict")]
    rows = numbered(lines, group, order).withColumn("part", F.floor(F.col("rank") / part_lines).cast("long"))
    rows = rows.withColumns({"failed": F.lit(False), "calls": F.lit(0).cast("long")})
    prompts = _prompts(rows, group, _metric_header())
    finished, level = [], 0
    while True:
        level += 1
        out = I.run_batch(prompts, make_backend, "prompt", [*group, "part"], settings, carry=["failed", "calls"], **batch)
        answered = out.select(*group, "part", "text", (F.col("failed") | ~F.col("success")).alias("failed"), "success",
                              (F.col("calls") + 1).alias("calls"))
        answered = written(answered, f"summaries-{level}")
        # Parts are numbered without gaps: a group is finished when it has part 0 only.
        last = answered.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.max("part").alias("_last"))
        same = reduce(Column.__and__, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
        answered = answered.join(last, same).drop(*[f"_{g}" for g in group])
        ready = answered.where(F.col("_last") == 0)
        finished.append(ready.select(*group, F.col("text").alias("summary"), (~F.col("failed")).alias("success"), "calls",
                                     F.lit(level).alias("levels")))
        rest = answered.where(F.col("_last") > 0)
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, finished)
        # A failed part keeps its place, without a text.
        rows = rest.select(*group, F.floor(F.col("part") / fan).cast("long").alias("part"), F.col("part").alias("rank"),
                           F.when(F.col("success"), F.col("text")).alias("line"), "failed", "calls")
        prompts = _prompts(rows, group, F.lit(MERGE), between="\n\n")
