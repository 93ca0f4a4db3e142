"""Scoring of extracted JSON against ground truth (J1-J9), all as Column expressions.

The per-field verdicts are computed once, as an array of structs over the expected keys, and
every score and reason is derived from that array: no explode and no shuffle until a query
aggregates by field.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import posexplode_rows
from ..functions.jsontext import last_wins, parse_object, parse_object_strict
from ..functions.text import fence_strip, is_fenced
from ..schemas import FIELD_RULES

# Verdict labels, checked in this order.
MISSING, CORRECT, HALLUCINATED, MISMATCH = "missing", "correct", "hallucinated", "mismatch"
# Allowed values of the two judge metrics.
FORMAT_VALUES = ("correct", "incorrect")
FIELD_RANGE = (0, 8)


def verdict(ev: Column, gv: Column) -> Column:
    """Verdict of one field, checked in order: missing, correct, hallucinated, mismatch."""
    return (
        F.when(gv.isNull(), F.lit(MISSING))
        .when(gv == ev, F.lit(CORRECT))
        .when(ev == "", F.lit(HALLUCINATED))
        .otherwise(F.lit(MISMATCH))
    )


def _verdicts(e: Column, g: Column) -> Column:
    """array<struct<field, expected, generated, verdict>> over the expected keys, in document order."""

    def one(k):
        ev = F.try_element_at(e, k)
        gv = F.when(g.isNotNull(), F.try_element_at(g, k))
        return F.struct(k.alias("field"), ev.alias("expected"), gv.alias("generated"), verdict(ev, gv).alias("verdict"))

    return F.transform(F.map_keys(e), one)


# Why a row has no scores.
MISSING_TRUTH, FAILED_CALL = "missing_truth", "failed_call"


def with_scores(df: DataFrame, expected: str = "expected", generated: str = "generated",
                fields: Sequence[str] | None = None, failed: Column | None = None, strict: bool = False,
                truth: bool = False) -> DataFrame:
    """Add ``correct_fields`` (J1), ``format_compliance`` (J2), their reasons (J4) and ``score_error``.

    ``fields``: the document kind's field list, when known. Their verdicts are then plain CASE
    expressions over map lookups; expected keys outside the list are scored as well, by the
    generic way, so both ways score every expected key. ``failed`` marks rows whose model call
    failed: they, and rows without a ground-truth object, are not scorable (NULL scores and a
    ``score_error``), which is not the same as wrong. ``strict``: the answer must be one JSON text
    (Python's parser), with nothing after it. ``truth``: :func:`with_truth` has parsed the truths, with the same ``fields``.
    """
    out = with_verdicts(df, expected, generated, fields, failed, strict, truth)
    return out.drop("_e", "_g", "_verdicts", *[c for c in out.columns if c.startswith(("_v_", "_ev_", "_gv_"))])


def with_truth(df: DataFrame, expected: str = "expected", fields: Sequence[str] | None = None) -> DataFrame:
    """Add the parsed ground truth, for tables in which a truth stands for several answers: it is parsed once, and
    :func:`with_scores` (``truth=True``) takes it from the rows."""
    staged = df.withColumn("_e", parse_object(F.col(expected), strip_fence=False)).withColumn("_e", last_wins("_e"))
    return staged.withColumns({f"_ev_{f}": F.try_element_at(F.col("_e"), F.lit(f)) for f in fields}) if fields else staged


def _parsed(df: DataFrame, expected: str, generated: str, strict: bool = False, truth: bool = False) -> DataFrame:
    # The stripped text is its own column: referenced three times by the parse, it is then
    # computed once instead of being inlined into each reference.
    staged = df.withColumn("_gtext", fence_strip(F.col(generated)))
    g = parse_object_strict(F.col("_gtext")) if strict else parse_object(F.col("_gtext"), strip_fence=False)
    parsed = {"_g": g} if truth else {"_e": parse_object(F.col(expected), strip_fence=False), "_g": g}
    staged = staged.withColumns(parsed).drop("_gtext")
    if truth:  # a truth's keys do not repeat, so neither do those of an answer with the same ones
        return staged.withColumn("_g", F.when(F.map_keys("_g") == F.map_keys("_e"), F.col("_g")).otherwise(last_wins("_g")))
    return staged.withColumns({c: last_wins(c) for c in parsed})


def with_verdicts(df: DataFrame, expected: str = "expected", generated: str = "generated",
                  fields: Sequence[str] | None = None, failed: Column | None = None, strict: bool = False,
                  truth: bool = False) -> DataFrame:
    staged = _parsed(df, expected, generated, strict, truth)
    e, g = F.col("_e"), F.col("_g")
    if fields:
        in_truth = {f"_ev_{f}": F.try_element_at(e, F.lit(f)) for f in fields}
        in_answer = {f"_gv_{f}": F.when(g.isNotNull(), F.try_element_at(g, F.lit(f))) for f in fields}
        if not truth:
            staged = staged.withColumns(in_truth | in_answer)
        # Expected keys outside the list (none, for well-formed truths) go the generic way. There are none where
        # each expected key is accounted for by a value of a listed field. What is evaluated by lambdas stands here, so
        # that all that follows is compiled into one step and no row of looked up values is built.
        others = F.map_filter(e, lambda k, _: ~k.isin(list(fields)))
        listed = sum((F.col(f"_ev_{f}").isNotNull().cast("int") for f in dict.fromkeys(fields)), F.lit(0))
        rest = _verdicts(others, g)
        named = F.array_compact(F.transform(rest, lambda x: F.concat(x["field"], F.lit("="), x["verdict"])))
        more = F.size(e) > listed
        staged = staged.withColumns({"_v_others": F.when(more, rest), "_v_others_named": F.when(more, named)})
        if truth:
            staged = staged.withColumns(in_answer)
        staged = staged.withColumns(
            {f"_v_{f}": F.when(F.col(f"_ev_{f}").isNotNull(), verdict(F.col(f"_ev_{f}"), F.col(f"_gv_{f}"))) for f in fields}
        )
        vcols = [(f, F.col(f"_v_{f}")) for f in fields]
        rest = F.coalesce(F.col("_v_others"), F.array().cast(staged.schema["_v_others"].dataType))
        n_correct = sum((F.coalesce((vc == CORRECT).cast("int"), F.lit(0)) for _, vc in vcols), F.lit(0))
        n_correct = n_correct + F.size(rest) - F.size(F.array_remove(rest["verdict"], CORRECT))
        fields_reason = F.concat_ws(", ", *[F.concat(F.lit(f + "="), vc) for f, vc in vcols], F.col("_v_others_named"))
        # Entries for fields the expected object lacks have a NULL verdict; explode_verdicts drops them.
        verdicts = F.concat(
            F.array(
                *[
                    F.struct(F.lit(f).alias("field"), F.col(f"_ev_{f}").alias("expected"),
                             F.col(f"_gv_{f}").alias("generated"), vc.alias("verdict"))
                    for f, vc in vcols
                ]
            ),
            rest,
        )
    else:
        staged = staged.withColumn("_verdicts", _verdicts(e, g))
        v = F.col("_verdicts")
        n_correct = F.size(F.filter(v, lambda x: x["verdict"] == CORRECT))
        fields_reason = F.array_join(F.transform(v, lambda x: F.concat(x["field"], F.lit("="), x["verdict"])), ", ")
        verdicts = v
    ek, gk = F.map_keys(e), F.map_keys(g)
    # A column of its own: it is compared once for the verdict and the reason. Keys do not repeat, so they are sorted
    # only where there are as many in another order.
    reordered = (F.size(ek) == F.size(gk)) & (F.sort_array(ek) == F.sort_array(gk))
    staged = staged.withColumn("_v_same_keys", g.isNotNull() & ((ek == gk) | reordered))
    same_keys = F.col("_v_same_keys")
    format_reason = (
        F.when(g.isNull(), F.lit("not a JSON object"))
        .when(same_keys, F.lit(""))
        .otherwise(
            F.concat(
                F.lit("missing: "),
                F.array_join(F.sort_array(F.array_except(ek, gk)), ","),
                F.lit("; extra: "),
                F.array_join(F.sort_array(F.array_except(gk, ek)), ","),
            )
        )
    )
    error = F.when(F.coalesce(failed, F.lit(False)), F.lit(FAILED_CALL)) if failed is not None else None
    missing = e.isNull()
    error = F.when(missing, F.lit(MISSING_TRUTH)) if error is None else error.when(missing, F.lit(MISSING_TRUTH))
    scorable = error.isNull()
    return staged.withColumns(
        {
            "_verdicts": F.when(scorable, verdicts),
            "correct_fields": F.when(scorable, F.when(g.isNull(), F.lit(0.0)).otherwise(n_correct.cast("double"))),
            "correct_fields_reason": F.when(scorable, fields_reason),
            "format_compliance": F.when(scorable, F.when(same_keys, F.lit("correct")).otherwise(F.lit("incorrect"))),
            "format_compliance_reason": F.when(scorable, format_reason),
            "score_error": error,
        }
    )


def fence_report(df: DataFrame, generated: str = "generated") -> DataFrame:
    """Is the answer fenced, is the raw text an object, is the fence-stripped text an object."""
    g = F.col(generated)
    return df.select(
        "id",
        is_fenced(g).alias("fenced"),
        F.coalesce(parse_object(g, strip_fence=False).isNotNull(), F.lit(False)).alias("raw_valid_json"),
        F.coalesce(parse_object(g).isNotNull(), F.lit(False)).alias("stripped_valid_json"),
        F.length(fence_strip(g)).alias("stripped_length"),
    )


def field_verdicts(df: DataFrame, keys: Sequence[str] = ("id", "model", "prompt_version"),
                   expected: str = "expected", generated: str = "generated") -> DataFrame:
    """One row per (result, expected field) with its verdict.

    The expected map's entries are exploded and each verdict is computed after the explode,
    so both parsed maps stay column references (computing an array of verdict structs first
    lets nested-field pruning copy the parse into every extracted field).
    """
    staged = df.select(*keys, F.col(expected), fence_strip(F.col(generated)).alias("_gtext")).select(
        *keys,
        parse_object(F.col(expected), strip_fence=False).alias("_e"),
        parse_object(F.col("_gtext"), strip_fence=False).alias("_g"),
    ).select(*keys, last_wins("_e").alias("_e"), last_wins("_g").alias("_g"))
    exploded = posexplode_rows(staged, [*keys, "_g"], F.map_entries("_e"), value="kv")
    ev = F.col("kv.value")
    gv = F.when(F.col("_g").isNotNull(), F.try_element_at(F.col("_g"), F.col("kv.key")))
    return exploded.select(
        *keys,
        (F.col("pos") + 1).alias("field_pos"),
        F.col("kv.key").alias("field"),
        ev.alias("expected_value"),
        gv.alias("generated_value"),
        verdict(ev, gv).alias("verdict"),
    )


def explode_verdicts(scored: DataFrame, keys: Sequence[str] = ("id", "model", "prompt_version"),
                     verdicts_col: str = "verdicts") -> DataFrame:
    """J5 from a stored scored table: explode the kept verdicts (no JSON is parsed again)."""
    return (
        scored.select(*keys, F.posexplode(verdicts_col).alias("pos", "v"))
        .where(F.col("v.verdict").isNotNull())
        .select(
            *keys,
            (F.col("pos") + 1).alias("field_pos"),
            F.col("v.field").alias("field"),
            F.col("v.expected").alias("expected_value"),
            F.col("v.generated").alias("generated_value"),
            F.col("v.verdict").alias("verdict"),
        )
    )


def field_accuracy(verdicts: DataFrame) -> DataFrame:
    """Accuracy per field (partial + final aggregation; as many groups as fields)."""
    ok = F.when(F.col("verdict") == CORRECT, 1).otherwise(0)
    return verdicts.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(ok).cast("bigint").alias("n_correct"),
        F.round(F.avg(ok.cast("double")), 6).alias("accuracy"),
    )


def rule_check(field: Column, value: Column, rules=FIELD_RULES, doc: str = "cin") -> Column:
    """Does the value follow its field's format rule; NULL when there is no value or no rule.

    The rule table is small and fixed, so it becomes one CASE expression with literal patterns
    (compiled once per task) rather than a join.
    """
    expr = None
    for rdoc, rfield, pattern, empty_ok in rules:
        if rdoc != doc:
            continue
        test = F.when(value == "", F.lit(bool(empty_ok))).otherwise(value.rlike(pattern))
        expr = (F.when(field == rfield, test)) if expr is None else expr.when(field == rfield, test)
    if expr is None:
        return F.lit(None).cast("boolean")
    return F.when(value.isNotNull(), expr)


def field_rules(verdicts: DataFrame, rules=FIELD_RULES, doc: str = "cin") -> DataFrame:
    """Count generated values that pass / fail their field's format rule."""
    return (
        verdicts.select("field", rule_check(F.col("field"), F.col("generated_value"), rules, doc).alias("rule_ok"))
        .groupBy("field", "rule_ok")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def score_domain(df: DataFrame, fields_col: str = "judge_fields", format_col: str = "judge_format",
                 field_range=FIELD_RANGE, format_values=FORMAT_VALUES) -> DataFrame:
    """Keep judge scores inside their allowed values; violations become NULL plus an error label."""
    x = F.col(fields_col)
    f = F.col(format_col)
    lo, hi = field_range
    fields_error = (
        F.when(x.isNull(), F.lit("missing"))
        .when(F.isnan(x), F.lit("not_a_number"))
        .when(~x.between(lo, hi), F.lit("out_of_range"))
    )
    format_error = F.when(f.isNull(), F.lit("missing")).when(~f.isin(*format_values), F.lit("not_allowed"))
    return df.select(
        "id",
        F.when(fields_error.isNull(), x).alias("fields_score"),
        fields_error.alias("fields_error"),
        F.when(format_error.isNull(), f).alias("format_score"),
        format_error.alias("format_error"),
    )


# The two judge prompt templates (inserted texts marked {generated} and {expected}).
FORMAT_JUDGE_TEMPLATE = (
    "Check if the format of this generated reponse: {generated} is same as the expected"
    " format {expected}. Return 'correct' or 'incorrect'."
)
FIELDS_JUDGE_TEMPLATE = (
    "We're expected to perform OCR to extract multi-field information from an iage,"
    " How many of the following generated feilds are correct compared to the expected?"
    " \ngenerated: \n{generated} \nexpected: \n{expected}"
)


def judge_prompt(generated: Column, expected: Column, template: str = FORMAT_JUDGE_TEMPLATE) -> Column:
    """Fill a judge template by concatenating its literal pieces around the two texts.

    Never chained ``replace``: a generated text may itself contain ``{expected}``.
    """
    values = {"generated": F.coalesce(generated, F.lit("")), "expected": F.coalesce(expected, F.lit(""))}
    parts: list[Column] = []
    rest = template
    while True:
        hits = [(rest.find("{" + k + "}"), k) for k in values if rest.find("{" + k + "}") >= 0]
        if not hits:
            break
        pos, key = min(hits)
        parts += [F.lit(rest[:pos]), values[key]]
        rest = rest[pos + len(key) + 2 :]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def judge_agreement(df: DataFrame, judge_col: str = "judge_format", computed_col: str = "format_compliance") -> DataFrame:
    """How often the judge's verdict agrees with the computed one."""
    return df.groupBy(F.col(judge_col).alias("judge"), F.col(computed_col).alias("computed")).agg(
        F.count(F.lit(1)).alias("n")
    )


def parse_judge_verdict(text: Column, allowed=FORMAT_VALUES) -> Column:
    """A judge's answer to a verdict: first word, lower case, punctuation dropped;
    NULL when it is not an allowed value."""
    word = F.lower(F.regexp_extract(text, r"^\s*([A-Za-z_]+)", 1))
    return F.when(word.isin(*allowed), word)


def parse_judge_number(text: Column) -> Column:
    """A judge's answer to a number: the first number in it; NULL when there is none."""
    return F.regexp_extract(text, r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
