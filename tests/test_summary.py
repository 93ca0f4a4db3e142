"""A20 in levels: bounded prompts, every counted line once, failures are told."""

import re

import pytest
from pyspark.sql import functions as F

from folio.operators import inference as I
from folio.operators import summary as SM


class Adder(I.BaseBackend):
    """Adds up counts; ``limit`` bounds the lines it accepts, ``refuse`` makes it fail on a word."""

    model_id = "adder"

    def __init__(self, limit=7, refuse=None):
        super().__init__()
        self.limit, self.refuse = limit, refuse

    def _generate(self, prompt, settings):
        counts = [int(n) for n in re.findall(r"(?m)^- .*\((\d+)\)$", prompt)]
        if len(counts) > self.limit or not counts:
            raise ValueError(f"{len(counts)} lines")
        if self.refuse and self.refuse in prompt:
            raise RuntimeError("refused")
        return f"- all: counted ({sum(counts)})"


def _lines(spark, sizes):
    rows = [(m, f"key{i:04d}", "extra", i % 9 + 1) for m, n in sizes.items() for i in range(n)]
    return SM.mistake_lines(spark.createDataFrame(rows, "model string, field string, verdict string, n long"), "m")


def _total(n):
    return sum(i % 9 + 1 for i in range(n))


def test_every_line_is_counted_once_over_levels(spark):
    sizes = {"a": 1, "b": 7, "c": 8, "d": 7 * 3 + 1, "e": 500}
    out = {r.model: r for r in SM.summarize(_lines(spark, sizes).repartition(6), Adder, part_lines=7, fan=3).collect()}
    assert {m: r.summary for m, r in out.items()} == {m: f"- all: counted ({_total(n)})" for m, n in sizes.items()}
    assert all(r.success for r in out.values())
    assert {m: r.levels for m, r in out.items()} == {"a": 1, "b": 1, "c": 2, "d": 3, "e": 5}
    assert {m: r.calls for m, r in out.items() if m in "abcd"} == {"a": 1, "b": 1, "c": 3, "d": 4 + 2 + 1}


def test_a_failed_part_is_told_and_left_out(spark):
    out = SM.summarize(_lines(spark, {"a": 20, "b": 5}), lambda: Adder(refuse="key0019"), part_lines=7, fan=3).collect()
    by = {r.model: r for r in out}
    assert by["b"].success and by["b"].summary == f"- all: counted ({_total(5)})"
    lost = int(re.search(r"\((\d+)\)", by["a"].summary).group(1))
    assert not by["a"].success and lost < _total(20)


def test_no_lines_no_summary(spark):
    assert SM.summarize(_lines(spark, {"a": 1}).where("n < 0"), Adder).count() == 0


def test_reasons_are_counted_per_key_and_kind(spark):
    reasons = ["missing: a,b; extra: ", "missing: ; extra: x,a", "not a JSON object", " ", None, "missing: a; extra: x", "free text, of a judge"]
    df = spark.createDataFrame([("m", r) for r in reasons] + [(None, "missing: a; extra: ")], "model string, format_compliance_reason string")
    got = {(r.model, r.field, r.verdict): r.n for r in SM.format_mistakes(df).collect()}
    assert got == {("m", "a", "missing"): 2, ("m", "b", "missing"): 1, ("m", "x", "extra"): 2, ("m", "a", "extra"): 1,
                   ("m", "format", "not a JSON object"): 1, ("m", "format", "free text, of a judge"): 1, (None, "a", "missing"): 1}


@pytest.mark.parametrize("groups", [1, 3])
def test_numbers_are_places_without_a_window_per_group(spark, groups):
    df = spark.range(3000).select(F.when(F.col("id") % groups > 0, F.col("id") % groups).alias("g"), (F.col("id") * 37 % 101).alias("n"), "id")
    got = SM.numbered(df, ["g"], [F.col("n").desc(), F.col("id")])
    by = {}
    for r in got.collect():
        by.setdefault(r.g, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: (-r.n, r.id))
        assert [r["rank"] for r in rows] == list(range(len(rows)))
