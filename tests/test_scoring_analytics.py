"""Scoring (J1-J9), triage (T-*) and analytics (A*) on small hand-made frames."""

import json
import math

import pytest
from pyspark.sql import functions as F

from folio.operators import analytics as A
from folio.operators import scoring as S
from folio.operators import triage as TR

TRUTH = {"prenom": "ZAINEB", "nom": "EL", "id_document_recto": "U1234587", "initiales": ""}
FIELDS = list(TRUTH)


def results_frame(spark):
    exp = json.dumps(TRUTH)
    gens = [
        (1, "```json\n" + json.dumps(TRUTH) + "\n```"),  # all correct, fenced
        (2, json.dumps({**TRUTH, "nom": "X", "initiales": "AB"})),  # mismatch + hallucinated
        (3, json.dumps({k: v for k, v in TRUTH.items() if k != "nom"})),  # key missing
        (4, json.dumps({**TRUTH, "prenom": None})),  # JSON null = missing, keys same
        (5, "I cannot read this image."),
        (6, json.dumps({**TRUTH, "extra": "1"})),
    ]
    return spark.createDataFrame([(i, exp, g) for i, g in gens], "id long, expected string, generated string")


@pytest.mark.parametrize("fields", [None, FIELDS])
def test_scores_and_reasons(spark, fields):
    out = S.with_scores(results_frame(spark), fields=fields).orderBy("id").collect()
    assert [r.correct_fields for r in out] == [4.0, 2.0, 3.0, 3.0, 0.0, 4.0]
    assert [r.format_compliance for r in out] == ["correct", "correct", "incorrect", "correct", "incorrect", "incorrect"]
    assert out[1].correct_fields_reason == "prenom=correct, nom=mismatch, id_document_recto=correct, initiales=hallucinated"
    assert out[2].format_compliance_reason == "missing: nom; extra: "
    assert out[4].format_compliance_reason == "not a JSON object"
    assert out[5].format_compliance_reason == "missing: ; extra: extra"


def test_field_verdicts_and_accuracy(spark):
    v = S.field_verdicts(results_frame(spark), keys=("id",))
    assert v.count() == 24
    got = {(r.id, r.field): r.verdict for r in v.collect()}
    assert got[(4, "prenom")] == "missing" and got[(2, "initiales")] == "hallucinated"
    assert got[(5, "nom")] == "missing" and got[(1, "initiales")] == "correct"
    acc = {r.field: (r.n, r.n_correct) for r in S.field_accuracy(v).collect()}
    assert acc["prenom"] == (6, 4) and acc["nom"] == (6, 3)


def test_rule_check(spark):
    df = spark.createDataFrame(
        [("date_naissance", "05.12.1983"), ("date_naissance", "05/12/1983"), ("initiales", ""), ("nationalite", ""),
         ("id_document_recto", "K01234567"), ("nom", None)],
        "field string, value string",
    )
    got = [r[0] for r in df.select(S.rule_check(F.col("field"), F.col("value"))).collect()]
    assert got == [True, False, True, False, True, None]


def test_score_domain(spark):
    df = spark.createDataFrame(
        [(1, 3.0, "correct"), (2, float("nan"), "maybe"), (3, 9.0, None), (4, None, "incorrect")],
        "id long, judge_fields double, judge_format string",
    )
    got = {r.id: r for r in S.score_domain(df).collect()}
    assert got[1].fields_score == 3.0 and got[1].fields_error is None and got[1].format_score == "correct"
    assert got[2].fields_score is None and got[2].fields_error == "not_a_number" and got[2].format_error == "not_allowed"
    assert got[3].fields_error == "out_of_range" and got[3].format_error == "missing"
    assert got[4].fields_error == "missing"


def test_judge_prompt_never_replaces_inside_values(spark):
    df = spark.createDataFrame([("says {expected}", "{}")], "g string, e string")
    p = df.select(S.judge_prompt(F.col("g"), F.col("e"))).first()[0]
    assert p == "Check if the format of this generated reponse: says {expected} is same as the expected format {}. Return 'correct' or 'incorrect'."


def scored_frame(spark):
    rows = [
        ("1", "cin", "m", "v1", '["a"]', "2026-03-08T21:05:26.544783", 2.0, 3.0, "correct"),
        ("2", "cin", "m", "v1", None, "2026-03-08T21:05:36", 4.0, float("nan"), "incorrect"),
        ("3", "cin", "m", "v1", "[]", "bad", 6.0, 8.0, None),
        ("4", "cin", None, "v1", "[]", "2026-03-09T00:00:00", 8.0, 1.0, "incorrect"),
        ("5", "other", "m", "v1", "[]", "2026-03-10T00:00:00.000001", 1.0, 1.0, "correct"),
    ]
    return spark.createDataFrame(
        rows,
        "id string, doc string, model string, prompt_version string, tags string, timestamp string, "
        "execution_time double, correct_fields double, format_compliance string",
    )


def test_leaderboard_traps(spark):
    lb = A.leaderboard(scored_frame(spark)).collect()
    assert len(lb) == 1  # NULL model dropped, other doc excluded
    r = lb[0]
    assert r.n_rows == 3
    assert r.avg_correct_fields == pytest.approx(5.5)  # NaN skipped: (3 + 8) / 2
    assert r.pct_format_incorrect == pytest.approx(100 / 3)  # NULL stays in the denominator
    assert r.avg_execution_time == pytest.approx(4.0)


def test_filters(spark):
    df = scored_frame(spark)
    ids = lambda spec: sorted(r.id for r in spec.apply(df).collect())
    assert ids(A.reset_filters()) == ["1", "2", "3", "4", "5"]
    assert ids(A.FilterSpec(tags=("a",))) == ["1"]
    # end date is inclusive of the next midnight; 'bad' drops out only with a date filter
    assert ids(A.FilterSpec(end_date="2026-03-08")) == ["1", "2", "4"]
    assert ids(A.FilterSpec(start_date="2026-03-09")) == ["4", "5"]
    # NaN is not >= 0; 0 is a real bound
    assert ids(A.FilterSpec(ncorrect_min=0)) == ["1", "3", "4", "5"]
    assert ids(A.FilterSpec(ncorrect_max=1)) == ["4", "5"]
    assert ids(A.FilterSpec(models=("m",), format_compliance=("correct",))) == ["1", "5"]


def test_facets_and_bounds(spark):
    df = scored_frame(spark)
    assert [tuple(r) for r in A.facet_values(df, ("model", "doc")).collect()] == [
        ("doc", "cin"), ("doc", "other"), ("model", "m")
    ]
    assert [r.tag for r in A.facet_tags(df).collect()] == ["a"]
    assert tuple(A.score_bounds(df).first()) == (1, 8)
    empty = df.where("false")
    assert tuple(A.score_bounds(empty).first()) == (0, 15)
    assert tuple(A.score_bounds(df.drop("correct_fields")).first()) == (0, 15)


def test_table_sort_filter_page(spark):
    df = scored_frame(spark)
    assert [r.id for r in A.table_sort(df, [("execution_time", False)]).collect()] == ["4", "3", "2", "1", "5"]
    got = A.table_filter(df, [("execution_time", ">=", 2.0), ("tags", "contains", "[")]).collect()
    assert sorted(r.id for r in got) == ["1", "3", "4"]
    page = A.table_page(df, page=1, page_size=2, order=(("execution_time", True),)).collect()
    assert [r.id for r in page] == ["2", "3"]


def test_reason_bullets_skip_blank(spark):
    df = spark.createDataFrame(
        [(1, "a", "  "), (2, None, "b"), (3, "c", "")], "id long, correct_fields_reason string, format_compliance_reason string"
    )
    got = sorted(tuple(r) for r in A.reason_bullets(df).collect())
    assert got == [("correct_fields", 1, "- a"), ("correct_fields", 3, "- c"), ("format_compliance", 2, "- b")]


def test_triage_checks(spark):
    df = spark.createDataFrame(
        [(1, "PNG", 2048, 1280, 4, False), (2, "jpg", 2048, 1281, 4, False), (3, None, 10, 10, 3, False),
         (4, "GIF", 10, 10, 3, False), (5, "PNG", 10, 10, 3, True)],
        "id long, format string, width int, height int, channels int, missing boolean",
    )
    got = {r.id: (r.status, r.error_class) for r in TR.triage_status(df).collect()}
    assert got == {1: (200, None), 2: (400, "too_large"), 3: (200, None), 4: (400, "unsupported_format"),
                   5: (404, "not_found")}
    ok = [r[0] for r in df.select(TR.format_ok(F.col("format"), TR.API_FORMATS)).collect()]
    assert ok == [True, True, True, True, True]


def test_prompt_and_source_rules(spark):
    df = spark.createDataFrame([("", "p", None), (" ", "", "http://x"), (None, "p", "http://x")], "p string, path string, url string")
    got = [tuple(r) for r in df.select(TR.prompt_ok(F.col("p")), TR.source_xor(F.col("path"), F.col("url"))).collect()]
    assert got == [(False, True), (True, True), (False, False)]


def test_content_block_base64_single_line(spark):
    data = bytes(range(256)) * 3
    df = spark.createDataFrame([(data, "x.PDF")], "c binary, p string")
    blk = df.select(TR.content_block(F.col("c"), F.col("p")).alias("b")).first()["b"]
    import base64

    assert blk["source"]["data"] == base64.b64encode(data).decode()
    assert blk["type"] == "document" and blk["source"]["media_type"] == "application/pdf"


def test_top_mistakes_ranks_after_aggregation(spark):
    v = spark.createDataFrame(
        [("m", "a", "mismatch")] * 3 + [("m", "b", "missing")] * 2 + [("m", "c", "correct")] * 5 + [("n", "a", "missing")],
        "model string, field string, verdict string",
    )
    got = [tuple(r) for r in A.top_mistakes(v, k=1).orderBy("model").select("model", "field", "verdict", "n").collect()]
    assert got == [("m", "a", "mismatch", 3), ("n", "a", "missing", 1)]
    assert not math.isnan(1.0)


def test_keyset_pages_equal_offset_pages(spark):
    df = spark.createDataFrame(
        [(i, None if i % 7 == 0 else f"2026-01-{1 + i % 5:02d}") for i in range(40)], "id long, timestamp string"
    )
    pages, after = [], None
    for _ in range(5):
        page = [(r.timestamp, r.id) for r in A.table_page_after(df, after, page_size=9).collect()]
        if not page:
            break
        pages.extend(page)
        after = page[-1]
    offset_rows = [(r.timestamp, r.id) for p in range(5) for r in A.table_page(df, p, 9).collect()]
    assert pages == offset_rows and len(pages) == 40


def test_summary_status_messages(spark):
    df = spark.createDataFrame([(1, "a", " "), (2, None, "")], "id long, correct_fields_reason string, format_compliance_reason string")
    got = {r.metric: (r.n_reasons, r.message) for r in A.summary_status(df).collect()}
    assert got == {"correct_fields": (1, None), "format_compliance": (0, A.NO_REASONS)}
    got = {r.metric: r.message for r in A.summary_status(df.where("false")).collect()}
    assert got == {"correct_fields": A.NO_DATA, "format_compliance": A.NO_DATA}


def test_parse_timestamp_forms(spark):
    df = spark.createDataFrame([("2026-03-08T21:05:26.544783",), ("2026-03-08T21:05:36",), ("2026-03-08 01:02:03",), ("bad",), (None,)], "t string")
    got = [r[0] for r in df.select(A.parse_timestamp(F.col("t")).cast("string")).collect()]
    assert got == ["2026-03-08 21:05:26.544783", "2026-03-08 21:05:36", "2026-03-08 01:02:03", None, None]


def test_last_duplicate_key_wins_and_other_keys_count(spark):
    rows = [(1, '{"a":"x"}', '{"a":"z","a":"x"}'), (2, '{"a":"x","b":"y"}', '{"a":"x","b":"y"}'), (3, None, '{"a":"x"}'),
            (4, '{"a":"x"}', '{"a":"x"} and {"b":"y"}')]
    df = spark.createDataFrame(rows, "id long, expected string, generated string")
    for fields in (None, ["a"]):
        got = {r.id: r for r in S.with_scores(df, fields=fields).collect()}
        assert got[1].correct_fields == 1.0 and got[1].format_compliance == "correct"
        assert got[2].correct_fields == 2.0 and got[2].correct_fields_reason == "a=correct, b=correct"
        assert got[3].correct_fields is None and got[3].format_compliance is None and got[3].score_error == "missing_truth"
    strict = {r.id: r for r in S.with_scores(df, strict=True).collect()}
    assert strict[4].correct_fields == 0.0 and strict[4].format_compliance == "incorrect" and strict[1].correct_fields == 1.0
