"""Column functions and the semantic traps they settle (one test per named behaviour)."""

import pytest
from pyspark.sql import functions as F

from folio import functions as fn
from folio.functions.jsontext import parse_object_strict, pretty_json


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("y")).first()["y"]


def test_py_strip_removes_all_whitespace_not_only_spaces(spark):
    # Spark trim only removes spaces; Python strip removes every whitespace character.
    assert one(spark, fn.py_strip(F.col("x")), "\n\t  a b \r\n ") == "a b"
    assert one(spark, F.trim(F.col("x")), "\n a \n") == "\n a \n"


def test_fence_strip_and_fenced(spark):
    text = '```json\n{"a": "1"}\n```'
    assert one(spark, fn.fence_strip(F.col("x")), text) == '{"a": "1"}'
    assert one(spark, fn.is_fenced(F.col("x")), text) is True
    assert one(spark, fn.raw_valid_json(F.col("x")), text) is False
    assert one(spark, fn.fence_strip(F.col("x")), '{"a": "1"}') == '{"a": "1"}'
    assert one(spark, fn.fence_strip(F.col("x")), '```\n{"a": 1}\n```  ') == '{"a": 1}'


def test_parse_object_lenient_cases(spark):
    p = fn.parse_object(F.col("x"), strip_fence=False)
    assert one(spark, p, '{"a":"1","b":2,"c":{"d":1},"e":null}') == {"a": "1", "b": "2", "c": '{"d":1}', "e": None}
    assert one(spark, p, '{"a":"1","a":"2"}') == {"a": "2"}
    # from_json alone accepts trailing prose; the object check rejects it.
    assert one(spark, p, '{"a":"1"} trailing') is None
    for bad in ["[1]", '"str"', "", "{bad", '```json\n{"a":"1"}\n```', None]:
        assert one(spark, p, bad) is None, bad
    # default mode strips a fence first
    assert one(spark, fn.parse_object(F.col("x")), '```json\n{"a":"1"}\n```') == {"a": "1"}


def test_parse_object_strict(spark):
    p = parse_object_strict(F.col("x"))
    assert one(spark, p, '{"a": "1", "n": 2}') == {"a": "1", "n": "2"}
    assert one(spark, p, '{"a":"1"} trailing') is None
    assert one(spark, p, "[1]") is None


def test_pretty_json_and_fallbacks(spark):
    assert one(spark, pretty_json(F.col("x")), '{"a":"é"}') == '{\n  "a": "é"\n}'
    assert one(spark, pretty_json(F.col("x")), "not json") == "not json"
    assert one(spark, pretty_json(F.col("x")), None) == ""


def test_parse_tags_json_or_comma_split(spark):
    t = fn.parse_tags(F.col("x"))
    assert one(spark, t, '["background"]') == ["background"]
    assert one(spark, t, '["background","tilt"]') == ["background", "tilt"]
    assert one(spark, t, "[]") == []
    assert one(spark, t, " a , b ,, ") == ["a", "b"]
    assert one(spark, t, None) is None


def test_tag_filters_any_and_all(spark):
    df = spark.createDataFrame([('["a","b"]',), ('["b"]',), (None,), ("[]",)], "x string")
    got = [r[0] for r in df.select(fn.has_any_tag(F.col("x"), ["a", "z"])).collect()]
    assert got == [True, False, False, False]  # NULL cell is false, not NULL
    arr = df.select(fn.parse_tags(F.col("x")).alias("t"))
    got = [r[0] for r in arr.select(fn.has_all_tags(F.col("t"), ["a", "b"])).collect()]
    assert got == [True, False, False, False]


def test_demote_headings(spark):
    src = "# a\n###### b\nc # d\n##e"
    assert one(spark, fn.demote_headings(F.col("x")), src) == "## a\n####### b\nc # d\n###e"


def test_preview_both_modes_count_code_points(spark):
    arabic = "مرحبا بالعالم"  # 13 code points
    assert one(spark, fn.preview(F.col("x"), 5), arabic) == "مرحبا..."
    assert one(spark, fn.preview(F.col("x"), 100), arabic) == arabic
    assert one(spark, fn.preview(F.col("x"), 100, always_ellipsis=True), arabic) == arabic + "..."


def test_strip_echo(spark):
    df = spark.createDataFrame([("Hi there\n  answer \n", "Hi there"), ("  other ", "Hi")], "t string, p string")
    got = [r[0] for r in df.select(fn.strip_echo(F.col("t"), F.col("p"))).collect()]
    assert got == ["answer", "  other "]


def test_resolve_absolute_replaces_base(spark):
    df = spark.createDataFrame([("ins/a.png",), ("/abs/b.png",)], "p string")
    got = [r[0] for r in df.select(fn.resolve("/data/cin/", F.col("p"))).collect()]
    assert got == ["/data/cin/ins/a.png", "/abs/b.png"]


def test_suffix_and_media_types(spark):
    df = spark.createDataFrame([("a/b.PNG",), ("x.pdf",), ("y.TIFF",), ("z",), (".hidden",), ("d.tar.gz",)], "p string")
    got = df.select(fn.suffix(F.col("p")), fn.media_type(F.col("p")), fn.block_type(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [
        (".PNG", "image/png", "image"),
        (".pdf", "application/pdf", "document"),
        (".TIFF", None, "image"),
        ("", None, "image"),
        ("", None, "image"),
        (".gz", None, "image"),
    ]


def test_layout_round_trip(spark):
    text = "a  b\n\nc d e\n" + "\n".join(f"line {i}" for i in range(45))
    df = spark.createDataFrame([(text,)], "x string")
    layout = df.select(fn.text_to_layout(F.col("x"), 20).alias("pages"))
    assert layout.select(F.size("pages")).first()[0] == 3
    assert layout.select(fn.layout_to_text(F.col("pages"))).first()[0] == text


def test_tags_split_mode_is_the_dashboard_rule(spark):
    # The dashboard splits the cell text on ',' and strips; JSON cells keep their brackets.
    df = spark.createDataFrame([('["a","b"]',), ('["a"]',), ("[]",), (" x , ,y",), (None,)], "x string")
    got = [r[0] for r in df.select(fn.parse_tags(F.col("x"), mode="split")).collect()]
    assert got == [['["a"', '"b"]'], ['["a"]'], ["[]"], ["x", "y"], None]
    hit = [r[0] for r in df.select(fn.has_any_tag(F.col("x"), ['["a"]'], mode="split")).collect()]
    assert hit == [False, True, False, False, False]
    json_mode = [r[0] for r in df.select(fn.has_any_tag(F.col("x"), ["a"])).collect()]
    assert json_mode == [True, True, False, False, False]
    with pytest.raises(ValueError):
        fn.parse_tags(F.col("x"), mode="other")


def test_timestamp_texts_ignore_the_session_zone(spark):
    # 2021-03-14 02:30 does not exist in New York (clocks jump from 02:00 to 03:00).
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2021-03-14 02:30:00",), ("2021-03-14 02:30:00.5",)], "s string").select(
            F.col("s").cast("timestamp_ntz").alias("t")
        )
        got = df.select(fn.iso_text("t"), fn.iso_seconds("t"), fn.stamp_text("t")).collect()
        assert [tuple(r) for r in got] == [
            ("2021-03-14T02:30:00", "2021-03-14T02:30:00", "20210314_023000"),
            ("2021-03-14T02:30:00.500000", "2021-03-14T02:30:00", "20210314_023000"),
        ]
        # An instant is written as Python's isoformat() of a UTC datetime.
        inst = spark.range(1).select(F.timestamp_seconds(F.lit(1772928000)).alias("u"), F.timestamp_micros(F.lit(1772928000000001)).alias("v"))
        assert tuple(inst.select(fn.iso_utc_text("u"), fn.iso_utc_text("v")).first()) == (
            "2026-03-08T00:00:00+00:00",
            "2026-03-08T00:00:00.000001+00:00",
        )
        # Date filters compare naive values with naive bounds.
        from folio.operators.analytics import FilterSpec

        rows = spark.createDataFrame([("2021-03-14T02:30:00",), ("2021-03-16T00:00:00",), ("2021-03-16T00:00:01",)], "timestamp string")
        kept = FilterSpec(start_date="2021-03-14", end_date="2021-03-15").apply(rows).collect()
        assert sorted(r.timestamp for r in kept) == ["2021-03-14T02:30:00", "2021-03-16T00:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_json_object_with_surrounding_newlines_parses(spark):
    assert one(spark, fn.parse_object(F.col("x")), '{"a": "1"}\n') == {"a": "1"}
    assert one(spark, fn.parse_object(F.col("x")), '\r\n\t{"a": "1"} ') == {"a": "1"}
    assert one(spark, fn.parse_object(F.col("x")), '{"a": "1"} trailing') is None
