"""What an evaluation does once per case, and its results in one pass, whatever the number of runs and starts."""

import os
import tempfile

from pyspark.sql import functions as F

from folio import testing as SI
from folio.functions import iso_text, looks_like_object
from folio.operators import evaluation as EV
from folio.operators import inference as I
from folio.operators import scoring as S
from folio.sources import testdata as td

RUNS = [(m, v, td.CARD_PROMPTS[v]) for m in SI.CARD_READERS for v in td.CARD_PROMPTS]


class PickyBackend(I.BaseBackend):
    """Answers with its input; fails on what holds an x."""

    model_id = "picky"

    def _generate(self, text, settings):
        if "x" in text:
            raise ValueError("an x")
        return text.upper()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_truth_is_parsed_once_per_case(spark, sf_small):
    plan = _plan(EV.evaluation_run(td.cases(spark, sf_small), RUNS, SI.CardReaderClient, fields=td.CIN_FIELDS, parse_once=True))
    # The rows of a case's runs are made above its truth's parse and above the model.
    above, below = plan[: plan.index("Generate")], plan[plan.index("Generate"):]
    assert above.count("from_json") == 1 and below[: below.index("MapInPandas")].count("from_json") == 1


def test_variants_of_a_row(spark):
    variants = [{"name": "a", "end": "1"}, {"name": "b", "end": "x"}, {"name": None, "end": "3"}]
    rows = [(1, "p", None, [0, 1, 2]), (2, "q", None, None), (3, "r", "no file", [2, 0]), (4, None, "none", []), (5, "x", None, [2]),
            (6, None, "null", [1])]
    df = spark.createDataFrame(rows, "k long, t string, skip string, wanted array<int>").withColumn("kept", F.col("k") * 10).coalesce(1)
    run = lambda **more: I.run_variants(df, PickyBackend, variants, lambda text, v: text + v["end"], "t", ["k"], ["name"],
                                        carry=["kept"], skip_col="skip", wanted_col="wanted", **more)
    out = run(per_row=lambda r: r.withColumn("twice", F.col("kept") * 2))
    varied = ("twice", "timestamp", "inference_time_seconds")
    assert sorted(map(str, out.drop(*varied).collect())) == sorted(map(str, run().drop(*varied).collect()))
    assert out.columns == ["k", "kept", "twice", "name", *[f.name for f in I.ENVELOPE_FIELDS]]
    got = {(r.k, r.name): r for r in out.collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, None), (3, "a"), (3, None), (5, None), (6, "b")}
    assert all(r.kept == r.k * 10 and r.twice == r.k * 20 and r.timestamp is not None for r in got.values())
    assert got[1, "a"].text == "P1" and got[1, "a"].success and got[1, "a"].error is None and got[1, "a"].model_id == "picky"
    assert got[1, "b"].error == "ValueError: an x" and not got[1, "b"].success and got[1, "b"].text == "" and got[1, "b"].device == "cpu"
    assert got[3, "a"].error == "no file" and got[3, "a"].model_id is None and got[3, "a"].device is None
    assert got[6, "b"].error == "null" and got[5, None].error == "ValueError: an x"


def test_a_truth_parsed_before_scores_the_same(spark):
    texts = [None, "", "{}", ' {"a":"1"}\n', '{"a":"1","b":"2"}', '{"b":"2","a":"1"}', '{"a":"0","a":"1","b":"2"}', '{"a":null,"b":"2"}',
             '{"a":"1","c":"3","d":"4"}', '```json\n{"a":"1","b":"2"}\n```', '{"a":"1"} more', "{", '{"c":"3","a":"","d":null,"z":"9"}']
    df = spark.createDataFrame([(i, j, e, g) for i, e in enumerate(texts) for j, g in enumerate(texts)],
                               "i int, j int, expected string, generated string")
    for fields in (["a", "b"], ["a", "missing"], None):
        one = S.with_scores(df, fields=fields, failed=F.col("j") == 2)
        two = S.with_scores(S.with_truth(df, fields=fields), fields=fields, failed=F.col("j") == 2, truth=True)
        assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
        if fields:  # listed or not, every expected key is scored
            plain = {(r.i, r.j): r for r in S.with_scores(df, failed=F.col("j") == 2).collect()}
            for r in two.collect():
                of = plain[r.i, r.j]
                assert (r.correct_fields, r.format_compliance, r.score_error) == (of.correct_fields, of.format_compliance, of.score_error)
                assert r.format_compliance_reason == of.format_compliance_reason


def test_texts_that_look_like_objects(spark):
    texts = {"{}": True, " {}": True, "{}\n\t": True, "{": False, "}": False, "{} x": False, "x{}": False, "": False, "\x0b{}": False, None: None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", looks_like_object("t").alias("is")).collect()
    assert {r["t"]: r["is"] for r in rows} == texts


def test_times_as_text(spark):
    times = {"2024-02-03 04:05:06": "2024-02-03T04:05:06", "2024-02-03 04:05:06.5": "2024-02-03T04:05:06.500000",
             "2024-02-03 04:05:06.000001": "2024-02-03T04:05:06.000001", None: None}
    df = spark.createDataFrame([(t,) for t in times], "t string")
    got = df.select("t", iso_text(F.col("t").cast("timestamp_ntz")).alias("text")).collect()
    assert {r["t"]: r["text"] for r in got} == times


def test_results_and_calls_in_one_pass(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="results-"), "run")
    schema = "id long, model string, prompt_version string, success boolean, correct_fields double, generated string"
    starts = {1: [(1, "m", "v", False, None, "a1"), (2, "m", "v", True, 2.0, "b1"), (2, "n", "v", True, 3.0, "c1"), (3, "m", "v", False, None, "d1"),
                  (None, "m", "v", True, 1.0, "e1")],
              2: [(1, "m", "v", True, 1.0, "a2"), (2, "m", "v", False, None, "b2"), (3, "m", "v", False, None, "d2"), (4, "m", "v", True, 4.0, "f2"),
                  (4, "m", "v", True, 5.0, "g2")]}
    for n, rows in starts.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/attempt={n}/wave=0")
    out = EV.evaluation_results(spark, path, calls="n")
    plan = _plan(out)
    assert "Window" not in plan and "Join" not in plan
    assert out.columns == ["id", "model", "prompt_version", "success", "correct_fields", "generated", "attempt", "n"]
    got = {(r.id, r.model): (r.attempt, r.success, r.correct_fields, r.generated, r.n) for r in out.collect()}
    assert got.pop((4, "m")) in {(2, True, 4.0, "f2", 2), (2, True, 5.0, "g2", 2)}  # of equal rank: one row as it is
    assert got == {(1, "m"): (2, True, 1.0, "a2", 2), (2, "m"): (1, True, 2.0, "b1", 2), (2, "n"): (1, True, 3.0, "c1", 1),
                   (3, "m"): (2, False, None, "d2", 2), (None, "m"): (1, True, 1.0, "e1", 1)}
    assert "n" not in EV.evaluation_results(spark, path).columns


def test_waves_without_cases(spark):
    rows = [(k, f"scans/{k}.png", bytearray(b"prenom: A"), '{"prenom":"A"}') for k in range(3)]
    cases = spark.createDataFrame(rows, "id long, in string, content binary, expected string")
    path = os.path.join(tempfile.mkdtemp(prefix="empty-"), "run")
    assert EV.resume_evaluation(cases, RUNS, SI.CardReaderClient, path, waves=12) == 3 * len(RUNS)
    assert len(os.listdir(f"{path}/attempt=1")) == 12 and EV.evaluation_results(spark, path).count() == 3 * len(RUNS)
    assert EV.resume_evaluation(cases, RUNS, SI.CardReaderClient, path) == 0
