"""The evaluation job end to end: grid, chat requests, client, scores, run files."""

import json
import os
import sys
import tempfile

from pyspark.sql import functions as F

from folio import testing as SI
from folio.operators import evaluation as EV
from folio.sources import experiments, sinks

try:  # the failing client below is shipped to the Python workers by value
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:
    pass

TRUTH = {"prenom": "Amal", "nom": "Idrissi", "date_naissance": "01.02.1990", "initiales": ""}
RUNS = [("reader-exact", "v1", "Extract."), ("reader-sloppy", "v2", "Extract, no markdown.")]


class BrokenClient(SI.CardReaderClient):
    def _generate(self, request_json, settings):
        if json.loads(request_json)["model"] == "reader-sloppy":
            raise TimeoutError("model did not answer")
        return super()._generate(request_json, settings)


def _cases(spark):
    printed = "\n".join(f"{k}: {v}" for k, v in TRUTH.items())
    return spark.createDataFrame(
        [("c1", "scans/c1.png", bytearray(printed.encode()), json.dumps(TRUTH), '["a"]'),
         ("c2", "scans/c2.png", bytearray(b""), json.dumps(TRUTH), None)],
        "id string, `in` string, content binary, expected string, tags string",
    )


def test_evaluation_run_scores_each_case_and_run(spark):
    out = EV.evaluation_run(_cases(spark), RUNS, SI.CardReaderClient, fields=list(TRUTH))
    got = {(r.id, r.model): r for r in out.collect()}
    assert len(got) == 4 and all(r.success for r in got.values())
    exact, sloppy, blank = got[("c1", "reader-exact")], got[("c1", "reader-sloppy")], got[("c2", "reader-exact")]
    assert exact.correct_fields == 4.0 and exact.format_compliance == "correct" and exact.generated.startswith("```json")
    assert sloppy.correct_fields == 2.0 and sloppy.format_compliance == "incorrect"  # initiales skipped, date with '/'
    assert sloppy.correct_fields_reason == "prenom=correct, nom=correct, date_naissance=mismatch, initiales=missing"
    assert not sloppy.generated.startswith("```")  # the v2 prompt asks for no markdown
    assert blank.generated == SI.UNREADABLE and blank.correct_fields == 0.0
    assert exact.prompt_version == "v1" and exact.tags == '["a"]' and exact.doc == "cin"
    assert exact.execution_time >= 0 and "T" in exact.timestamp


def test_failing_calls_are_error_rows_and_runs_reach_the_sink(spark):
    out = EV.evaluation_run(_cases(spark), RUNS, BrokenClient, fields=list(TRUTH))
    rows = {(r.id, r.model): r for r in out.collect()}
    bad = rows[("c1", "reader-sloppy")]
    assert bad.success is False and "TimeoutError" in bad.error
    assert bad.correct_fields is None and bad.format_compliance is None and bad.score_error == "failed_call"
    assert rows[("c1", "reader-exact")].success
    folder = os.path.join(tempfile.mkdtemp(prefix="eval-"), "runs")
    sinks.write_run_files(out, folder)
    back = experiments.read_run_files(spark, folder)
    assert back.count() == 4
    assert sorted(r.prompt_version for r in back.select("prompt_version").distinct().collect()) == ["v1", "v2"]
    assert back.where(F.col("model") == "reader-exact").where("id = 'c1'").first().correct_fields == 4.0


def test_grid_is_a_generator_not_a_join(spark):
    plan = EV.run_grid(_cases(spark), RUNS)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Join" not in plan and "CartesianProduct" not in plan


def test_unsupported_types_and_missing_truths_have_no_scores(spark):
    cases = _cases(spark).select("id", F.when(F.col("id") == "c1", "a.docx").otherwise("b.png").alias("in"), "content",
                                 F.when(F.col("id") == "c1", F.col("expected")).alias("expected"), "tags")
    rows = {r.id: r for r in EV.evaluation_run(cases, RUNS[:1], SI.CardReaderClient, fields=list(TRUTH)).collect()}
    assert rows["c1"].success is False and ".docx" in rows["c1"].error and rows["c1"].score_error == "failed_call"
    assert rows["c2"].success and rows["c2"].score_error == "missing_truth"
    assert {r.correct_fields for r in rows.values()} == {r.format_compliance for r in rows.values()} == {None}


def test_the_request_text_is_the_request(spark):
    from folio.operators import inference as I
    from folio.operators.triage import content_block

    prompt = 'Say "é" \\ and\nstop'
    row = _cases(spark).select(
        F.to_json(content_block(F.col("content"), F.col("in"))).alias("block"),
        F.to_json(I.build_request(content_block(F.col("content"), F.col("in")), F.lit(prompt), F.lit("m"), 77)).alias("request"),
    ).first()
    built = EV.request_builder(77)(row.block, {"model": "m", "prompt": prompt})
    assert json.loads(built) == json.loads(row.request)


def test_content_is_not_copied_per_run(spark):
    plan = EV.evaluation_run(_cases(spark), RUNS, SI.CardReaderClient, fields=list(TRUTH))._jdf.queryExecution().optimizedPlan().toString()
    before_python = plan[plan.index("MapInPandas"):]
    assert before_python.count("Generate") == 0 and "Join" not in before_python and "base64" in before_python


class CountingClient(SI.CardReaderClient):
    """Marks every call in a folder; fails on the cases it is told to."""

    def __init__(self, folder, failing=()):
        super().__init__()
        self.folder, self.failing = folder, failing

    def _generate(self, request_json, settings):
        import uuid

        model = json.loads(request_json)["model"]
        open(os.path.join(self.folder, f"{model}-{uuid.uuid4().hex}"), "w").close()
        if model in self.failing:
            raise TimeoutError("no answer")
        return super()._generate(request_json, settings)


def test_a_second_start_calls_only_what_is_missing(spark):
    calls, path = tempfile.mkdtemp(prefix="calls-"), os.path.join(tempfile.mkdtemp(prefix="resume-"), "run")
    many = spark.range(20).crossJoin(_cases(spark).where("id = 'c1'").drop("id")).withColumn("id", F.col("id").cast("string"))
    run = lambda client, runs=RUNS, **more: EV.resume_evaluation(many, runs, client, path, fields=list(TRUTH), **more)
    made = lambda: len(os.listdir(calls))
    # Interrupted after one of four waves, with one model failing.
    written = run(lambda: CountingClient(calls, ["reader-sloppy"]), waves=4, max_waves=1)
    assert 0 < written < 40 and made() == written
    # What a crash left without a commit is not read.
    left = os.path.join(path, "attempt=2", "wave=0", "_temporary")
    os.makedirs(left)
    answered = EV.evaluation_results(spark, path).where("success").count()
    assert answered == written // 2
    rest = run(lambda: CountingClient(calls), waves=3)
    assert rest == 40 - answered and made() == written + rest
    assert run(lambda: CountingClient(calls)) == 0 and made() == written + rest
    got = EV.evaluation_results(spark, path).collect()
    assert len(got) == 40 and all(r.success for r in got) and {r.attempt for r in got} == {1, 3}
    # A further run of the same cases is all that is called.
    more = [*RUNS, ("reader-exact", "v9", "Extract again.")]
    assert run(lambda: CountingClient(calls), more) == 20


def test_failed_calls_may_be_left_alone(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="resume-"), "run")
    first = EV.resume_evaluation(_cases(spark), RUNS, BrokenClient, path, fields=list(TRUTH))
    assert first == 4 and EV.resume_evaluation(_cases(spark), RUNS, BrokenClient, path, fields=list(TRUTH), retry_failed=False) == 0
    assert EV.evaluation_results(spark, path).where("NOT success").count() == 2
