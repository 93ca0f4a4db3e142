"""Run files, manifests, prompts (S1-S13) and experiment helpers."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from folio.operators import analytics as A
from folio.operators import experiment as X
from folio.operators import scoring as S
from folio.schemas import DETAIL_COLS, DISPLAY_COLS
from folio.sources import experiments, manifest, prompts, sinks

RUN_HEADER = "id,doc,model,tags,notes,timestamp,execution_time,correct_fields,correct_fields_reason,format_compliance,format_compliance_reason,expected,generated\n"


def _cell(s):
    return '"' + s.replace('"', '""') + '"'


def write_run(folder, name, rows):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(RUN_HEADER)
        for r in rows:
            fh.write(",".join(_cell(str(x)) if isinstance(x, str) else ("" if x is None else str(x)) for x in r) + "\n")
    return path


def test_run_files_union_identity_and_scores(spark):
    folder = tempfile.mkdtemp(prefix="runs-")
    exp = '{\n  "a": "1",\n  "b": ""\n}'
    rows_v1 = [
        ("d1", "cin", "model-x-1", "[]", None, "2026-03-08T21:05:26.544783", 2.5, 2.0, "line 1\nline 2", "correct", "ok", exp,
         '```json\n{"a": "1", "b": ""}\n```'),
        ("d2", "cin", "model-x-1", '["background"]', None, "2026-03-08T21:05:36", 3.5, 1.0, "r", "incorrect", "", exp,
         '{"a": "1", "b": "Z"}'),
    ]
    rows_v2 = [("d1", "cin", "model-x-1", "[]", None, "2026-03-09T10:00:00", 1.5, 1.0, "r", "correct", "", exp, '{"a": "0"}')]
    paths = [
        write_run(folder, "cin_prompt_v1_model-x-1_20260308_210516.csv", rows_v1),
        write_run(folder, "cin_prompt_v2_beta_model-x-1_20260309_100000.csv", rows_v2),
        write_run(folder, "legacy.csv", rows_v2),
    ]
    df = experiments.load_experiments(spark, paths)
    assert df.columns == DISPLAY_COLS + DETAIL_COLS
    got = [(r.id, r.prompt_version, r.timestamp) for r in df.collect()]
    # newest first; the version is cut at its first '_'; a name without '_prompt_' gives ''
    assert got[0][2] == "2026-03-09T10:00:00" and {g[1] for g in got} == {"v1", "v2", ""}
    assert df.where(F.col("correct_fields_reason").contains("\n")).count() == 1  # multi-line cell kept whole
    scored = S.with_scores(df.withColumnRenamed("correct_fields", "judge_fields"))
    by_id = {(r.id, r.prompt_version): r.correct_fields for r in scored.collect()}
    assert by_id[("d1", "v1")] == 2.0 and by_id[("d2", "v1")] == 1.0 and by_id[("d1", "v2")] == 0.0
    lb = A.leaderboard(df).where(F.col("prompt_version") == "v1").first()
    assert lb.avg_correct_fields == 1.5 and lb.pct_format_incorrect == 50.0 and lb.avg_execution_time == 3.0


def test_empty_results_keep_schema(spark):
    df = experiments.load_experiments(spark, [])
    assert df.columns == DISPLAY_COLS + DETAIL_COLS and df.count() == 0


def test_manifest_and_truth_join(spark):
    base = tempfile.mkdtemp(prefix="ds a+b%c-")  # scan paths are URIs: %20, %25 and a literal +
    os.makedirs(os.path.join(base, "cin", "outs"))
    with open(os.path.join(base, "cin", "cin.csv"), "w") as fh:
        fh.write("id,in,out,tags,notes\nc1,ins/c1.png,outs/c1.json,[],\nc2,/abs/c2.jpg,outs/missing.json,\"[\"\"background\"\"]\",\n")
    with open(os.path.join(base, "cin", "outs", "c1.json"), "w") as fh:
        fh.write('{"prenom": "A"}')
    m = manifest.load_dataset(spark, base, "cin")
    got = {r.id: (r["in"], r.tags) for r in m.collect()}
    assert got["c1"][0] == os.path.join(base, "cin", "ins/c1.png") and got["c2"] == ("/abs/c2.jpg", '["background"]')
    truth = manifest.read_truth_files(spark, os.path.join(base, "cin", "outs", "*.json"))
    joined = {r.id: r.expected for r in manifest.attach_truth(m, truth).collect()}
    assert joined == {"c1": '{"prenom": "A"}', "c2": None}


def test_prompt_files_catalog_and_render(spark):
    folder = tempfile.mkdtemp(prefix="prompts-")
    with open(os.path.join(folder, "v1.yaml"), "w") as fh:
        fh.write('description: "first"\ntemplate_vars: []\ntags: [a]\nprompt: |\n  Return {"x": ""}\n')
    with open(os.path.join(folder, "v2.yaml"), "w") as fh:
        fh.write('tags: [a, b]\ntemplate_vars: [case]\nprompt: "Case {case}: return {\\"x\\": \\"\\"}"\n')
    cat = prompts.read_prompt_files(spark, folder, "cin")
    assert [r.version for r in prompts.list_prompts(cat).collect()] == ["v1", "v2"]
    assert [r.version for r in prompts.list_prompts(cat, ["a", "b"]).collect()] == ["v2"]
    assert cat.where("version = 'v2'").first().description is None or True
    filled = prompts.render(cat.withColumn("vars", F.create_map(F.lit("case"), F.lit("42"))), "vars")
    got = {r.version: (r.rendered, r.missing_vars) for r in filled.collect()}
    assert got["v1"] == ('Return {"x": ""}\n', [])  # no template vars: unchanged, braces kept
    assert got["v2"] == ('Case 42: return {"x": ""}', [])
    missing = prompts.render(cat.withColumn("vars", F.create_map().cast("map<string,string>")), "vars")
    got = {r.version: (r.rendered, r.missing_vars) for r in missing.collect()}
    assert got["v2"] == (None, ["case"])


def test_grid_and_pivot(spark):
    m = spark.createDataFrame([("c1",), ("c2",)], "id string")
    g = X.experiment_grid(m, ["a", "b"], ["v1", "v2"], run_ts="20260101_000000")
    assert g.count() == 8
    assert g.where("id = 'c1' and model = 'b' and prompt_version = 'v2'").first().run_name == "cin_prompt_v2_b_20260101_000000"
    assert "Exchange" not in g._jdf.queryExecution().executedPlan().toString()
    r = spark.createDataFrame([(1, "a", 2.0, 3.0), (1, "b", 4.0, 5.0), (2, "a", 1.0, 1.0)],
                              "case_key long, model string, execution_time double, correct_fields double")
    p = {x.case_key: x for x in X.model_pivot(r, ["a", "b"]).collect()}
    assert p[1].b_avg_time == 4.0 and p[2].b_avg_fields is None


@pytest.mark.parametrize("name", ["cin_prompt_v1_m-4-5_20260308_210516.csv", "x_prompt_v10_y_z.csv"])
def test_prompt_version_from_name(spark, name):
    df = spark.createDataFrame([(f"/r/{name}",)], "p string")
    assert df.select(X.prompt_version_from_name(F.col("p"))).first()[0] in ("v1", "v10")


def test_sinks_round_trip(spark):
    out = tempfile.mkdtemp(prefix="sink-")
    df = spark.createDataFrame(
        [("1", "cin", "v1", "m", "20260101_000000", 2.0), ("2", "cin", "v2", "m", "20260101_000000", 3.0)],
        "id string, doc string, prompt_version string, model string, run_ts string, correct_fields double",
    )
    sinks.write_results(df, os.path.join(out, "results"))
    back = experiments.load_results_parquet(spark, os.path.join(out, "results"))
    assert sorted((r.id, r.prompt_version) for r in back.collect()) == [("1", "v1"), ("2", "v2")]
    pruned = back.where("prompt_version = 'v2'")
    assert "PartitionFilters: [isnotnull(prompt_version" in pruned._jdf.queryExecution().executedPlan().toString()
    sinks.write_text(df, "id", os.path.join(out, "text"))
    assert sorted(r.value for r in spark.read.text(os.path.join(out, "text")).collect()) == ["1", "2"]


def test_run_files_round_trip_keeps_cells_exact(spark):
    out = tempfile.mkdtemp(prefix="runs-")
    df = spark.createDataFrame(
        [
            ("1", "cin", "m0", "v1", None, "", "  lead and trail  ", 'a "q",\nline2', 1.5),
            ("2", "cin", "007", "v2", '["a","b"]', None, "x", "", None),
        ],
        "id string, doc string, model string, prompt_version string, tags string, notes string,"
        " correct_fields_reason string, generated string, execution_time double",
    )  # no `expected`, `timestamp`, ...: written as empty cells
    sinks.write_run_files(df, out)
    back = {r.id: r for r in experiments.read_run_files(spark, out).collect()}
    assert back["1"].notes == "" and back["2"].notes is None  # "" and NULL stay apart
    assert back["1"].correct_fields_reason == "  lead and trail  "  # the writer does not trim
    assert back["1"].generated == 'a "q",\nline2' and back["2"].generated == ""
    assert back["2"].model == "007" and back["1"].prompt_version == "v1"  # folder names as text
    assert back["1"].execution_time == 1.5 and back["2"].execution_time is None
    assert back["1"].expected is None and back["1"].tags is None and back["2"].tags == '["a","b"]'


def test_write_results_adds_no_shuffle(spark):
    from unittest import mock

    df = spark.createDataFrame([("1", "cin", "v1", "m")], "id string, doc string, prompt_version string, model string")
    with mock.patch.object(type(df), "repartition", side_effect=AssertionError("shuffle by run identity")):
        sinks.write_results(df, os.path.join(tempfile.mkdtemp(prefix="sink-"), "r"))


def test_run_identity_survives_both_sinks(spark):
    out = tempfile.mkdtemp(prefix="identity-")
    odd = ["", "007", "~", "~x", "1.0", None, "v 1/é"]
    df = spark.createDataFrame([(str(i), "cin", v, "007", 1.0) for i, v in enumerate(odd)],
                               "id string, doc string, prompt_version string, model string, correct_fields double")
    sinks.write_results(df, os.path.join(out, "parquet"))
    sinks.write_run_files(df, os.path.join(out, "csv"))
    for back in (experiments.load_results_parquet(spark, os.path.join(out, "parquet")),
                 experiments.read_run_files(spark, os.path.join(out, "csv"))):
        assert {r.id: (r.prompt_version, r.model) for r in back.collect()} == {str(i): (v, "007") for i, v in enumerate(odd)}


def test_texts_of_many_lines_are_one_record(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="texts-"), "t")
    texts = ["one", "two\nlines", "back\\slash\\n", "\r\n", "\\\\n\n\\", "a\\\nb"]
    sinks.write_text(spark.createDataFrame([(t,) for t in texts], "t string"), "t", out)
    assert sorted(r.value for r in sinks.read_text(spark, out).collect()) == sorted(texts)


def test_a_cell_that_is_no_number_does_not_stop_the_load(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="cells-"), "cin_prompt_v1_m_20260101_000000.csv")
    with open(path, "w") as fh:
        fh.write("id,execution_time,correct_fields\n1,n/a,3.0\n2,1.5,\n")
    got = {r.id: (r.execution_time, r.correct_fields) for r in experiments.read_run_csv(spark, path).collect()}
    assert got == {"1": (None, 3.0), "2": (1.5, None)}
    assert experiments.rejected_numbers(spark, [path]).first().asDict() == {"execution_time": 1, "correct_fields": 0}


def test_unknown_prompts_are_errors(spark):
    folder = tempfile.mkdtemp(prefix="prompts-")
    with open(os.path.join(folder, "v1.yaml"), "w") as fh:
        fh.write("prompt: x\n")
    cat = prompts.read_prompt_files(spark, folder, "cin")
    assert prompts.get_prompt(cat, "cin", "v1").count() == 1
    with pytest.raises(LookupError, match="v1"):
        prompts.get_prompt(cat, "cin", "v9")
    with pytest.raises(Exception):
        prompts.read_prompt_files(spark, os.path.join(folder, "gone"), "cin")


def test_values_that_hold_tokens_are_not_filled_again(spark):
    df = spark.createDataFrame([("C={case} P={place} {x}{", ["case", "place"], {"case": "{place}", "place": "Rabat"})],
                               "prompt string, template_vars array<string>, vars map<string,string>")
    assert prompts.render(df, "vars").first().rendered == "C={place} P=Rabat {x}{"


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_runs_are_scanned_by_header_not_by_file(spark):
    folder = tempfile.mkdtemp(prefix="headers-")
    other = "timestamp,id,model,id,generated\n"
    for k in range(30):
        with open(os.path.join(folder, f"cin_prompt_v{k % 3}_m{k}_2026.csv"), "w", encoding="utf-8") as fh:
            if k % 2:
                fh.write(other + f'2026-01-01T00:00:{k:02d},{k},m,twice,"two\nlines ""{k}"""\n')
            else:
                fh.write("\ufeff" * (k == 0) + RUN_HEADER + f"{k},cin,m,,,2026-01-01T00:00:{k:02d},n/a,2.0,,,,,x\n")
    open(os.path.join(folder, "cin_prompt_v1_empty_2026.csv"), "w").close()
    paths = [os.path.join(folder, f) for f in os.listdir(folder)]
    df = experiments.load_experiments(spark, paths)
    rows = df.collect()
    assert [r.id for r in rows] == [str(k) for k in range(29, -1, -1)]
    assert _scans(df) == 2  # two layouts; a byte order mark makes no third
    assert _scans(experiments.load_experiments(spark, paths[:15])) <= 2
    assert {r.id: r.prompt_version for r in rows} == {str(k): f"v{k % 3}" for k in range(30)}
    assert rows[0].generated == 'two\nlines "29"' and rows[0].correct_fields is None and rows[1].correct_fields == 2.0
    assert experiments.rejected_numbers(spark, paths).first().execution_time == 15


def test_run_csv_files_carry_the_run_name(spark):
    folder = os.path.join(tempfile.mkdtemp(prefix="named-"), "runs")
    rows = [(f"cin_prompt_v{k % 2}_a b é_x", str(k), "m", 'q "x",\n2', 1.5) for k in range(40)]
    df = spark.createDataFrame(rows, "run_name string, id string, model string, generated string, execution_time double")
    made = sinks.write_run_csv(df.repartition(7), folder)
    assert sorted(os.listdir(folder)) == sorted(os.path.basename(p) for p in made)
    assert {os.path.basename(p) for p in made} == {"cin_prompt_v0_a b é_x.csv", "cin_prompt_v1_a b é_x.csv"}
    back = experiments.read_runs(spark, made)
    assert {(r.id, r.prompt_version, r.generated) for r in back.collect()} == {(str(k), f"v{k % 2}", 'q "x",\n2') for k in range(40)}
    sinks.write_run_csv(df.limit(4), folder)  # a run written again replaces its file
    assert experiments.read_runs(spark, made).count() == 4


def test_run_folders_hold_few_files(spark):
    folder = os.path.join(tempfile.mkdtemp(prefix="few-"), "runs")
    df = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.lit("cin").alias("doc"),
                                  F.concat(F.lit("v"), F.col("id") % 5).alias("prompt_version"), F.lit("m").alias("model"))
    sinks.write_run_files(df.repartition(16), folder)
    files = [f for _, _, names in os.walk(folder) for f in names if f.startswith("part-")]
    assert len(files) == 5
