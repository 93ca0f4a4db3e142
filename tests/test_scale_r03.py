"""Steps whose cost must not grow faster than their input: tasks before wide projections, run files, waves, archives."""

import os
import tempfile
import zipfile

from pyspark.sql import functions as F

from folio import testing as SI
from folio.operators import evaluation as EV
from folio.operators import scoring as S
from folio.session import dealt
from folio.sources import asset_source, sinks
from folio.sources import testdata as td

RUNS = [(m, v, td.CARD_PROMPTS[v]) for m in SI.CARD_READERS for v in td.CARD_PROMPTS]


def test_results_are_dealt_by_rows(spark, sf_small, monkeypatch):
    small = td.scored(spark, sf_small).select("id", "verdicts", "correct_fields_reason", "judge_format")
    whole = sorted(map(str, small.collect()))
    monkeypatch.setattr(td._orders_with_truth, "__defaults__", (100,))
    rows = td.scored(spark, sf_small).select("id", "verdicts", "correct_fields_reason", "judge_format")
    assert rows.rdd.getNumPartitions() == 15  # 1500 orders, whatever their bytes
    assert sorted(map(str, rows.collect())) == whole
    assert dealt(small, 300, 100).rdd.getNumPartitions() == small.rdd.getNumPartitions()  # fewer tasks than cores


def test_keys_outside_the_list_and_null_values(spark):
    rows = [(1, '{"a":"1","b":"2"}', '{"a":"1","b":"3"}'), (2, '{"a":"1","c":"2"}', '{"a":"1","c":"2"}'),
            (3, '{"a":null,"b":"2"}', '{"b":"2","a":null}'), (4, '{"a":null,"z":"2"}', "```json\n{}\n```"), (5, None, "{}")]
    df = spark.createDataFrame(rows, "id int, expected string, generated string")
    columns = ["id", "correct_fields", "format_compliance", "format_compliance_reason"]
    listed = {tuple(r) for r in S.with_scores(df, fields=["a", "b"]).select(columns).collect()}
    assert listed == {tuple(r) for r in S.with_scores(df).select(columns).collect()}
    assert {(i, n) for i, n, *_ in listed} == {(1, 1.0), (2, 2.0), (3, 1.0), (4, 0.0), (5, None)}


def test_run_files_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 10)
    rows = [("cin_prompt_v1_m_x", str(k), "m", f"a\n{k}") for k in range(95)]
    df = spark.createDataFrame(rows, "run_name string, id string, model string, generated string").coalesce(1)
    folder = os.path.join(tempfile.mkdtemp(prefix="bounded-"), "runs")
    assert len(sinks.write_run_csv(df, folder)) >= 10
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/*.csv")
    assert sorted((r.id, r.generated) for r in back.collect()) == sorted((r[1], r[3]) for r in rows)
    sinks.write_run_files(df.withColumn("doc", F.lit("cin")).withColumn("prompt_version", F.lit("v1")), f"{folder}-by-run")
    assert sum(f.endswith(".csv") for _, _, files in os.walk(f"{folder}-by-run") for f in files) >= 10


def test_waves_read_what_was_written_once(spark, monkeypatch):
    calls = []
    find = EV.missing_runs
    monkeypatch.setattr(EV, "missing_runs", lambda *a, **k: calls.append(1) or find(*a, **k))
    monkeypatch.setattr(EV, "WAVE_CALLS", 1)
    monkeypatch.setattr(EV, "MAX_WAVES", 3)
    truth = '{"prenom":"A"}'
    rows = [(k, f"scans/{k}.png", bytearray(b"prenom: A"), truth) for k in range(12)]
    cases = spark.createDataFrame(rows, "id long, in string, content binary, expected string")
    path = os.path.join(tempfile.mkdtemp(prefix="waves-"), "run")
    assert EV.resume_evaluation(cases, RUNS, SI.CardReaderClient, path, max_waves=1) < 12 * len(RUNS)
    assert sorted(os.listdir(f"{path}/attempt=1")) == ["wave=0"]
    EV.resume_evaluation(cases, RUNS, SI.CardReaderClient, path)
    assert sorted(os.listdir(f"{path}/attempt=2")) == ["wave=0", "wave=1", "wave=2"]  # at most so many commits
    assert EV.evaluation_results(spark, path).where("success").count() == 12 * len(RUNS) and len(calls) == 2


def test_missing_runs_beyond_one_word(spark):
    runs = [("m", f"v{i}", "p") for i in range(70)]
    cases = spark.createDataFrame([(1,), (2,)], "id long")
    done = spark.createDataFrame([(1, "m", f"v{i}", i != 65) for i in range(70) if i not in (3, 64)] + [(1, "m", "other", True)],
                                 "id long, model string, prompt_version string, success boolean")
    left = {r.id: r.wanted for r in EV.missing_runs(cases, done, runs).collect()}
    assert left == {1: [3, 64, 65], 2: list(range(70))}


def test_archives_are_scanned_like_files(spark):
    folder = tempfile.mkdtemp(prefix="archives-")
    png = bytes.fromhex("89504E470D0A1A0A0000000D4948445200000003000000020802000000")
    late = bytes.fromhex("49492A0078110100") + bytes(70000) + bytes.fromhex(
        "0300000103000100000028230000010103000100000028230000150103000100000003000000" + "00000000")
    out = asset_source.ArchiveWriter(folder, "a")
    paths = [out.add("1.img", png), out.add("1.img", png), out.add("2.img", late), out.add("3.img", None), out.add("4.txt", b"x")]
    out.close()
    with open(f"{folder}/broken.zip", "wb") as f:
        f.write(b"no archive")
    rows = {r.path: r for r in asset_source.scan_headers(spark, folder, glob="*.img", archives=True).collect()}
    assert set(rows) == {*paths[:3], f"{folder}/broken.zip"} and len(set(paths)) == 5
    assert rows[paths[1]].width == 3 and rows[paths[1]].decodable and rows[paths[1]].length == len(png)
    assert rows[paths[2]].width == 9000 and rows[paths[2]].bytes_read <= 256
    assert rows[f"{folder}/broken.zip"].error and not rows[f"{folder}/broken.zip"].decodable
    with zipfile.ZipFile(f"{folder}/a-00000.zip") as archive:
        assert archive.read("2.img") == late


def test_uploads_lie_in_archives(spark, sf_small):
    folder, files = td.upload_files(spark, sf_small)
    on_disk = [f for _, _, names in os.walk(folder) for f in names if not f.startswith(".")]
    assert files.count() == 1500 and 1 <= len(on_disk) < 100 and all(f.endswith(".zip") for f in on_disk)
