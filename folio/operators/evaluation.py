"""The evaluation job: cases x (model, prompt) -> model call -> scores -> result rows, in one plan.

Per case and run: the chat request is built from the case's file and the prompt (I8), the
model client answers it (I2 / I3 via ``run_variants``: a case's bytes are encoded and shipped once, one
client per task, failures as error rows, latency measured around the call only), and the answer is
scored against the case's ground truth (J1 / J2 / J4). The rows have the result-row columns (M8) plus the
prompt version; write them with :func:`folio.sources.sinks.write_run_files` or ``write_results``.

:func:`resume_evaluation` writes the rows wave by wave and calls, when it is started again, only what has
no good answer yet.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import media_type, suffix
from ..functions.text import iso_text
from ..schemas import Settings
from ..session import dealt, spread
from . import inference as I
from .scoring import with_scores, with_truth
from .triage import content_block


def run_grid(cases: DataFrame, runs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Every case x ``(model, prompt_version, prompt)``, by a generator over a literal list.

    The runs are a few literals, so each case row is expanded in place: no join, no shuffle.
    """
    lit_runs = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(v).alias("prompt_version"), F.lit(p).alias("prompt")) for m, v, p in runs]
    )
    return cases.select("*", F.explode(lit_runs).alias("_run")).select(
        "*", F.col("_run.model").alias("model"), F.col("_run.prompt_version").alias("prompt_version"),
        F.col("_run.prompt").alias("prompt"),
    ).drop("_run")


def request_builder(max_tokens: int) -> Callable[[str, dict[str, str]], str]:
    """``(file block as JSON, run) -> chat request as JSON``: :func:`folio.operators.inference.build_request` as text,
    with the block's text in its place, so its bytes are encoded once for all runs, and the run's once for all cases."""
    ends: dict[tuple[str, str], tuple[str, str]] = {}

    def build(block: str, run: dict[str, str]) -> str:
        named = run["model"], run["prompt"]
        if named not in ends:
            model, prompt = (json.dumps(x, ensure_ascii=False) for x in named)
            ends[named] = (f'{{"model":{model},"max_tokens":{max_tokens},"messages":[{{"role":"user","content":[',
                           f',{{"type":"text","text":{prompt}}}]}}]}}')
        head, tail = ends[named]
        return f"{head}{block}{tail}"

    return build


def evaluation_run(cases: DataFrame, runs: Sequence[tuple[str, str, str]], make_client: Callable[[], I.Backend],
                   key: str = "id", path_col: str = "in", content_col: str = "content", expected_col: str = "expected",
                   doc: str = "cin", fields: Sequence[str] | None = None, settings: Settings = Settings(),
                   slots: int | None = None, wanted_col: str | None = None, concurrency: int = 1,
                   warm: bool = False, parse_once: bool = False) -> DataFrame:
    """Run every case through every (model, prompt) and score the answers.

    ``cases``: ``key``, the input path (its suffix gives the media type), the input bytes, the
    ground-truth JSON text, and optionally ``tags`` / ``notes``. The client receives the chat
    request as JSON text (model, max_tokens, messages), as a remote model API would.
    ``timestamp`` is the answer's time as naive ISO text in the session time zone (result rows
    record local time without a zone); ``execution_time`` is the model call alone, in seconds.
    A failed call, an unsupported file type and a missing truth give rows without scores, with
    ``score_error`` set, so that outages do not count as wrong answers. ``wanted_col``: numbers of the
    runs that a case still needs (default: all). ``parse_once``: the truth goes through the model's task and is parsed
    once per case, and not for each of its answers; they become rows by a generator after the task.
    """
    context = [c for c in ("tags", "notes") if c in cases.columns]
    block = content_block(F.col(content_col), F.col(path_col))
    # A file type the API does not take never reaches the model.
    unsupported = F.when(
        media_type(F.col(path_col)).isNull(),
        F.concat(F.lit("Unsupported file type '"), F.lower(suffix(F.col(path_col))), F.lit("'")),
    )
    wanted = [wanted_col] if wanted_col else []
    staged = cases.select(key, expected_col, *context, *wanted, F.when(unsupported.isNull(), F.to_json(block)).alias("block"),
                          unsupported.alias("unsupported"))
    variants = [{"model": m, "prompt_version": v, "prompt": p} for m, v, p in runs]
    answered = I.run_variants(staged, make_client, variants, request_builder(settings.api_max_tokens), "block", [key],
                              ["model", "prompt_version"], settings, [expected_col, *context], "unsupported", wanted_col, slots,
                              concurrency=concurrency, warm=warm,
                              per_row=(lambda rows: with_truth(rows, expected_col, fields)) if parse_once else None)
    scored = with_scores(answered.withColumnRenamed("text", "generated"), expected_col, "generated", fields,
                         failed=~F.col("success"), truth=parse_once)
    return scored.select(
        key,
        F.lit(doc).alias("doc"),
        "model",
        "prompt_version",
        *context,
        iso_text(F.col("timestamp").cast("timestamp_ntz")).alias("timestamp"),
        F.col("inference_time_seconds").alias("execution_time"),
        "correct_fields",
        "correct_fields_reason",
        "format_compliance",
        "format_compliance_reason",
        "score_error",
        F.col(expected_col).alias("expected"),
        "generated",
        "success",
        "error",
    )


# ---------------------------------------------------------------- resumable runs

#: Result rows that are committed at a time, about, and the most commits of one start: each costs a job, so a large
#: evaluation commits larger waves.
WAVE_CALLS, MAX_WAVES = 100_000, 32
#: Calls of a task of a wave.
TASK_CALLS = 100_000
#: Runs whose answers one number tells, a bit each.
_BITS = 62


def _committed(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """The folders of committed waves, and the number of the next attempt."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    begun = store.globStatus(hadoop.Path(f"{path}/attempt=*")) or []
    done = store.globStatus(hadoop.Path(f"{path}/attempt=*/wave=*/_SUCCESS")) or []
    attempts = [int(s.getPath().getName().split("=")[1]) for s in begun]
    return sorted(s.getPath().getParent().toString() for s in done), max(attempts, default=0) + 1


def _rows_of(spark: SparkSession, path: str, folders: Sequence[str]) -> DataFrame | None:
    return spark.read.option("basePath", path).parquet(*folders) if folders else None


def missing_runs(cases: DataFrame, done: DataFrame | None, runs: Sequence[tuple[str, str, str]], key: str = "id",
                 retry_failed: bool = True) -> DataFrame:
    """Cases with ``wanted``: the numbers of the runs that have no answer yet; complete cases are left out.

    ``done``: the rows of earlier attempts; of these only keys and ``success`` are read.
    """
    every = F.array(*[F.lit(i) for i in range(len(runs))])
    if done is None:
        return cases.withColumn("wanted", every)
    number = F.coalesce(*[F.when((F.col("model") == m) & (F.col("prompt_version") == v), F.lit(i)) for i, (m, v, _) in enumerate(runs)])
    good = done.where("success") if retry_failed else done
    # A bit per run, whatever the number of attempts.
    words = range(-(-len(runs) // _BITS))
    flag = lambda i: F.lit(1 << i % _BITS).cast("long")
    bits = [F.bit_or(F.coalesce(*[F.when(F.col("_run") == i, flag(i)) for i in range(w * _BITS, min(len(runs), (w + 1) * _BITS))]))
            .alias(f"_have{w}") for w in words]
    have = good.select(F.col(key).alias("_key"), number.alias("_run")).groupBy("_key").agg(*bits)
    word = [F.coalesce(F.col(f"_have{w}"), F.lit(0).cast("long")) for w in words]
    left = F.array(*[F.when(word[i // _BITS].bitwiseAND(flag(i)) == 0, F.lit(i)) for i in range(len(runs))])
    todo = cases.join(have, F.col(key) == F.col("_key"), "left").withColumn("wanted", F.array_compact(left))
    return todo.where(F.size("wanted") > 0).drop("_key", *[f"_have{w}" for w in words])


def resume_evaluation(cases: DataFrame, runs: Sequence[tuple[str, str, str]], make_client: Callable[[], I.Backend], path: str,
                      key: str = "id", waves: int | None = None, max_waves: int | None = None, retry_failed: bool = True,
                      **options) -> int:
    """Run what is missing under ``path`` and commit it wave by wave; returns the number of rows written.

    The rows are the progress table: a wave's rows and the fact that they are finished are one commit (a
    Parquet folder ``attempt=…/wave=…``; only folders with ``_SUCCESS`` are read). Started again
    after a crash, or after calls have failed, the job anti-joins the committed keys before any call.
    ``waves``: how many commits (default: by the number of calls, at most ``MAX_WAVES``); a wave is a hash part of the
    cases, so it is spread over all tasks. What is left to do is found once and written by waves, so that a wave reads
    its own cases only. ``max_waves`` stops after so many (what is left is run by the next start).
    """
    spark = cases.sparkSession
    folders, attempt = _committed(spark, path)
    todo = missing_runs(cases, _rows_of(spark, path, folders), runs, key, retry_failed)
    if waves is None:
        calls = todo.select(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0]
        waves = min(MAX_WAVES, max(1, -(-calls // WAVE_CALLS)))
    staged = None
    if waves > 1:
        staged = f"{path}/attempt={attempt}/_todo"  # readers skip it
        wave_of = F.pmod(F.xxhash64(F.lit(7), key), F.lit(waves)).cast("int")
        todo.withColumn("_wave", wave_of).write.mode("overwrite").partitionBy("_wave").parquet(staged)
        hadoop = spark._jvm.org.apache.hadoop.fs
        store = hadoop.Path(staged).getFileSystem(spark._jsc.hadoopConfiguration())

    def planned(wave: int) -> DataFrame:
        part = todo
        if staged:
            own = f"{staged}/_wave={wave}"  # only its folder is listed; there is none for a wave without cases
            part = spark.read.schema(todo.schema).parquet(own) if store.exists(hadoop.Path(own)) else todo.limit(0)
            n = part.count()  # from the files' footers
            per_task = -(-TASK_CALLS // len(runs))
            part = dealt(spread(part, key), n, per_task, key)
        return evaluation_run(part, runs, make_client, key=key, wanted_col="wanted", parse_once=True, **options)

    rows, last = 0, min(waves, max_waves or waves)
    with ThreadPoolExecutor(1) as ahead:  # a wave's plan takes a second, so it is made while the wave before it runs
        following = ahead.submit(inheritable_thread_target(spark)(planned), 0)
        for wave in range(last):
            out = following.result()
            if wave + 1 < last:
                following = ahead.submit(inheritable_thread_target(spark)(planned), wave + 1)
            target = f"{path}/attempt={attempt}/wave={wave}"
            out.write.mode("overwrite").parquet(target)
            rows += spark.read.schema(out.schema).parquet(target).count()  # from the files' footers
    if staged:
        store.delete(hadoop.Path(staged), True)
    return rows


def evaluation_results(spark: SparkSession, path: str, key: str = "id", calls: str | None = None) -> DataFrame:
    """One row per (case, model, prompt): the good answer, else the last failure; ``attempt`` tells from which start.

    ``calls``: a column with the number of calls that were made for it, counted in the same pass.
    """
    found = _rows_of(spark, path, _committed(spark, path)[0])
    if found is None:
        raise FileNotFoundError(f"no finished wave under {path}")
    keys = [key, "model", "prompt_version"]
    kept = [c for c in found.columns if c != "wave"]
    # Rows of equal rank come in one order for all columns, so the columns of a result are those of one row.
    rank = F.coalesce(F.col("success").cast("long"), F.lit(-1)) * F.lit(1 << 32) + F.col("attempt")
    best = [F.max_by(c, rank).alias(c) for c in kept if c not in keys]
    made = [F.count(F.lit(1)).alias(calls)] if calls else []
    return found.groupBy(*keys).agg(*best, *made).select(*kept, *([calls] if calls else []))
