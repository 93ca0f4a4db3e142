"""Model execution over partitions.

A backend is any object with ``load / unload / is_loaded / generate``. ``run_batch`` runs it
inside ``mapInPandas``: one load per task, on the first non-empty batch (empty partitions never
load a model), one call per row, and ``unload`` in ``finally``. A failing row becomes an error
row; a failing ``load`` fails the task so Spark retries it elsewhere.

A model that is slow to load can stay in the worker process (``warm``): Spark hands a process one task after
the other, and the next one finds the model loaded. :func:`sized_tasks` cuts a table into tasks of
about equal input bytes. :func:`run_variants` takes one row in and gives one out per variant, so what the
variants share (a file's bytes) travels once.
"""

from __future__ import annotations

import atexit
import datetime as dt
import hashlib
import sys
import time
import types
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._util import posexplode_rows
from ..functions.text import iso_utc_text
from ..schemas import Settings

ENVELOPE_FIELDS = [
    T.StructField("text", T.StringType(), True),
    T.StructField("model_id", T.StringType(), True),
    T.StructField("inference_time_seconds", T.DoubleType(), True),
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("device", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
    T.StructField("success", T.BooleanType(), True),
]


class Backend(Protocol):
    """The contract every model backend follows."""

    model_id: str
    device: str

    def load(self) -> None: ...

    def unload(self) -> None: ...

    def is_loaded(self) -> bool: ...

    def generate(self, input_data: Any, settings: Settings) -> str: ...


class BaseBackend:
    """Load guards shared by backends: a second ``load`` is a no-op, ``generate`` before ``load`` fails."""

    model_id = "base"
    device = "cpu"

    def __init__(self) -> None:
        self._loaded = False

    def _load(self) -> None:  # heavy work of a real model goes here
        pass

    def _generate(self, input_data: Any, settings: Settings) -> str:
        raise NotImplementedError

    def load(self) -> None:
        if self._loaded:
            return
        self._load()
        self._loaded = True

    def unload(self) -> None:
        self._loaded = False

    def is_loaded(self) -> bool:
        return self._loaded

    def generate(self, input_data: Any, settings: Settings) -> str:
        if not self.is_loaded():
            raise RuntimeError(f"backend {self.model_id!r} is used before load()")
        return self._generate(input_data, settings)


def envelope_schema(key_fields: Sequence[T.StructField]) -> T.StructType:
    return T.StructType(list(key_fields) + ENVELOPE_FIELDS)


def _absent(v) -> bool:
    return v is None or (isinstance(v, float) and pd.isna(v))


def _timed(backend: Backend, x, settings: Settings) -> tuple[str, float, dt.datetime, str | None]:
    """One call: text, seconds, time, error (a failing row is an error row)."""
    t0 = time.perf_counter()
    try:
        text, err = backend.generate(x, settings), None
    except Exception as e:
        text, err = "", f"{type(e).__name__}: {e}"
    return text, round(time.perf_counter() - t0, 3), dt.datetime.now(dt.timezone.utc), err


def _called(backend: Backend, rows: list, per_row: list[Settings], batch_size: int, concurrency: int) -> list[tuple]:
    """The calls of one input batch, in order: batched where the backend can, else some in flight."""
    if batch_size > 1 and hasattr(backend, "generate_batch"):
        out: list[tuple] = []
        for at in range(0, len(rows), batch_size):
            part, own = rows[at : at + batch_size], per_row[at : at + batch_size]
            if all(s == own[0] for s in own):
                t0 = time.perf_counter()
                try:
                    texts = list(backend.generate_batch(part, own[0]))
                    if len(texts) != len(part):
                        raise ValueError("one text per input expected")
                    each, now = round((time.perf_counter() - t0) / len(part), 3), dt.datetime.now(dt.timezone.utc)
                    out += [(t, each, now, None) for t in texts]
                    continue
                except Exception:  # one bad row fails a batched call: find it row by row
                    pass
            out += [_timed(backend, x, s) for x, s in zip(part, own)]
        return out
    if concurrency > 1:
        with ThreadPoolExecutor(concurrency) as pool:
            return list(pool.map(lambda row: _timed(backend, *row), zip(rows, per_row)))
    return [_timed(backend, x, s) for x, s in zip(rows, per_row)]


# ---------------------------------------------------------------- warm backends

#: Loaded models that a worker process keeps.
WARM_MODELS = 1
#: Functions reach the workers by value, each task with its own globals: what is to outlive a task hangs on this module.
_HOLDER = "_folio_warm_backends"


def _unload_all(loaded: "OrderedDict[str, Backend]") -> None:
    while loaded:
        loaded.popitem()[1].unload()


def warm_key(make_backend: Callable[[], Backend]) -> str:
    """The same for the same factory (its code and what it holds)."""
    from pyspark import cloudpickle

    return hashlib.sha256(cloudpickle.dumps(make_backend)).hexdigest()


def _warm(key: str, make_backend: Callable[[], Backend]) -> Backend:
    """This process's loaded backend of ``key``; the one used longest ago goes when there are too many."""
    holder = sys.modules.get(_HOLDER)
    if holder is None:
        holder = sys.modules[_HOLDER] = types.ModuleType(_HOLDER)
        holder.loaded = OrderedDict()
        atexit.register(_unload_all, holder.loaded)
    loaded = holder.loaded
    if key in loaded and loaded[key].is_loaded():
        loaded.move_to_end(key)
        return loaded[key]
    loaded.pop(key, None)
    while len(loaded) >= WARM_MODELS:
        loaded.popitem(last=False)[1].unload()
    backend = make_backend()
    backend.load()
    loaded[key] = backend
    return backend


class _Lease:
    """A task's backend: loaded when it is first needed, and unloaded or left warm at the end."""

    def __init__(self, make_backend: Callable[[], Backend], key: str | None):
        self.make_backend, self.key = make_backend, key
        self.backend: Backend | None = None

    def get(self) -> Backend:
        if self.backend is None:
            if self.key:
                self.backend = _warm(self.key, self.make_backend)
            else:
                self.backend = self.make_backend()
                self.backend.load()
        return self.backend

    def __enter__(self) -> _Lease:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.backend is None or (self.key and kind in (None, GeneratorExit)):
            return
        if self.key:  # what broke the task may have broken the model
            sys.modules[_HOLDER].loaded.pop(self.key, None)
        self.backend.unload()


# ---------------------------------------------------------------- tasks of equal bytes

#: Buckets that the bytes are summed in, whatever the size of the table.
SIZE_BUCKETS = 8192
TASK_BYTES = 16 * 1024 * 1024


def task_ranges(sizes: Sequence[int], task_bytes: int) -> tuple[list[tuple[int, int]], int]:
    """For each bucket's bytes the first task and the number of tasks it is dealt to, from the running sum;
    and the number of all tasks. Small buckets share a task, one larger than a task has several."""
    ranges, end, before = [], 0, 0
    for size in sizes:
        first = before // task_bytes
        width = max(1, -(-size // task_bytes)) if size > task_bytes else 1
        ranges.append((first, width))
        end = max(end, first + width)
        before += size
    return ranges, max(end, 1)


def sized_tasks(df: DataFrame, keys: Sequence[str], size: Column, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``df`` dealt to tasks of about ``task_bytes`` of input each, by the running sum of ``size`` over hash buckets.

    One narrow aggregation finds the bytes per bucket (a fixed number of sums reach the driver); the rows
    then move once, to the task their bucket was given. The number of tasks grows with the input, and neither the
    layout of the input nor the number of cores changes it.
    """
    spark = df.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(SIZE_BUCKETS)).cast("int")
    weight = F.coalesce(size.cast("long"), F.lit(0))
    sums = df.select(bucket.alias("_bucket"), weight.alias("_size")).groupBy("_bucket").agg(F.sum("_size").alias("_size"))
    found = sorted((r["_bucket"], r["_size"]) for r in sums.collect())
    ranges, n = task_ranges([s for _, s in found], task_bytes)
    rows = [(b, first, width) for (b, _), (first, width) in zip(found, ranges)]
    table = spark.createDataFrame(rows, "_bucket int, _first int, _width int")
    # At most SIZE_BUCKETS rows of three numbers. A row that came after the count goes to the first task.
    dealt = df.withColumn("_bucket", bucket).join(F.broadcast(table), "_bucket", "left")
    task = F.col("_first") + F.pmod(F.xxhash64(F.lit(1), *keys), F.col("_width")).cast("int")
    dealt = dealt.withColumn("_task", F.coalesce(task, F.lit(0)))
    return dealt.repartitionById(n, F.col("_task")).select(*df.columns)


def _runner(make_backend: Callable[[], Backend], input_col: str, keys: Sequence[str], settings: Settings,
            settings_col: str | None, skip_col: str | None = None, device_col: str | None = None,
            batch_size: int = 1, concurrency: int = 1, key: str | None = None):
    def overlaid(limit, device) -> Settings:
        changed = {} if _absent(limit) else {"max_new_tokens": int(limit)}
        if not _absent(device) and device != "":
            changed["device"] = str(device)
        return replace(settings, **changed) if changed else settings

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with _Lease(make_backend, key) as lease:
            for pdf in batches:
                if pdf.empty:
                    continue
                out = {k: pdf[k].tolist() for k in keys}
                n = len(pdf)
                inputs = pdf[input_col].tolist()
                limits = pdf[settings_col].tolist() if settings_col else [None] * n
                devices = pdf[device_col].tolist() if device_col else [None] * n
                skips = pdf[skip_col].tolist() if skip_col else [None] * n
                wanted = [i for i in range(n) if _absent(skips[i])]
                backend = lease.get() if wanted else lease.backend  # loaded on the first row that needs the model
                # Rejected before the model: an error row, no call.
                now = dt.datetime.now(dt.timezone.utc)
                results = [("", 0.0, now, str(skip)) for skip in skips]
                per_row: list[Settings] = [settings] * n
                for i in wanted:
                    try:
                        per_row[i] = overlaid(limits[i], devices[i])
                    except (TypeError, ValueError) as e:  # a limit that is no number
                        results[i] = ("", 0.0, now, f"{type(e).__name__}: {e}")
                        per_row[i] = None
                sent = [i for i in wanted if per_row[i] is not None]
                answers = _called(backend, [inputs[i] for i in sent], [per_row[i] for i in sent], batch_size, concurrency)
                for i, answer in zip(sent, answers):
                    results[i] = answer
                called = set(sent)
                own_device = getattr(backend, "device", "cpu")
                texts, secs, stamps, errors = map(list, zip(*results))
                out.update(
                    text=texts,
                    model_id=[backend.model_id if i in called else None for i in range(n)],
                    inference_time_seconds=secs,
                    timestamp=stamps,
                    device=[
                        (own_device if _absent(devices[i]) or devices[i] == "" else str(devices[i])) if i in called else None
                        for i in range(n)
                    ],
                    error=errors,
                    success=[e is None for e in errors],
                )
                yield pd.DataFrame(out)

    return run


def run_batch(df: DataFrame, make_backend: Callable[[], Backend], input_col: str, keys: Sequence[str],
              settings: Settings = Settings(), slots: int | None = None, settings_col: str | None = None,
              carry: Sequence[str] = (), skip_col: str | None = None, device_col: str | None = None,
              batch_size: int = 1, concurrency: int = 1, warm: bool = False, size: Column | None = None,
              task_bytes: int = TASK_BYTES) -> DataFrame:
    """Run a backend over a table; result = keys + the result envelope.

    ``slots`` sets the number of tasks (one model load each) and spreads the rows over them by a
    hash of the keys. The keys identify a row, so the spread is even whatever the input layout
    (the pages of one long document land in many tasks) and a retried task gets the same rows.
    The input is projected to the keys, the ``carry`` columns and the input column before the
    Python stage, so nothing else is shipped to the workers. ``carry`` columns are copied to the
    output (a row's context travels with it instead of being joined back after inference).
    ``skip_col``: a row whose value there is set (a triage error) becomes an error row with that
    text and is not sent to the model; a task whose rows are all skipped loads no model.
    ``device_col`` overrides the device per row (I7; empty or NULL: the default).
    ``batch_size``: rows per call for a backend with ``generate_batch(inputs, settings)``; a batch that
    fails is called row by row. ``concurrency``: calls in flight per task, for backends whose calls
    wait for a server and may run in several threads.
    ``warm``: the model stays loaded in the worker process for its next tasks. ``size``: the input bytes
    of a row; the rows are dealt to tasks of about ``task_bytes`` (instead of ``slots``).
    """
    out_cols = list(dict.fromkeys([*keys, *carry]))
    extra = [c for c in (settings_col, skip_col, device_col) if c]
    cols = list(dict.fromkeys([*out_cols, input_col, *extra]))
    projected = df.select(*cols)
    if size is not None:
        projected = sized_tasks(projected, keys, size, task_bytes)
    elif slots:
        projected = projected.repartition(slots, *keys)
    key_fields = [projected.schema[k] for k in out_cols]
    return projected.mapInPandas(
        _runner(make_backend, input_col, out_cols, settings, settings_col, skip_col, device_col, batch_size, concurrency,
                warm_key(make_backend) if warm else None),
        envelope_schema(key_fields),
    )


#: Characters of inputs and rows that a task builds before it calls the model.
VARIANT_CHARS = 16_000_000
VARIANT_ROWS = 256


def run_variants(df: DataFrame, make_backend: Callable[[], Backend], variants: Sequence[dict[str, str]],
                 build: Callable[[Any, dict[str, str]], Any], input_col: str, keys: Sequence[str], named: Sequence[str],
                 settings: Settings = Settings(), carry: Sequence[str] = (), skip_col: str | None = None,
                 wanted_col: str | None = None, slots: int | None = None, batch_size: int = 1, concurrency: int = 1,
                 warm: bool = False, per_row: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row in, one row out per variant: keys, ``carry``, the variant's ``named`` fields, the envelope.

    ``build(input, variant)`` makes a call's input inside the task, so a row's input reaches the task once however
    many variants there are. ``wanted_col`` (array of variant numbers) limits a row to these variants; ``skip_col``
    as in :func:`run_batch`. ``per_row`` adds columns to the keys and ``carry`` (a parsed truth, say) that are made once
    per row and given to each of its variants: a row's answers then leave the task in one row, too, and become rows
    after it.
    """
    out_cols = list(dict.fromkeys([*keys, *carry]))
    cols = list(dict.fromkeys([*out_cols, input_col, *[c for c in (skip_col, wanted_col) if c]]))
    projected = df.select(*cols)
    if slots:
        projected = projected.repartition(slots, *keys)
    key = warm_key(make_backend) if warm else None

    def parts(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        begin = held = 0
        for i, text in enumerate(pdf[input_col]):
            held += len(variants) * (0 if _absent(text) else len(text))
            if held >= VARIANT_CHARS or i + 1 - begin >= VARIANT_ROWS or i + 1 == len(pdf):
                yield pdf.iloc[begin : i + 1]
                begin, held = i + 1, 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        epoch, us = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc), dt.timedelta(microseconds=1)
        with _Lease(make_backend, key) as lease:
            for pdf in (part for batch in batches for part in parts(batch)):
                n = len(pdf)
                wanted = pdf[wanted_col].tolist() if wanted_col else [range(len(variants))] * n
                wanted = [[] if w is None else [int(v) for v in w] for w in wanted]
                if not any(wanted):
                    continue
                inputs = pdf[input_col].tolist()
                skips = pdf[skip_col].tolist() if skip_col else [None] * n
                sent = [i for i in range(n) if wanted[i] and _absent(skips[i])]
                built = [build(inputs[i], variants[v]) for i in sent for v in wanted[i]]
                answers = iter(_called(lease.get(), built, [settings] * len(built), batch_size, concurrency) if built else ())
                now, called = dt.datetime.now(dt.timezone.utc), set(sent)
                skipped = [None if _absent(s) else ("", 0.0, now, str(s)) for s in skips]
                rows = [[next(answers) if i in called else skipped[i] for _ in w] for i, w in enumerate(wanted)]
                model_id, device = (getattr(lease.backend, a, None) for a in ("model_id", "device"))
                if not per_row:
                    at = [i for i, w in enumerate(wanted) for _ in w]
                    texts, secs, stamps, errors = map(list, zip(*(r for row in rows for r in row)))
                    out = {c: [column[i] for i in at] for c in out_cols for column in [pdf[c].tolist()]}
                    out |= {c: [variants[v][c] for w in wanted for v in w] for c in named}
                    out |= {"text": texts, "model_id": [model_id if i in called else None for i in at],
                            "inference_time_seconds": secs, "timestamp": stamps,
                            "device": [device if i in called else None for i in at], "error": errors,
                            "success": [e is None for e in errors]}
                    yield pd.DataFrame(out)
                    continue
                out = {"_variant": wanted, "_text": [[r[0] for r in row] for row in rows],
                       "_seconds": [[r[1] for r in row] for row in rows],
                       "_micros": [[(r[2] - epoch) // us for r in row] for row in rows],
                       "_error": [[r[3] for r in row] for row in rows],
                       "_model_id": [model_id if i in called else None for i in range(n)],
                       "_device": [device if i in called else None for i in range(n)]}
                yield pdf[out_cols].assign(**out)

    if not per_row:
        fields = [projected.schema[c] for c in out_cols] + [T.StructField(c, T.StringType()) for c in named]
        return projected.mapInPandas(run, envelope_schema(fields))
    made = [("_variant", T.ArrayType(T.IntegerType())), ("_text", T.ArrayType(T.StringType())),
            ("_seconds", T.ArrayType(T.DoubleType())), ("_micros", T.ArrayType(T.LongType())),
            ("_error", T.ArrayType(T.StringType())), ("_model_id", T.StringType()), ("_device", T.StringType())]
    fields = [projected.schema[c] for c in out_cols] + [T.StructField(c, kind) for c, kind in made]
    rows = per_row(projected.mapInPandas(run, T.StructType(fields)))
    lists = [c for c, kind in made if isinstance(kind, T.ArrayType)]
    kept = [c for c in rows.columns if c not in lists]
    each = posexplode_rows(rows, kept, F.arrays_zip(*lists), value="_call")
    call = F.col("_call")
    envelope = {
        "text": call["_text"], "model_id": F.col("_model_id"), "inference_time_seconds": call["_seconds"],
        "timestamp": F.timestamp_micros(call["_micros"]), "device": F.col("_device"), "error": call["_error"],
        "success": call["_error"].isNull(),
    }
    names = {c: F.get(F.array(*[F.lit(v[c]) for v in variants]).cast("array<string>"), call["_variant"]) for c in named}
    return each.select(*[c for c in kept if c not in ("_model_id", "_device")], *[v.alias(c) for c, v in (names | envelope).items()])


def settings_overlay(max_tokens: Column, settings: Settings = Settings()) -> Column:
    """Per-request token limit over the default."""
    return F.coalesce(max_tokens.cast("int"), F.lit(settings.max_new_tokens))


def build_request(file_block: Column, prompt: Column, model: Column, max_tokens: int = 1024) -> Column:
    """I8: chat request: one user message whose content is the file block, then the prompt text."""
    text_block = F.struct(
        F.lit("text").alias("type"),
        F.lit(None).cast("struct<type:string,media_type:string,data:string>").alias("source"),
        prompt.alias("text"),
    )
    return F.struct(
        model.alias("model"),
        F.lit(max_tokens).alias("max_tokens"),
        F.array(F.struct(F.lit("user").alias("role"), F.array(file_block, text_block).alias("content"))).alias("messages"),
    )


def first_text_block(content: Column) -> Column:
    """Text of the first ``text`` block, ``""`` when there is none (no error on an empty array)."""
    return F.coalesce(F.get(F.filter(content, lambda b: b["type"] == "text"), 0)["text"], F.lit(""))


def result_envelope(text: Column, model_id: Column, seconds: Column, timestamp: Column, device: Column,
                    error: Column) -> Column:
    """Result record; ``success`` is ``error IS NULL``."""
    return F.struct(
        text.alias("text"),
        model_id.alias("model_id"),
        seconds.alias("inference_time_seconds"),
        timestamp.alias("timestamp"),
        device.alias("device"),
        error.alias("error"),
        error.isNull().alias("success"),
    )


def result_json(envelope: Column) -> Column:
    """The envelope as JSON, NULL error kept as ``null``; the timestamp (an instant) as
    Python's ``isoformat()`` of a UTC datetime (``…+00:00``, fraction only when not zero)."""
    e = envelope
    return F.to_json(
        F.struct(
            e["text"].alias("text"),
            e["model_id"].alias("model_id"),
            e["inference_time_seconds"].alias("inference_time_seconds"),
            iso_utc_text(e["timestamp"]).alias("timestamp"),
            e["device"].alias("device"),
            e["error"].alias("error"),
            e["success"].alias("success"),
        ),
        {"ignoreNullFields": "false"},
    )
