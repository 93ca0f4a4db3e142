"""Backend lifecycle (I1-I6) and the stream."""

import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from folio import testing as SI
from folio.operators import inference as I
from folio.schemas import Settings
from folio.streaming.inference_stream import start_inference_stream

try:  # the test backend below is shipped to the Python workers by value
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:
    pass


class CountingBackend(I.BaseBackend):
    """Writes one marker file per load and per unload into a folder shared with the test."""

    model_id = "counting"

    def __init__(self, folder):
        super().__init__()
        self.folder = folder

    def _load(self):
        open(os.path.join(self.folder, f"load-{uuid.uuid4().hex}"), "w").close()

    def unload(self):
        open(os.path.join(self.folder, f"unload-{uuid.uuid4().hex}"), "w").close()
        super().unload()

    def _generate(self, x, settings):
        if x == "boom":
            raise ValueError("bad input")
        return f"{x}:{settings.max_new_tokens}"


def test_generate_before_load_fails():
    b = SI.EchoTextBackend()
    with pytest.raises(RuntimeError):
        b.generate("x", Settings())
    b.load()
    b.load()  # second load is a no-op
    assert b.is_loaded()


def test_one_load_per_nonempty_partition_and_error_rows(spark):
    folder = tempfile.mkdtemp(prefix="loads-")
    df = spark.createDataFrame([(i, "boom" if i == 3 else f"p{i}", 7 if i == 1 else None) for i in range(6)],
                               "k long, prompt string, limit int").repartition(3, "k")
    df = df.union(spark.createDataFrame([], df.schema)).coalesce(4)  # some partitions may be empty
    out = I.run_batch(df, lambda: CountingBackend(folder), "prompt", ["k"], Settings(max_new_tokens=5), settings_col="limit")
    got = {r.k: r for r in out.collect()}
    assert got[3].success is False and got[3].text == "" and "bad input" in got[3].error
    assert got[1].text == "p1:7" and got[0].text == "p0:5" and got[0].success
    nonempty = df.select(F.spark_partition_id().alias("p")).distinct().count()
    loads = [f for f in os.listdir(folder) if f.startswith("load-")]
    unloads = [f for f in os.listdir(folder) if f.startswith("unload-")]
    assert len(loads) == nonempty and len(unloads) == nonempty


def test_stream_equals_batch_and_restart_adds_nothing(spark):
    from folio.session import shared_path

    run = uuid.uuid4().hex
    src, sink, ckpt = (shared_path(spark, "test-stream", run, x) for x in ("in", "out", "ckpt"))
    reqs = spark.createDataFrame([(i, f"prompt number {i}", None) for i in range(20)], "req_id long, prompt string, max_tokens int")
    reqs.write.parquet(src)
    args = (spark, src, reqs.schema, sink, ckpt, SI.EchoTextBackend, "prompt", ["req_id"])
    start_inference_stream(*args, settings_col="max_tokens").awaitTermination()
    first = spark.read.parquet(sink)
    batch = I.run_batch(reqs, SI.EchoTextBackend, "prompt", ["req_id"], settings_col="max_tokens")
    cols = ["req_id", "text", "success"]
    assert sorted(first.select(*cols).collect()) == sorted(batch.select(*cols).collect())
    start_inference_stream(*args, settings_col="max_tokens").awaitTermination()  # restart from the checkpoint
    assert spark.read.parquet(sink).count() == 20


def test_slots_spread_one_long_document_over_tasks(spark):
    # 400 pages of one document, all in one input partition (as a long document arrives).
    pages = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), (F.col("id") + 1).alias("page_no"),
                                    F.concat(F.lit("page "), F.col("id").cast("string")).alias("text")).coalesce(1)
    out = I.run_batch(pages, SI.EchoTextBackend, "text", ["doc_id", "page_no"], slots=4)
    per_task = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per_task) == 4 and min(r["count"] for r in per_task) > 50
    assert out.where("success").count() == 400
    again = I.run_batch(pages, SI.EchoTextBackend, "text", ["doc_id", "page_no"], slots=4)
    where = lambda df: sorted(df.select("page_no", F.spark_partition_id().alias("p")).collect())
    assert where(out) == where(again)  # the same rows go to the same task on a rerun


def _png(w, h, color_type=2):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data) & 0xFFFFFFFF)

    raw = zlib.compress(b"\x00" * (h * (w * 3 + 1)))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color_type, 0, 0, 0))
            + chunk(b"IDAT", raw) + chunk(b"IEND", b""))


def test_upload_stream_triages_then_reads_each_image_once(spark):
    from folio.session import shared_path
    from folio.streaming.inference_stream import start_upload_stream

    run = uuid.uuid4().hex
    src, sink, ckpt = (shared_path(spark, "test-uploads", run, x) for x in ("in", "out", "ckpt"))
    local = src[len("file:"):] if src.startswith("file:") else src  # the folder is a URI; files are written locally
    os.makedirs(local)
    files = {"a.png": _png(3, 2), "big.png": _png(2000, 1400, color_type=6),  # 2000*1400*4 bytes > 10 MiB
             "c.gif": b"GIF89a" + (40).to_bytes(2, "little") + (30).to_bytes(2, "little") + b"\x00" * 16}
    for name, data in files.items():
        with open(os.path.join(local, name), "wb") as fh:
            fh.write(data)
    args = (spark, src, sink, ckpt, SI.ImageSizeBackend)
    start_upload_stream(*args).awaitTermination()
    got = {os.path.basename(r.path): r for r in spark.read.parquet(sink).collect()}
    assert got["a.png"].success and got["a.png"].text == "image 3x2" and got["a.png"].status == 200
    assert (got["big.png"].status, got["big.png"].error, got["big.png"].success) == (400, "too_large", False)
    assert (got["c.gif"].status, got["c.gif"].error, got["c.gif"].format) == (400, "unsupported_format", "GIF")
    assert got["big.png"].model_id is None and got["a.png"].model_id == "image-size"  # rejected: never sent to the model
    start_upload_stream(*args).awaitTermination()  # restart: nothing new
    assert spark.read.parquet(sink).count() == 3
    with open(os.path.join(local, "d.png"), "wb") as fh:
        fh.write(_png(7, 5))
    start_upload_stream(*args).awaitTermination()  # a new arrival is read alone
    after = {os.path.basename(r.path): r.text for r in spark.read.parquet(sink).collect()}
    assert len(after) == 4 and after["d.png"] == "image 7x5"


def test_skipped_rows_load_no_model(spark):
    folder = tempfile.mkdtemp(prefix="loads-")
    df = spark.createDataFrame([(i, f"p{i}", "rejected" if i < 4 else None) for i in range(6)],
                               "k long, prompt string, err string").repartition(2, F.expr("k < 4"))
    out = I.run_batch(df, lambda: CountingBackend(folder), "prompt", ["k"], skip_col="err")
    got = {r.k: r for r in out.collect()}
    assert got[0].error == "rejected" and not got[0].success and got[5].text == "p5:4096"
    loads = [f for f in os.listdir(folder) if f.startswith("load-")]
    assert len(loads) == 1  # the partition holding only rejected rows never loaded a model


class BatchBackend(I.BaseBackend):
    """Upper-cases; one input fails; the batched call marks its texts."""

    model_id = "batch"

    def _generate(self, x, settings):
        if x == "bad":
            raise ValueError("cannot")
        return f"{x.upper()}@{settings.device}"

    def generate_batch(self, xs, settings):
        return ["*" + self._generate(x, settings) for x in xs]


def test_batched_and_concurrent_calls_and_device_override(spark):
    rows = [(i, "bad" if i == 5 else f"t{i}", "cuda" if i % 4 == 0 else None, None) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, x string, device string, n string").coalesce(1)
    plain = {r.id: r for r in I.run_batch(df, BatchBackend, "x", ["id"], device_col="device").collect()}
    assert plain[4].text == "T4@cuda" and plain[4].device == "cuda" and plain[1].text == "T1@cpu" and plain[1].device == "cpu"
    assert plain[5].success is False and plain[5].error == "ValueError: cannot"
    flight = {r.id: (r.text, r.error) for r in I.run_batch(df, BatchBackend, "x", ["id"], device_col="device", concurrency=4).collect()}
    assert flight == {i: (r.text, r.error) for i, r in plain.items()}
    batched = {r.id: (r.text, r.error) for r in I.run_batch(df, BatchBackend, "x", ["id"], batch_size=4).collect()}
    assert batched[0][0] == "*T0@cpu" and batched[11][0] == "*T11@cpu"
    assert batched[5][1] == "ValueError: cannot" and batched[4][0] == "T4@cpu"  # its batch went row by row


def test_a_limit_that_is_no_number_is_an_error_row(spark):
    df = spark.createDataFrame([(1, "a", "12"), (2, "b", "many")], "id long, x string, n string")
    got = {r.id: r for r in I.run_batch(df, SI.EchoTextBackend, "x", ["id"], settings_col="n").collect()}
    assert got[1].success and "max 12" in got[1].text and got[2].success is False and "ValueError" in got[2].error
