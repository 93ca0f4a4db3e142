"""Inference on arriving requests (I10): file stream -> the batch operator unchanged -> sink.

Three routes: text requests arriving as Parquet files; uploaded images arriving as files
(``binaryFile``), which are triaged by their headers before OCR; and URL requests, which are fetched,
triaged and read, with a sink for results and one for rejects. Stateless: no watermark, no state
store. The checkpoint makes a restart add no duplicate rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import testing as SI
from ..operators import inference as I
from ..operators import triage as TR
from ..schemas import VALIDATION_FORMATS, Settings
from ..session import shared_path
from ..sources.assets import fetch_assets, header_facts


def start_inference_stream(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint_dir: str,
                           make_backend: Callable[[], I.Backend], input_col: str, keys: list[str],
                           settings: Settings = Settings(), settings_col: str | None = None,
                           available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream; with ``available_now`` it processes what is there and stops."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    out = I.run_batch(src, make_backend, input_col, keys, settings, settings_col=settings_col)
    writer = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
    writer = writer.outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def requests_stream_roundtrip(spark: SparkSession, requests: DataFrame, run_id: str | None = None) -> DataFrame:
    """Write requests as arriving files under the shared folder, stream them through the text
    backend once (``availableNow``), and return the sink as a table."""
    run_id = run_id or uuid.uuid4().hex
    src = shared_path(spark, "stream", run_id, "in")
    sink = shared_path(spark, "stream", run_id, "out")
    ckpt = shared_path(spark, "stream", run_id, "checkpoint")
    requests.write.mode("overwrite").parquet(src)
    schema = spark.read.parquet(src).schema
    q = start_inference_stream(spark, src, schema, sink, ckpt, SI.EchoTextBackend, "prompt", ["req_id"],
                               settings_col="max_tokens")
    q.awaitTermination()
    return spark.read.parquet(sink).select("req_id", "model_id", "success", "error", F.length("text").alias("n_chars"))


# The fixed schema of the binaryFile source (a stream must be given it).
BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("modificationTime", T.TimestampType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("content", T.BinaryType(), True),
    ]
)


def ocr_files(files: DataFrame, make_backend: Callable[[], I.Backend], settings: Settings = Settings(),
              max_mb: float = 10, accepted=VALIDATION_FORMATS) -> DataFrame:
    """Uploaded files (``binaryFile`` rows, batch or stream) -> header facts -> triage -> OCR.

    One row per file: the status and error class of the checks (decodable, format, size), and the
    result envelope. A rejected file becomes an error row without a model call, and its bytes
    are not sent to Python. Works the same on a batch scan and on a stream.
    """
    facts = header_facts(files.select("path", "content"))
    f = F.col("facts")
    status, error_class = TR.status_of(F.lit(False), f["format"], f["width"], f["height"], f["bands"], max_mb, accepted,
                                    F.col("decodable"))
    staged = facts.select(
        "path",
        status.alias("status"),
        error_class.alias("error_class"),
        f["format"].alias("format"),
        F.when(error_class.isNull(), F.col("content")).alias("content"),
    )
    return I.run_batch(staged, make_backend, "content", ["path"], settings, carry=["status", "error_class", "format"],
                       skip_col="error_class")


def ocr_urls(urls: DataFrame, fetcher: Callable[[str, float], bytes], make_backend: Callable[[], I.Backend],
             key: str = "id", url_col: str = "url", settings: Settings = Settings(), max_mb: float = 10,
             accepted=VALIDATION_FORMATS) -> DataFrame:
    """The URL route: fetch -> decode check -> triage -> OCR, one row per URL.

    ``status``: 422 when the download fails, 400 for bytes that are no acceptable image, 500 when the
    model fails, else 200. Only accepted bytes are sent on to the model stage.
    """
    facts = header_facts(fetch_assets(urls, fetcher, url_col, key))
    f = F.col("facts")
    status, error_class = TR.status_of(F.lit(False), f["format"], f["width"], f["height"], f["bands"], max_mb, accepted,
                                       F.col("decodable"))
    failed = F.col("error").isNotNull()
    staged = facts.select(
        key,
        F.when(failed, F.lit(TR.STATUS["download"])).otherwise(status).alias("checked"),
        F.when(failed, F.lit("download_failed")).otherwise(error_class).alias("error_class"),
        "content",
    ).withColumn("content", F.when(F.col("error_class").isNull(), F.col("content")))
    out = I.run_batch(staged, make_backend, "content", [key], settings, carry=["checked", "error_class"],
                      skip_col="error_class")
    broken = F.col("error_class").isNull() & ~F.col("success")
    return out.withColumns({
        "status": F.when(broken, F.lit(TR.STATUS["processing"])).otherwise(F.col("checked")),
        "error_class": F.when(broken, F.lit("processing_failed")).otherwise(F.col("error_class")),
    }).drop("checked")


def start_upload_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                        make_backend: Callable[[], I.Backend], glob: str | None = None, settings: Settings = Settings(),
                        max_mb: float = 10, accepted=VALIDATION_FORMATS, available_now: bool = True,
                        max_files_per_trigger: int | None = None, recursive: bool = False):
    """OCR of images as they arrive in ``source_dir`` (the upload route as a stream)."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = ocr_files(reader.load(source_dir), make_backend, settings, max_mb, accepted)
    writer = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
    writer = writer.outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


# ---------------------------------------------------------------- the URL route

RESULTS, REJECTS = "results", "rejects"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def url_batch_writer(sink_dir: str, fetcher: Callable[[str, float], bytes], make_backend: Callable[[], I.Backend], key: str = "id",
                     url_col: str = "url", settings: Settings = Settings(), max_mb: float = 10, accepted=VALIDATION_FORMATS):
    """A ``foreachBatch`` function: one pass over the batch's URLs, then both sinks.

    The outcome is written once before the sinks read it, so a URL is fetched and a model called once
    for two sinks. Every folder carries the batch id: a batch that is run again after a crash replaces its
    own folders, and takes a complete outcome as it is instead of fetching again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged = f"{sink_dir}/outcome/batch={batch_id}"
        if not _exists(spark, f"{staged}/_SUCCESS"):
            outcome = ocr_urls(batch, fetcher, make_backend, key, url_col, settings, max_mb, accepted)
            outcome.write.mode("overwrite").parquet(staged)
        outcome = spark.read.parquet(staged)
        fine = F.col("status") == TR.STATUS["ok"]
        outcome.where(fine).drop("error", "error_class").write.mode("overwrite").parquet(f"{sink_dir}/{RESULTS}/batch={batch_id}")
        rejected = outcome.where(~fine).select(key, "status", "error_class", "error", "timestamp")
        rejected.write.mode("overwrite").parquet(f"{sink_dir}/{REJECTS}/batch={batch_id}")
        _remove(spark, staged)

    return write


def start_url_stream(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint_dir: str,
                     fetcher: Callable[[str, float], bytes], make_backend: Callable[[], I.Backend], key: str = "id",
                     url_col: str = "url", settings: Settings = Settings(), available_now: bool = True,
                     max_files_per_trigger: int | None = None, **checks):
    """OCR of the images behind URLs as requests arrive: fetch, triage, model, results and rejects."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    write = url_batch_writer(sink_dir, fetcher, make_backend, key, url_col, settings, **checks)
    writer = reader.parquet(source_dir).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_url_sinks(spark: SparkSession, sink_dir: str, key_field: T.StructField) -> tuple[DataFrame, DataFrame]:
    """Results and rejects of all batches; empty tables where no batch has been written."""
    results = T.StructType([key_field, *[f for f in I.ENVELOPE_FIELDS if f.name != "error"], T.StructField("status", T.IntegerType()),
                            T.StructField("batch", T.LongType())])
    rejects = T.StructType([key_field, T.StructField("status", T.IntegerType()), T.StructField("error_class", T.StringType()),
                            T.StructField("error", T.StringType()), T.StructField("timestamp", T.TimestampType()),
                            T.StructField("batch", T.LongType())])
    return tuple(
        spark.read.schema(schema).parquet(f"{sink_dir}/{name}") if _exists(spark, f"{sink_dir}/{name}")
        else spark.createDataFrame([], schema)
        for name, schema in ((RESULTS, results), (REJECTS, rejects))
    )
