"""S6 without the bytes: files as rows of header facts.

``asset_headers`` is a data source: its partitions are ranges of the file listing, and a task opens its
files and reads the header bytes only (some dozen bytes; a JPEG's segments and a TIFF's directory are found
by seeks). A corpus of images is so triaged without moving or even reading its content;
:func:`with_content` then reads the bytes of the files that passed, in the task that needs them, so
they cross no shuffle.

Millions of small files cost a disk block each and a listing of them all. With the option ``archives`` the files
that are read are members of ZIP archives: the driver lists the archives only, a task reads the directories of its
archives, and a member is a row like a file, named by the archive's path and its own.

A file that cannot be opened, is empty or is no image is a row with ``error`` or without facts; it does not
fail the task. A file that goes away between listing and reading is such a row, too.
"""

from __future__ import annotations

import datetime as dt
import posixpath
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import stores
from .image_headers import read_facts

SCHEMA = (
    "path string, length long, modified timestamp, format string, width long, height long, bands long, "
    "bytes_read long, error string"
)
_ARROW = pa.schema(
    [("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("format", pa.string())]
    + [(c, pa.int64()) for c in ("width", "height", "bands", "bytes_read")]
    + [("error", pa.string())]
)
#: The first read of a file: holds the whole header of all formats with a fixed one.
HEAD = 64
FILES_PER_TASK = 2000
IN_FLIGHT = 8
#: What broken, cut, locked or unknown archives and members raise.
UNREADABLE = (OSError, ValueError, EOFError, RuntimeError, zipfile.BadZipFile, zlib.error)
#: Members of an archive that :class:`ArchiveWriter` writes, at most.
MEMBERS = 10_000
#: Bytes of contents that a task hands on at once.
CONTENT_BYTES = 32 * 1024 * 1024


@dataclass
class FileRange(InputPartition):
    files: list[tuple[str, int, float]]


class _Window:
    """Reads of an open file, counted; the first bytes are read once."""

    def __init__(self, file):
        self.file, self.head = file, file.read(HEAD)
        self.bytes_read = len(self.head)

    def __call__(self, place: int, n: int) -> bytes:
        if place + n <= len(self.head) or len(self.head) < HEAD:
            return self.head[place : place + n]
        self.file.seek(place)
        got = self.file.read(n)
        self.bytes_read += len(got)
        return got


def header_row(path: str, length: int, modified: float) -> tuple:
    """One file's row of :data:`SCHEMA`."""
    facts, read, error = None, 0, None
    try:
        store, inside, _ = stores.open_store(path)
        with store.open_input_file(inside) as file:
            window = _Window(file)
            facts = read_facts(window)
            read = window.bytes_read
    except OSError as e:
        error = f"{type(e).__name__}: {e}"
    return path, length, dt.datetime.fromtimestamp(modified, dt.timezone.utc), *(facts or (None,) * 4), read, error


def member_rows(path: str, modified: float, wanted) -> Iterator[tuple]:
    """Rows of :data:`SCHEMA` for the members of an archive whose name and length ``wanted`` accepts. An archive that
    cannot be read is one row with an error."""
    when = dt.datetime.fromtimestamp(modified, dt.timezone.utc)
    try:
        store, inside, _ = stores.open_store(path)
        with store.open_input_file(inside) as raw, zipfile.ZipFile(raw) as archive:
            for member in archive.infolist():
                if member.is_dir() or not wanted(member.filename, member.file_size):
                    continue
                facts, read, error = None, 0, None
                try:
                    with archive.open(member) as file:
                        window = _Window(file)
                        facts = read_facts(window)
                        read = window.bytes_read
                except UNREADABLE as e:
                    error = f"{type(e).__name__}: {e}"
                yield f"{path}/{member.filename}", member.file_size, when, *(facts or (None,) * 4), read, error
    except UNREADABLE as e:
        yield path, None, when, *(None,) * 4, 0, f"{type(e).__name__}: {e}"


class ArchiveWriter:
    """Files of one task into ZIP archives of at most :data:`MEMBERS` members, ``<folder>/<name>-<number>.zip``.

    An archive appears whole when it is finished, and a task that is tried again replaces its own."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name, self.number, self.archive = folder, name, -1, None

    def add(self, member: str, content: bytes | None) -> str:
        """The path of the member (a name that is taken gets a number); ``None`` as content writes nothing."""
        if self.archive is None or len(self.taken) >= MEMBERS:
            self.close()
            self.number += 1
            self.path = f"{self.folder}/{self.name}-{self.number:05d}.zip"
            self.store, self.inside, _ = stores.open_store(self.path)
            self.store.create_dir(posixpath.dirname(self.inside), recursive=True)
            self.part = f"{self.inside}.{uuid.uuid4().hex}.part"
            self.file = self.store.open_output_stream(self.part)
            self.archive, self.taken = zipfile.ZipFile(self.file, "w", zipfile.ZIP_DEFLATED), {}
        if content is None:
            return f"{self.path}/{member}"
        times = self.taken.get(member, 0)
        self.taken[member] = times + 1
        if times:
            stem, ending = posixpath.splitext(member)
            return self.add(f"{stem}~{times}{ending}", content)
        self.archive.writestr(member, content, compresslevel=1)
        return f"{self.path}/{member}"

    def close(self) -> None:
        if self.archive is not None:
            self.archive.close()
            self.file.close()
            self.store.move(self.part, self.inside)
            self.archive = None


class HeaderReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.path = options["path"]
        self.glob = options.get("glob")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.min_bytes = int(options.get("minBytes", 0))
        self.max_bytes = int(options.get("maxBytes", 2**63 - 1))
        self.per_task = int(options.get("filesPerTask", FILES_PER_TASK))
        self.in_flight = int(options.get("inFlight", IN_FLIGHT))
        self.archives = options.get("archives", "false").lower() == "true"

    def _wanted(self, name: str, length: int) -> bool:
        named = self.glob is None or fnmatch(posixpath.basename(name), self.glob)
        return named and self.min_bytes <= length <= self.max_bytes

    def partitions(self) -> list[InputPartition]:
        if self.archives:
            return [FileRange([f]) for f in stores.list_files(self.path, "*.zip", self.recursive)] or [FileRange([])]
        files = [f for f in stores.list_files(self.path, self.glob, self.recursive) if self.min_bytes <= f[1] <= self.max_bytes]
        return [FileRange(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [FileRange([])]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        if self.archives:
            for path, _, modified in partition.files:
                found = member_rows(path, modified, self._wanted)
                while rows := list(islice(found, 500)):
                    yield self._batch(rows)
            return
        with ThreadPoolExecutor(self.in_flight) as pool:
            for at in range(0, len(partition.files), 500):
                rows = list(pool.map(lambda f: header_row(*f), partition.files[at : at + 500]))
                yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)]
        return pa.RecordBatch.from_arrays(columns, schema=_ARROW)


class AssetHeaders(DataSource):
    """``spark.read.format("asset_headers").load(path)``; options ``glob``, ``recursive``, ``minBytes``,
    ``maxBytes``, ``filesPerTask``, ``inFlight``, ``archives``."""

    @classmethod
    def name(cls) -> str:
        return "asset_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options)


def scan_headers(spark: SparkSession, path: str, **options) -> DataFrame:
    """The files below ``path`` with their header facts and ``decodable``: a known format with sizes above 0."""
    spark.dataSource.register(AssetHeaders)
    files = spark.read.format("asset_headers").options(**{k: str(v) for k, v in options.items()}).load(path)
    sized = (F.col("width") > 0) & (F.col("height") > 0) & (F.col("bands") > 0)
    decodable = F.col("format").isNotNull() & ((F.col("format") == "PDF") | sized)
    return files.withColumn("decodable", F.coalesce(decodable, F.lit(False)))


def match_headers(requests: DataFrame, files: DataFrame, path_col: str = "in") -> DataFrame:
    """Requests with their file's facts; ``missing`` where there is no such file. Rows of metadata only."""
    facts = files.select([F.col(c).alias(f"_{c}") for c in files.columns])
    joined = requests.join(facts, F.col(path_col) == F.col("_path"), "left")
    renamed = joined.select(*requests.columns, *[F.col(f"_{c}").alias(c) for c in files.columns if c != "path"],
                            F.col("_path").isNull().alias("missing"))
    return renamed.withColumn("decodable", F.coalesce("decodable", F.lit(False)))


def with_content(df: DataFrame, path_col: str = "path", wanted: str | None = None, error_col: str = "read_error") -> DataFrame:
    """``df`` with ``content`` read from ``path_col`` in the task that holds the row (NULL where ``wanted`` is
    false or the file cannot be read: then ``error_col`` says why). No shuffle, no join."""
    schema = T.StructType([*df.schema.fields, T.StructField("content", T.BinaryType()), T.StructField(error_col, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            begin = held = 0
            contents, errors = [], []
            asked = pdf[wanted].tolist() if wanted else [True] * len(pdf)
            for k, (path, ask) in enumerate(zip(pdf[path_col], asked)):
                content, error = None, None
                if ask and path is not None:
                    try:
                        content = stores.read_bytes(path)
                        held += len(content)
                    except OSError as e:
                        error = f"{type(e).__name__}: {e}"
                contents.append(content)
                errors.append(error)
                if held >= CONTENT_BYTES or k + 1 == len(pdf):
                    yield pdf.iloc[begin : k + 1].assign(content=contents, **{error_col: errors})
                    begin, held, contents, errors = k + 1, 0, [], []

    return df.mapInPandas(run, schema)
