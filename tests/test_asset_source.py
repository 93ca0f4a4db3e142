"""Files scanned by their headers (S6) and read in the task that needs them."""

import os
import struct
import tempfile

from pyspark.sql import functions as F

from folio.operators import triage as TR
from folio.sources import asset_source as S
from folio.sources import stores
from folio.sources.image_headers import read_facts
from test_assets import tiny_png

JPEG_LATE = b"\xff\xd8" + (b"\xff\xe1\xff\xff" + b"\0" * 65533) * 3 + b"\xff\xff\xff\xc0\0\x11\x08\x23\x28\x23\x28\x03" + b"\0" * 12
TIFF_LATE = b"II*\0" + struct.pack("<I", 500_000) + b"\0" * (500_000 - 8) + struct.pack(
    "<HHHIHHHHIIHHIHH", 3, 256, 3, 1, 30, 0, 257, 4, 1, 20, 277, 3, 1, 3, 0)


def _folder(files: dict[str, bytes]) -> str:
    folder = tempfile.mkdtemp(prefix="scan-")
    for name, content in files.items():
        os.makedirs(os.path.dirname(os.path.join(folder, name)), exist_ok=True)
        with open(os.path.join(folder, name), "wb") as f:
            f.write(content)
    return folder


def _window(b):
    return lambda place, n: b[place : place + n]


def test_headers_wherever_they_lie():
    assert read_facts(_window(tiny_png(3, 2))) == ("PNG", 3, 2, 3)
    assert read_facts(_window(JPEG_LATE)) == ("JPEG", 9000, 9000, 3)
    assert read_facts(_window(TIFF_LATE)) == ("TIFF", 30, 20, 3)
    assert read_facts(_window(b"%PDF-1.7 ......")) == ("PDF", None, None, None)
    assert [read_facts(_window(b)) for b in (b"", b"\xff\xd8\xff", b"GIF8", tiny_png(3, 2)[:20], b"junk" * 20)] == [None] * 5


def test_scan_reads_headers_only_and_splits_by_files(spark):
    files = {f"{i % 3}/{i}.png": tiny_png(i + 1, 2) + b"\0" * 100_000 for i in range(20)}
    files |= {"a/late.jpg": JPEG_LATE, "a/late.tif": TIFF_LATE, "a/empty.png": b"", "a/note.txt": b"no image"}
    folder = _folder(files)
    found = S.scan_headers(spark, folder, filesPerTask=5)
    assert found.rdd.getNumPartitions() == 5
    rows = {os.path.relpath(r.path, folder): r for r in found.collect()}
    assert set(rows) == set(files)
    assert all(rows[n].length == len(files[n]) and rows[n].bytes_read <= 200 for n in files)
    assert {n: (r.format, r.width, r.height, r.bands) for n, r in rows.items() if n.startswith("a/")} == {
        "a/late.jpg": ("JPEG", 9000, 9000, 3), "a/late.tif": ("TIFF", 30, 20, 3), "a/empty.png": (None,) * 4, "a/note.txt": (None,) * 4}
    assert {n for n, r in rows.items() if not r.decodable} == {"a/empty.png", "a/note.txt"}
    assert S.scan_headers(spark, folder, glob="*.tif").count() == 1
    assert S.scan_headers(spark, folder, minBytes=1, maxBytes=50).count() == 1
    assert S.scan_headers(spark, os.path.join(folder, "nowhere")).count() == 0


def test_a_file_that_cannot_be_opened_is_a_row():
    row = S.header_row("/nowhere/at/all.png", 10, 0.0)
    assert row[0] == "/nowhere/at/all.png" and row[3] is None and "FileNotFoundError" in row[-1]


def test_triage_needs_no_content_and_reading_no_shuffle(spark):
    folder = _folder({"a.png": tiny_png(3, 2), "b.jpg": JPEG_LATE, "c.txt": b"text"})
    asked = spark.createDataFrame([(k, os.path.join(folder, n)) for k, n in enumerate(["a.png", "b.jpg", "c.txt", "gone.png"])],
                                  "id long, path string")
    matched = S.match_headers(asked, S.scan_headers(spark, folder), "path")
    sizes = [F.col(c) for c in ("width", "height", "bands")]
    status, error = TR.status_of(F.col("missing"), F.col("format"), *sizes, decodable=F.col("decodable"))
    triaged = matched.select("id", "path", status.alias("status"), error.alias("error_class"))
    assert "content" not in triaged._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.status, r.error_class) for r in triaged.orderBy("id").collect()] == [
        (200, None), (400, "too_large"), (400, "invalid_image"), (404, "not_found")]
    kept = triaged.withColumn("wanted", F.col("status") == 200)
    read = S.with_content(kept, "path", "wanted")
    assert S.with_content(asked, "path")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    got = {r.id: r for r in read.collect()}
    assert got[0].content == tiny_png(3, 2) and [got[k].content for k in (1, 2, 3)] == [None] * 3
    errors = {r.id: r.read_error for r in S.with_content(asked, "path").collect()}
    assert errors[0] is None and "FileNotFoundError" in errors[3]


def test_stores_write_whole_files_and_list_them():
    folder = tempfile.mkdtemp(prefix="store-")
    stores.write_bytes(f"file:{folder}/x/1.bin", b"one")
    stores.write_bytes(f"{folder}/x/1.bin", b"two")
    assert stores.read_bytes(f"file://{folder}/x/1.bin") == b"two"
    assert [(os.path.relpath(n, folder), size) for n, size, _ in stores.list_files(folder)] == [("x/1.bin", 3)]
    assert stores.list_files(folder, recursive=False) == []
