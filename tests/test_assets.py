"""Binary inputs: file scan (S6), header facts (T-6), fetch by URL."""

import os
import struct
import tempfile
import zlib

from pyspark.sql import functions as F

from folio.operators import triage as TR
from folio.sources import assets


def tiny_png(w, h, color_type=2):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data) & 0xFFFFFFFF)

    raw = b"".join(b"\x00" + b"\x00" * (w * 3) for _ in range(h))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color_type, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_scan_attach_facts_and_triage(spark):
    folder = tempfile.mkdtemp(prefix="assets-")
    with open(os.path.join(folder, "a.png"), "wb") as fh:
        fh.write(tiny_png(3, 2))
    with open(os.path.join(folder, "b.png"), "wb") as fh:
        fh.write(tiny_png(5, 4, color_type=6))
    with open(os.path.join(folder, "c.txt"), "w") as fh:
        fh.write("not an image")
    files = assets.scan_assets(spark, folder, glob="*.png")
    assert files.count() == 2
    req = spark.createDataFrame([(1, os.path.join(folder, "a.png")), (2, os.path.join(folder, "b.png")),
                                 (3, os.path.join(folder, "gone.png"))], "id long, in string")
    joined = assets.attach_assets(req, files)
    facts = assets.header_facts(joined).select("id", "missing", "facts.*").orderBy("id").collect()
    assert [(r.id, r.missing, r.format, r.width, r.height, r.bands) for r in facts] == [
        (1, False, "PNG", 3, 2, 3), (2, False, "PNG", 5, 4, 4), (3, True, None, None, None, None)
    ]
    status = TR.triage_status(
        assets.header_facts(joined).select("id", "missing", F.col("facts.format").alias("format"),
                                           F.col("facts.width").alias("width"), F.col("facts.height").alias("height"),
                                           F.col("facts.bands").alias("channels"))
    )
    assert sorted((r.id, r.status) for r in status.collect()) == [(1, 200), (2, 200), (3, 404)]


def test_header_readers_agree_with_the_facts(spark):
    rows = [(1, "JPEG", 640, 480, 3), (2, "TIFF", 300, 200, 4), (3, "WEBP", 1000, 700, 4), (4, "GIF", 20, 10, 3),
            (5, "BMP", 33, 44, 3), (6, None, 1, 1, 1), (7, "jpg", 10, 20, 1)]
    df = spark.createDataFrame(rows, "id long, format string, width int, height int, channels int")
    files = df.select("id", assets.synth_header(F.col("format"), F.col("width"), F.col("height"), F.col("channels")).alias("content"))
    got = {r.id: (r.format, r.width, r.height, r.bands) for r in assets.header_facts(files).select("id", "facts.*").collect()}
    assert got == {1: ("JPEG", 640, 480, 3), 2: ("TIFF", 300, 200, 4), 3: ("WEBP", 1000, 700, 4), 4: ("GIF", 20, 10, 1),
                   5: ("BMP", 33, 44, 3), 6: (None, None, None, None), 7: ("JPEG", 10, 20, 1)}


def _fake_fetch(url, timeout):
    if "404" in url:
        raise IOError("HTTP 404")
    return url.encode()


def test_fetch_assets_errors_are_rows(spark):
    df = spark.createDataFrame([(i, f"http://h{i % 2}.example/{'404' if i == 3 else i}.png") for i in range(8)],
                               "id long, url string")
    got = {r.id: r for r in assets.fetch_assets(df, _fake_fetch).collect()}
    assert len(got) == 8
    assert got[3].content is None and "404" in got[3].error
    assert got[2].content == b"http://h0.example/2.png" and got[2].error is None


def test_fetch_spreads_a_hot_host_unless_bounded(spark):
    df = spark.createDataFrame([(i, f"http://hot.example/{i}.png") for i in range(200)], "id long, url string").coalesce(1)

    def tasks(out):
        return out.select(F.spark_partition_id().alias("p")).distinct().count()

    spread = assets.fetch_assets(df, _fake_fetch)
    assert spread.where("error is null").count() == 200 and tasks(spread) > 4
    assert tasks(assets.fetch_assets(df, _fake_fetch, host_slots=2)) <= 2


def test_undecodable_and_late_headers(spark):
    jpeg_late = b"\xff\xd8" + b"\xff\xe1\xff\xff" + b"\0" * 65533 + b"\xff\xff\xff\xc0\0\x11\x08\x23\x28\x23\x28\x03" + b"\0" * 12
    tiff_bad = b"II*\0" + struct.pack("<I", 10**9) + b"\0" * 70000
    rows = [(1, b"junk that is no image"), (2, tiny_png(3, 2)[:20]), (3, jpeg_late), (4, tiff_bad), (5, b""), (6, None),
            (7, tiny_png(3, 2)[:16] + b"\xff" * 8 + b"\x08\x02\0\0\0"), (8, tiny_png(3, 2)[:16] + b"\0" * 8 + b"\x08\x02\0\0\0")]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "id long, content binary")
    got = {r.id: r for r in assets.header_facts(df).collect()}
    assert {i: r.decodable for i, r in got.items()} == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True, 8: False}
    assert got[3].facts.width == 9000 and got[7].facts.width == 2**32 - 1
    bmp = {bpp: b"BM" + b"\0" * 12 + struct.pack("<IiiHH", 40, 7, -5, 1, bpp) + b"\0" * 24 for bpp in (8, 16, 24, 32)}
    facts = assets.header_facts(spark.createDataFrame([(k, bytearray(v)) for k, v in bmp.items()], "id long, content binary"))
    assert {r.id: (r.facts.width, r.facts.height, r.facts.bands) for r in facts.collect()} == {
        8: (7, 5, 1), 16: (7, 5, 3), 24: (7, 5, 3), 32: (7, 5, 3)}
