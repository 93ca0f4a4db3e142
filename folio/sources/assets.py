"""Binary inputs (S6, S7, T-6): scan files, read header facts, fetch by URL.

Bytes are large: rows are matched to files on the path by a join on metadata, and only the rows
that have a file take part in the join that brings its content.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .image_headers import PNG_BANDS, read_facts

FACTS = T.StructType(
    [
        T.StructField("format", T.StringType(), True),
        T.StructField("width", T.LongType(), True),
        T.StructField("height", T.LongType(), True),
        T.StructField("bands", T.LongType(), True),
    ]
)
#: Bytes that the first look at a header gets; formats whose header may lie anywhere get a second.
FIRST_LOOK = 65536
#: Bytes of fetched bodies that a task hands on at once.
FETCH_BYTES = 32 * 1024 * 1024
#: Downloads that wait at the same time in one task.
FETCHES_IN_FLIGHT = 8


def scan_assets(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """Files as rows ``(path, modificationTime, length, content)``."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.load(path)
    return df.withColumn("path", F.regexp_replace("path", r"^file:(//)?", ""))


def attach_assets(requests: DataFrame, files: DataFrame, path_col: str = "in") -> DataFrame:
    """Requests joined to their files on the path; missing files keep a row with ``missing = true``.

    Requests are matched on the file listing first. Only those with a file join the content, so
    missing files (which would share one NULL key) never reach that join.
    """
    listing = files.select(F.col("path").alias("_asset_path"), "length")
    joined = requests.join(listing, requests[path_col] == F.col("_asset_path"), "left")
    content = files.select(F.col("path").alias("_content_path"), "content")
    there = joined.where(F.col("_asset_path").isNotNull())
    found = there.join(content, F.col("_asset_path") == F.col("_content_path")).drop("_content_path")
    gone = joined.where(F.col("_asset_path").isNull()).withColumn("content", F.lit(None).cast("binary"))
    return found.unionByName(gone).withColumn("missing", F.col("_asset_path").isNull()).drop("_asset_path")


def _u32be(c: Column, pos: int) -> Column:
    return F.conv(F.hex(F.substring(c, pos, 4)), 16, 10).cast("long")


def _le(c: Column, pos: int, n: int) -> Column:
    """Little-endian unsigned integer of ``n`` bytes at 1-based ``pos``."""
    parts = [F.conv(F.hex(F.substring(c, pos + i, 1)), 16, 10).cast("long") * (256**i) for i in range(n)]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def header_facts_jvm(content: Column) -> Column:
    """Format, width, height and bands for PNG, BMP and GIF from their fixed headers (JVM only)."""
    magic = F.hex(F.substring(content, 1, 8))
    is_png = magic == "89504E470D0A1A0A"
    is_bmp = F.hex(F.substring(content, 1, 2)) == "424D"
    is_gif = F.hex(F.substring(content, 1, 4)) == "47494638"
    is_pdf = F.hex(F.substring(content, 1, 4)) == "25504446"
    color = F.conv(F.hex(F.substring(content, 26, 1)), 16, 10).cast("int")
    png_bands = F.element_at(F.create_map(*[F.lit(x) for kv in PNG_BANDS.items() for x in kv]), color)
    bpp = _le(content, 29, 2)
    bmp_height = _le(content, 23, 4)
    bmp_height = F.when(bmp_height >= 2**31, F.lit(2**32) - bmp_height).otherwise(bmp_height)
    fmt = (
        F.when(is_png, F.lit("PNG")).when(is_bmp, F.lit("BMP")).when(is_gif, F.lit("GIF")).when(is_pdf, F.lit("PDF"))
    )
    # Sizes are 32-bit unsigned in PNG and BMP: kept as LONG, so a corrupt header cannot overflow.
    width = F.when(is_png, _u32be(content, 17)).when(is_bmp, _le(content, 19, 4)).when(is_gif, _le(content, 7, 2))
    height = F.when(is_png, _u32be(content, 21)).when(is_bmp, bmp_height).when(is_gif, _le(content, 9, 2))
    bands = (
        F.when(is_png, png_bands)
        # Uncompressed 16 and 32 bit bitmaps decode to three bands, palettes and 8 bit to one.
        .when(is_bmp, F.when(bpp >= 16, 3).otherwise(1))
        .when(is_gif, F.lit(1))
    ).cast("long")
    return F.struct(fmt.alias("format"), width.alias("width"), height.alias("height"), bands.alias("bands"))


def _facts_one(b):
    """Facts of the formats that the JVM expressions do not read."""
    if b is None or len(b) < 12:
        return None
    b = bytes(b)
    facts = read_facts(lambda place, n: b[place : place + n])
    return facts if facts and facts[0] in ("JPEG", "TIFF", "WEBP") else None


@F.pandas_udf(FACTS)
def header_facts_py(content: pd.Series) -> pd.DataFrame:
    """JPEG (SOF segment), TIFF (first IFD) and WEBP (VP8/VP8L/VP8X) headers; a bad row gives NULLs."""
    rows = [_facts_one(b) for b in content]
    return pd.DataFrame(
        [r if r else (None, None, None, None) for r in rows], columns=["format", "width", "height", "bands"]
    ).astype({"width": "Int64", "height": "Int64", "bands": "Int64"})


def header_facts(df: DataFrame, content_col: str = "content", head_bytes: int = FIRST_LOOK) -> DataFrame:
    """T-6: ``facts`` struct per row, and ``decodable``: a known format with sizes above 0.

    Fixed-header formats are decoded in the JVM. The Python reader gets the first ``head_bytes``
    of rows the JVM could not tell. JPEG and TIFF headers may lie anywhere, so a row of these that
    the first look could not decode is read whole in a second one: no format depends on a cut.
    """
    whole = F.col(content_col)
    head = F.substring(whole, 1, head_bytes)
    staged = df.withColumn("_jvm_facts", header_facts_jvm(head))
    known = F.col("_jvm_facts.format").isNotNull()
    staged = staged.withColumn("_first", header_facts_py(F.when(~known, head)))
    magic = F.hex(F.substring(whole, 1, 4))
    anywhere = magic.startswith("FFD8FF") | magic.isin("49492A00", "4D4D002A")
    again = ~known & F.col("_first.format").isNull() & anywhere & (F.octet_length(whole) > head_bytes)
    staged = staged.withColumn("_second", header_facts_py(F.when(again, whole)))
    facts = F.when(known, F.col("_jvm_facts")).when(again, F.col("_second")).otherwise(F.col("_first"))
    out = staged.withColumn("facts", facts).drop("_jvm_facts", "_first", "_second")
    sized = (F.col("facts.width") > 0) & (F.col("facts.height") > 0) & (F.col("facts.bands") > 0)
    decodable = F.col("facts.format").isNotNull() & ((F.col("facts.format") == "PDF") | sized)
    return out.withColumn("decodable", F.coalesce(decodable, F.lit(False)))


def fetch_assets(df: DataFrame, fetcher: Callable[[str, float], bytes], url_col: str = "url", key: str = "id",
                 host_slots: int | None = None, timeout_s: float = 30.0, tasks: int | None = None,
                 in_flight: int = FETCHES_IN_FLIGHT) -> DataFrame:
    """Download every URL with an injected ``fetcher(url, timeout_s) -> bytes`` that raises on
    HTTP errors. A failing URL gives an ``error`` row, not a failed task.

    By default the rows are spread by a hash of the URL, so a host that holds a third of all
    URLs is fetched by all tasks alike. ``host_slots`` is an opt-in politeness bound: rows are
    hashed on (host, URL bucket), and one host's URLs go to at most ``host_slots`` tasks,
    which bounds the connections one server sees at the cost of that host's throughput.

    A fetch costs time per URL, not per byte, so the number of tasks is explicit (``tasks``,
    else the larger of the shuffle partitions and the cores) and AQE does not merge the small
    partitions of a URL list into one task. ``in_flight`` downloads of a task wait at the same time (one
    with ``host_slots``, whose bound counts connections).
    """
    spark = df.sparkSession
    n = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    src = df.select(key, url_col)
    if host_slots:
        host = F.coalesce(F.try_parse_url(F.col(url_col), F.lit("HOST")), F.lit(""))
        src = src.repartition(n, host, F.pmod(F.xxhash64(F.col(url_col)), F.lit(host_slots)))
    else:
        src = src.repartition(n, F.xxhash64(F.col(url_col)))
    in_flight = 1 if host_slots else in_flight
    schema = T.StructType(
        [src.schema[key], T.StructField(url_col, T.StringType()), T.StructField("content", T.BinaryType()),
         T.StructField("error", T.StringType())]
    )

    def fetched(url):
        try:
            return fetcher(url, timeout_s), None
        except Exception as e:  # one bad URL gives one error row
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        with ThreadPoolExecutor(in_flight) as pool:
            for pdf in batches:
                # As many URLs at a time as are in flight; bodies are handed on in small pieces, not held
                # for a whole input batch.
                begin, held, found = 0, 0, []
                for at in range(0, len(pdf), in_flight):
                    found += pool.map(fetched, pdf[url_col].iloc[at : at + in_flight])
                    held += sum(len(body) for body, _ in found[at - begin :] if body is not None)
                    end = min(at + in_flight, len(pdf))
                    if held >= FETCH_BYTES or end == len(pdf):
                        part = pdf.iloc[begin:end][[key, url_col]]
                        yield part.assign(content=[body for body, _ in found], error=[error for _, error in found])
                        begin, held, found = end, 0, []

    return src.mapInPandas(run, schema)


def _le_hex(c: Column, n: int) -> Column:
    """``n``-byte little-endian hex text of a non-negative integer column."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(c.cast("long"), 8 * i) % 256), 2, "0") for i in range(n)])


def _be_hex(c: Column, n: int) -> Column:
    return F.lpad(F.hex(c.cast("long")), 2 * n, "0")


def synth_header(fmt: Column, width: Column, height: Column, channels: Column) -> Column:
    """Header bytes of an image with the given facts (for exercising the header readers on
    table-sized inputs). Unknown or NULL formats give bytes no reader recognises."""
    f = F.upper(fmt)
    png_ct = F.when(channels == 1, 0).when(channels == 3, 2).otherwise(6)
    bpp = F.when(channels == 1, 8).when(channels == 3, 24).otherwise(32)
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), _be_hex(width, 4), _be_hex(height, 4), F.lit("08"),
                   _be_hex(png_ct, 1), F.lit("00000000000000"))
    bmp = F.concat(F.lit("424D"), F.lit("00" * 12), F.lit("28000000"), _le_hex(width, 4), _le_hex(height, 4),
                   F.lit("0100"), _le_hex(bpp, 2), F.lit("00" * 24))
    gif = F.concat(F.lit("474946383961"), _le_hex(width, 2), _le_hex(height, 2), F.lit("00" * 8))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), _be_hex(height, 2), _be_hex(width, 2),
                    _be_hex(channels, 1), F.lit("00" * 12))
    tiff = F.concat(F.lit("49492A00080000000300"),
                    F.lit("0001030001000000"), _le_hex(width, 2), F.lit("0000"),
                    F.lit("0101030001000000"), _le_hex(height, 2), F.lit("0000"),
                    F.lit("1501030001000000"), _le_hex(channels, 2), F.lit("0000"), F.lit("00000000"))
    webp = F.concat(F.lit("52494646"), F.lit("00000000"), F.lit("57454250"),
                    F.lit("565038580A000000"), F.when(channels == 4, F.lit("10")).otherwise(F.lit("00")), F.lit("000000"),
                    _le_hex(width - 1, 3), _le_hex(height - 1, 3), F.lit("00" * 8))
    hexed = (
        F.when(f == "PNG", png).when(f == "BMP", bmp).when(f == "GIF", gif).when(f.isin("JPEG", "JPG"), jpeg)
        .when(f == "TIFF", tiff).when(f == "WEBP", webp).otherwise(F.lit("00" * 32))
    )
    return F.unhex(hexed)
