"""The URL route as a stream (I10): two sinks, restart, replay of a batch."""

import glob
import os
import tempfile

from folio import testing as SI
from folio.streaming import inference_stream as ST
from test_assets import tiny_png

PNG = tiny_png(4, 3)
FETCHED = tempfile.mkdtemp(prefix="fetched-")


def _fetch(url, timeout):
    open(os.path.join(FETCHED, f"{url.rsplit('/', 1)[1]}-{len(os.listdir(FETCHED))}-{os.getpid()}"), "w").close()
    if "gone" in url:
        raise IOError("HTTP 404")
    return b"text" if "text" in url else PNG


def _start(spark, base):
    q = ST.start_url_stream(spark, f"{base}/in", "id long, url string", f"{base}/out", f"{base}/checkpoint", _fetch,
                            SI.ImageSizeBackend, max_files_per_trigger=1)
    q.awaitTermination()
    results, rejects = ST.read_url_sinks(spark, f"{base}/out", spark.createDataFrame([], "id long").schema["id"])
    return (sorted((r.id, r.text, r.status) for r in results.collect()),
            sorted((r.id, r.status, r.error_class) for r in rejects.collect()))


def test_results_and_rejects_restart_and_replay(spark):
    base = tempfile.mkdtemp(prefix="urls-")
    add = lambda rows: spark.createDataFrame(rows, "id long, url string").coalesce(1).write.mode("append").parquet(f"{base}/in")
    add([(1, "http://h/a.png"), (2, "http://h/gone.png")])
    first = _start(spark, base)
    assert first == ([(1, "image 4x3", 200)], [(2, 422, "download_failed")])
    assert _start(spark, base) == first  # nothing new: a restart adds no row
    add([(3, "http://h/text.png"), (4, "http://h/b.png")])
    second = _start(spark, base)
    assert second == ([(1, "image 4x3", 200), (4, "image 4x3", 200)], [(2, 422, "download_failed"), (3, 400, "invalid_image")])
    # A crash after the sinks were written and before the batch was committed: the batch runs again.
    last = max(glob.glob(f"{base}/checkpoint/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    for name in (last, os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")):
        if os.path.exists(name):
            os.remove(name)
    assert _start(spark, base) == second
    # A crash between the outcome and the sinks: the outcome is taken as it is, nothing is fetched again.
    batch = spark.createDataFrame([(9, "http://h/c.png")], "id long, url string")
    write = ST.url_batch_writer(f"{base}/other", _fetch, SI.ImageSizeBackend)
    ST.ocr_urls(batch, _fetch, SI.ImageSizeBackend).write.parquet(f"{base}/other/outcome/batch=0")
    before = len(os.listdir(FETCHED))
    write(batch, 0)
    assert len(os.listdir(FETCHED)) == before
    assert spark.read.parquet(f"{base}/other/results").count() == 1 and not os.path.exists(f"{base}/other/outcome/batch=0")
    none = ST.read_url_sinks(spark, f"{base}/nowhere", batch.schema["id"])
    assert [t.count() for t in none] == [0, 0]
