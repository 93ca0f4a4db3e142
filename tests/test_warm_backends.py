"""Tasks of equal bytes and models that outlive a task."""

import os
import tempfile
import uuid

from pyspark.sql import functions as F

from folio.operators import inference as I


class Marked(I.BaseBackend):
    """Marks every load and unload with the process it happens in."""

    model_id = "marked"

    def __init__(self, folder):
        super().__init__()
        self.folder = folder

    def _mark(self, what):
        open(os.path.join(self.folder, f"{what}-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

    def _load(self):
        self._mark("load")

    def unload(self):
        self._mark("unload")
        super().unload()

    def _generate(self, x, settings):
        return f"{os.getpid()}:{x}"


def _loads(folder):
    return [n.split("-")[1] for n in os.listdir(folder) if n.startswith("load")]


def test_a_process_loads_once_for_all_its_tasks(spark):
    folder = tempfile.mkdtemp(prefix="warm-")
    df = spark.createDataFrame([(i, f"p{i}") for i in range(240)], "k long, prompt string").repartition(24, "k")
    make = lambda: Marked(folder)
    pids = {r.text.split(":")[0] for r in I.run_batch(df, make, "prompt", ["k"], warm=True).collect()}
    first = _loads(folder)
    assert sorted(first) == sorted(set(first)) and pids <= set(first) and len(first) < 24
    I.run_batch(df, make, "prompt", ["k"], warm=True).collect()  # the next job finds them loaded
    again = _loads(folder)
    assert sorted(again) == sorted(set(again))
    cold = tempfile.mkdtemp(prefix="cold-")
    I.run_batch(df, lambda: Marked(cold), "prompt", ["k"]).collect()
    assert len(_loads(cold)) == 24 and len(os.listdir(cold)) == 48


def test_warm_backends_give_way_and_break_alone():
    folder = tempfile.mkdtemp(prefix="evict-")
    a = I._warm("a", lambda: Marked(folder))
    assert I._warm("a", lambda: Marked(folder)) is a
    b = I._warm("b", lambda: Marked(folder))
    assert not a.is_loaded() and b.is_loaded()
    try:
        with I._Lease(lambda: Marked(folder), "b") as lease:
            assert lease.get() is b
            raise RuntimeError("device lost")
    except RuntimeError:
        pass
    assert not b.is_loaded() and I._warm("b", lambda: Marked(folder)) is not b


def test_task_ranges_follow_the_running_sum():
    assert I.task_ranges([], 10) == ([], 1)
    assert I.task_ranges([4, 4, 4, 4], 8) == ([(0, 1), (0, 1), (1, 1), (1, 1)], 2)
    assert I.task_ranges([1, 35, 1], 10) == ([(0, 1), (0, 4), (3, 1)], 4)  # a large bucket has several tasks


def test_tasks_hold_equal_bytes_whatever_the_layout(spark):
    df = spark.range(4000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), F.when(F.col("id") % 10 == 0, 900).otherwise(10)).alias("t"))
    total = 400 * 900 + 3600 * 10
    for layout in (df.coalesce(1), df.repartition(16)):
        dealt = I.sized_tasks(layout, ["k"], F.length("t"), task_bytes=total // 8)
        sums = [r[0] for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum(F.length("t"))).select("sum(length(t))").collect()]
        assert dealt.columns == ["k", "t"] and dealt.count() == 4000
        assert 8 <= len(sums) <= 9 and max(sums) < 2 * total / 8
    assert I.sized_tasks(df.where("k < 0"), ["k"], F.length("t")).count() == 0
