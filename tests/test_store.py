"""The clustered store: pages by number, bounds, filters and lookups that open few files."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from folio.operators import analytics as A
from folio.sources.store import open_result_store, write_store

N = 4000


@pytest.fixture(scope="module")
def table(spark):
    k = F.col("id")
    ts = F.when(k % 97 != 0, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((k * 7919 % 1000).cast("int")))
    rare = F.when(k == 1234, F.array(F.lit("rare"), F.lit("rare"), F.lit("all"))).when(k % 5 != 0, F.array(F.lit("all")))
    return spark.range(N).select(
        k, F.lit("cin").alias("doc"), F.concat(F.lit("m"), k % 3).alias("model"), F.lit("v1").alias("prompt_version"),
        F.when(k % 3 == 0, F.lit("2030-01-01").cast("timestamp_ntz")).otherwise(ts).alias("timestamp"),  # a third share one time
        F.when(k % 11 == 0, float("nan")).when(k % 13 != 0, (k % 9).cast("double")).alias("correct_fields"),
        F.lit("correct").alias("format_compliance"), rare.alias("tag_list"), F.lit(None).cast("string").alias("tags"),
        F.lit("").alias("correct_fields_reason"), F.lit(None).cast("string").alias("format_compliance_reason"),
        F.lit('{"a":1}').alias("expected"), F.lit("x").alias("generated"))


@pytest.fixture(scope="module")
def store(spark, table):
    path = os.path.join(tempfile.mkdtemp(prefix="store-"), "s")
    write_store(table.repartition(5), path, bounded=["correct_fields"], rows_per_part=500)
    return open_result_store(spark, path, table)


def _files(df):
    """The rows of ``df``, how many rows its scans handed on, and how many files they opened."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    read = opened = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        leaf = leaf.executedPlan() if leaf.nodeName().startswith("AdaptiveSparkPlan") else leaf
        stack = [leaf]
        while stack:
            node = stack.pop()
            if node.nodeName().startswith("Scan parquet"):
                read += node.metrics().apply("numOutputRows").value()
                opened += node.metrics().apply("numFiles").value()
            elif node.nodeName().endswith("QueryStage"):
                stack.append(node.plan())
            kids = node.children()
            stack += [kids.apply(k) for k in range(kids.size())]
    return rows, read, opened


def test_every_page_by_its_number(store, table):
    order = [(r.id) for r in table.orderBy(F.col("timestamp").desc_nulls_last(), "id").select("id").collect()]
    assert store.count() == N
    for size in (25, 333, 1700):
        for number in (0, 1, N // size // 2, N // size):
            assert [r.id for r in store.page(number, size).collect()] == order[number * size : (number + 1) * size]
    assert store.page(10**9).count() == 0
    page = store.page(N // 25 // 2)
    rows, read, opened = _files(page)
    assert len(rows) == 25 and opened <= 2 and read <= 1300  # a page may lie in two folders
    assert page.columns == table.columns


def test_deep_offsets_are_refused(table):
    assert A.table_page(table, 3).count() == 25
    with pytest.raises(ValueError, match="table_page_after"):
        A.table_page(table, 401)


def test_bounds_come_from_the_parts(store, table):
    assert store.score_bounds().collect() == A.score_bounds(table).collect()
    assert store.score_bounds("nothing").first() == (0, 15)
    assert "/rows" not in store.score_bounds()._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("spec", [
    A.FilterSpec(start_date="2025-01-01", end_date="2025-02-01"), A.FilterSpec(end_date="2024-03-05"), A.FilterSpec(tags=("rare",)),
    A.FilterSpec(tags=("rare", "nowhere")), A.FilterSpec(tags=("nowhere",)), A.FilterSpec(models=("m1",), ncorrect_min=8),
    A.FilterSpec(ncorrect_min=0, ncorrect_max=0), A.FilterSpec(ncorrect_min=99), A.FilterSpec()])
def test_filters_keep_the_same_rows(store, table, spec):
    got = store.filter(spec)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in spec.apply(table).collect())
    assert got.columns == table.columns


def test_filters_open_few_folders(store):
    _, read, opened = _files(store.filter(A.FilterSpec(start_date="2025-01-01", end_date="2025-02-01")))
    assert opened <= 2 and read < N / 2
    rows, _, opened = _files(store.filter(A.FilterSpec(tags=("rare",))))
    assert [r.id for r in rows] == [1234] and opened == 1
    assert _files(store.filter(A.FilterSpec(tags=("nowhere",))))[2] == 0
    assert _files(store.filter(A.FilterSpec(ncorrect_min=99)))[2] == 0


def test_tags_are_counted_once_per_row(store):
    assert [r.tag for r in store.facet_tags().collect()] == ["all", "rare"]
    counts = {r.tag: r.n for r in store.tags.groupBy("tag").agg(F.sum("rows").alias("n")).collect()}
    assert counts == {"rare": 1, "all": N - N // 5}


def test_lookups_ask_the_bloom_filters(store):
    one = store.lookup([1234])
    rows, read, _ = _files(one)
    assert [r.id for r in rows] == [1234] and read <= 600  # one row group of eight
    assert _files(store.lookup([N + 1]))[1] == 0
    assert sorted(r.id for r in store.lookup([5, 7, 5]).collect()) == [5, 7]
    assert store.lookup([]).count() == 0 and store.lookup(range(200)).count() == 200
    detail = A.row_detail(store.lookup([5, 7]), [5, 7]).orderBy("id").collect()
    assert [d.header for d in detail] == ["id: 5  |  doc: cin  |  model: m2  |  correct_fields: 5.0",
                                          "id: 7  |  doc: cin  |  model: m1  |  correct_fields: 7.0"]
    assert detail[0].expected_pretty == '{\n  "a": 1\n}'
    assert A.row_detail(store.table(), 5).count() == 1


def test_an_empty_table_is_a_store(spark, table):
    path = os.path.join(tempfile.mkdtemp(prefix="store-"), "s")
    write_store(table.where("id < 0"), path)
    empty = open_result_store(spark, path, table)
    assert empty.count() == 0 and empty.page(0).count() == 0 and empty.score_bounds("x").first() == (0, 15)
    assert empty.filter(A.FilterSpec(tags=("all",))).count() == 0 and empty.lookup([1]).count() == 0
