"""Lookups by key: few keys skip row groups, many are joined, and both give the same rows."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import lookup


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('lookup')}/blocks"
    rows = spark.range(0, 60_000, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("block_hash"), F.col("id").alias("height"), F.sha2((-F.col("id")).cast("string"), 256).alias("other"))
    lookup.write_sorted(rows, path, "block_hash", rows_a_file=20_000, group_bytes=256 << 10)
    return path


def asked(spark, heights):
    return spark.createDataFrame([(h,) for h in heights], "h long").select(F.sha2(F.col("h").cast("string"), 256).alias("block_hash"))


def scanned(df):
    """Rows that came out of the scan, by its own count."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        plan = plan.executedPlan()
    todo, found = [plan], None
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("Scan parquet"):
            found = node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_few_keys_skip_row_groups(spark, table):
    """Keys that are there and keys that aren't, in the middle of every file's range."""
    df = lookup.rows_of(spark, table, asked(spark, [5, 40_000, 5, 59_999, 70_000, 80_000]), "block_hash")
    assert sorted(r.height for r in df.collect()) == [5, 40_000, 59_999]
    plan = df._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[In\(block_hash", plan)
    assert scanned(df) < 60_000 / 4
    none = lookup.rows_of(spark, table, asked(spark, range(100_000, 100_005)), "block_hash")
    assert none.count() == 0 and scanned(none) == 0  # Bloom filters know


def test_many_keys_and_none(spark, table):
    heights = list(range(0, 60_000, 50))
    many = lookup.rows_of(spark, table, asked(spark, heights + heights), "block_hash")
    assert sorted(r.height for r in many.collect()) == heights
    some = lookup.rows_of(spark, table, asked(spark, heights[:37]), "block_hash")
    assert sorted(r.height for r in some.collect()) == heights[:37]
    assert lookup.rows_of(spark, table, asked(spark, [1]).where("false"), "block_hash").count() == 0
    assert lookup.rows_of(spark, table, asked(spark, [1]).select(F.lit(None).cast("string").alias("block_hash")), "block_hash").count() == 0


def test_headers_alone_write_no_outputs(spark):
    """A query of headers or events derives and writes only the base tables that it reads."""
    from ledgerloom.plans import catalog, catalog_pages  # noqa: F401
    from ledgerloom.sources.ledger import Ledger

    made = Ledger(spark, "/root/testdata/sf0.001", stored=("tx", "block", "out", "inp"))
    assert catalog.OPERATORS["contiguity_check"](made).first().complete and set(made.views) == {"tx", "block"}
    made = Ledger(spark, "/root/testdata/sf0.001", stored=("tx", "block", "out", "inp"))
    assert catalog.OPERATORS["latency_alerts"](made).count() >= 0 and not made.views
    assert made.inp.count() > 0 and all(hasattr(made.views[name], "_scratch_folder") for name in ("tx", "out", "inp"))
