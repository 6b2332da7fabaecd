"""Physical plans: what is read, shuffled and broadcast."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import depsieve as ds
from depsieve.session import materialize, shared_folder


def final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def stored(spark, make_files, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "files")
    rows = [(f"p{i % 3}", "1", f"f{i}.js", f"fs.rm(a); exec(b); fetch(c); // {i}") for i in range(60)]
    make_files(*rows).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("roll_up", [ds.network_alerts, ds.filesystem_alerts, ds.shell_alerts, ds.obfuscation_alerts])
def test_contents_are_read_once_and_never_shuffled(spark, stored, roll_up):
    # Without adaptive execution the reuse is visible in the plan; with it, equal
    # exchanges become one stage by the same rule.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = roll_up(stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(re.findall(r"FileScan parquet", plan)) == 1
    assert "ReusedExchange" in plan
    for exchange in re.findall(r"Exchange .*", plan):
        assert "content" not in exchange


def test_only_needed_columns_are_read(stored):
    plan = final_plan(ds.filesystem_hits(stored))
    assert "ReadSchema: struct<package:string,version:string,path:string,content:string>" in plan
    assert "Exchange" not in plan
    paths = final_plan(ds.source_files(stored).select("path"))
    assert "ReadSchema: struct<path:string>" in paths


def test_shell_ranks_are_cut_before_the_shuffle(stored):
    plan = ds.shell_alerts(stored)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and ", Partial" in plan


def test_lock_entries_do_not_shuffle(spark):
    locks = spark.createDataFrame([("p", "p/yarn.lock", "yarn.lock", "")], "project STRING, path STRING, file_name STRING, content STRING")
    assert "Exchange" not in final_plan(ds.lock_entries(locks))


def test_large_lists_do_not_use_nested_loops(spark):
    names = spark.range(1100).selectExpr("concat('name-', id) as package", "cast(id as int) as rank")
    plan = ds.typosquat_pairs(names, names)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stored_tables_hand_python_small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    size = F.pandas_udf(lambda texts: pd.Series([len(texts)] * len(texts)), "long")
    rows = spark.range(0, 20_000, 1, 2).select(F.repeat(F.lit("x"), F.lit(100)).alias("text"))
    sizes = materialize(rows.select(size("text").alias("rows")), "batches")
    assert sizes.agg(F.max("rows")).first()[0] <= 500
    wide = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), F.lit(1 << 20)).alias("text"))
    sizes = materialize(wide.select(size("text").alias("rows")), "batches")
    assert sizes.agg(F.max("rows")).first()[0] <= 16
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
