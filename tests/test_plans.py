"""Physical-plan properties the library relies on at scale."""

import json
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF001
from staylens import registry
from staylens.operators import outliers
from staylens.registry import QUERIES


def _plans(df):
    qe = df._jdf.queryExecution()
    return qe.optimizedPlan().toString(), qe.executedPlan().toString()


@pytest.fixture(scope="module")
def all_plans(spark):
    return {name: _plans(fn(spark, SF001)) for name, fn in QUERIES.items()}


def test_no_cartesian_products(all_plans):
    for name, (_, phys) in all_plans.items():
        assert "CartesianProduct" not in phys, name
        assert "BroadcastNestedLoopJoin" not in phys, name


def _window_partition_sizes(df):
    nodes = json.loads(df._jdf.queryExecution().optimizedPlan().toJSON())
    return [len(n["partitionSpec"]) for n in nodes if n["class"].endswith("logical.Window")]


def test_window_detector(spark):
    df = spark.range(4).withColumn("g", F.col("id") % 2)
    assert _window_partition_sizes(df.withColumn("r", F.row_number().over(Window.orderBy("id")))) == [0]
    assert _window_partition_sizes(
        df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("id")))) == [1]


def test_no_window_over_one_partition(spark):
    # a Window with an empty PARTITION BY would pull every row into one task
    for name, fn in QUERIES.items():
        assert 0 not in _window_partition_sizes(fn(spark, SF001)), name


def test_global_zscore_is_a_scalar_subquery(spark):
    df = outliers.remove_outliers(registry._raw(spark, SF001), "Billing Amount")
    _, phys = _plans(df)
    assert "Subquery" in phys and "Join" not in phys


def test_reports_read_only_needed_columns(spark):
    _, phys = _plans(QUERIES["kpi_cards"](spark, SF001))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", phys) or re.findall(r"ReadSchema: ([^,\]]*)", phys)
    joined = " ".join(schemas)
    assert "patient_id" in joined and "doctor" not in joined and "admission_type" not in joined


def test_top_k_is_take_ordered(all_plans):
    assert "TakeOrderedAndProject" in all_plans["top_doctors"][1]


def test_view_halves_share_one_exchange(spark):
    from staylens.plans.encounters import encounter_view
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")          # plan as if every table were large
        v = encounter_view(registry._tables(spark, SF001))
        v.collect()
        phys = v._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, val in old.items():
            if val is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, val)
    assert "SortMergeJoin" in phys and "ReusedExchange" in phys
