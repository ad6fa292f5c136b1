"""Invariants of the chain and property tests."""

import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF001
from staylens import registry
from staylens.functions.text import title_case
from staylens.operators import dedup, outliers, reports
from staylens.plans.cleaning import cleaning_stages


@pytest.fixture(scope="module")
def stages(spark):
    return cleaning_stages(registry._raw(spark, SF001))


def test_dedup_idempotent(stages):
    once = dedup.drop_duplicates(stages.raw)
    twice = dedup.drop_duplicates(once)
    assert once.count() == twice.count()
    assert once.exceptAll(twice).count() == 0


def test_row_accounting(stages):
    # |raw| = |clean| + surplus duplicates + outliers removed
    dup = dedup.duplicate_count(stages.raw).first().n_duplicates
    removed = outliers.outlier_report(stages.dated, "Billing Amount").first().rows_removed
    assert stages.raw.count() == stages.clean.count() + dup + removed


def test_crosstab_rows_sum_to_100(spark):
    view = registry._view(spark, SF001)
    sums = reports.crosstab_pct(view).groupBy("medical_condition").agg(F.sum("pct").alias("s")).collect()
    assert sums and all(abs(r.s - 100.0) < 1e-9 for r in sums)
    wide = reports.crosstab_pct_wide(view)
    cols = [c for c in wide.columns if c != "medical_condition"]
    for r in wide.collect():
        assert abs(sum(r[c] for c in cols) - 100.0) < 1e-9


def test_view_rows_are_bills_plus_unbilled_admissions(spark):
    t = registry._tables(spark, SF001)
    adm = t.admissions.where(F.col("discharge_date").isNotNull())
    bills = t.billing.groupBy("admission_id").count()
    matched = adm.join(bills, "admission_id").agg(F.sum("count")).first()[0]
    unbilled = adm.join(bills, "admission_id", "left_anti").count()
    assert registry._view(spark, SF001).count() == matched + unbilled


def test_keys_unique(spark):
    t = registry._tables(spark, SF001)
    for df, key in ((t.patients, "patient_id"), (t.admissions, "admission_id"), (t.billing, "billing_id")):
        assert df.count() == df.select(key).distinct().count()


ALPHABET = string.ascii_letters + string.digits + " '-.,/" + "éüÉÜàç"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=24), min_size=1, max_size=40))
def test_title_case_matches_python(spark, words):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    got = {r.i: r.t for r in df.select("i", title_case("w").alias("t")).collect()}
    assert [got[i] for i in range(len(words))] == [w.title() for w in words]
