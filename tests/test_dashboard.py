"""The dashboard composition: every report, for one series and per group."""

from pyspark.sql import functions as F

from conftest import SF001
from staylens import registry
from staylens.plans.dashboard import build_reports

NAMES = {"kpi_cards", "cost_by_gender", "stay_by_condition", "top_doctors", "admission_type_pct",
         "monthly_patients", "monthly_fit", "forecast", "forecast_summary", "forecast_series"}


def test_build_reports(spark):
    out = build_reports(registry._view(spark, SF001))
    assert set(out) == NAMES
    k = out["kpi_cards"].first()
    assert (k.total_patients, k.total_patients_label, k.avg_stay_label) == (150, "150", "15.3 days")
    assert out["forecast"].count() == 120
    series = out["forecast_series"].groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in series} == {"history": 79, "forecast": 120}
    assert out["stay_by_condition"].columns == ["medical_condition", "avg_los", "n_patients", "n_patients_label"]


def test_build_reports_per_group(spark):
    view = registry._view(spark, SF001)
    out = build_reports(view, group_cols=["medical_condition"], top_k=3)
    n_groups = view.select("medical_condition").distinct().count()
    assert out["forecast"].count() == 120 * n_groups
    assert out["forecast_summary"].count() == n_groups
    fit = out["monthly_fit"].collect()
    assert len(fit) == n_groups and all(r.n_months > 1 for r in fit)
    hist = out["monthly_patients"].groupBy("medical_condition").agg(F.max("k").alias("m"), F.count("*").alias("n"))
    assert all(r.n == r.m + 1 for r in hist.collect())      # gap-free spine per series
    assert out["top_doctors"].count() == 3


def test_encounters_from_raw_staged_equals_lazy(spark, scratch_dir):
    from staylens.plans.dashboard import encounters_from_raw
    from staylens.plans.stages import stage_to
    raw = registry._raw(spark, SF001)
    staged = encounters_from_raw(raw, stage=stage_to(scratch_dir))
    lazy = encounters_from_raw(raw)
    assert staged.count() == lazy.count() == 1815
    assert staged.exceptAll(lazy).count() == 0
    import os
    assert {"dated", "clean", "patients", "admissions", "billing"} <= set(os.listdir(scratch_dir))
