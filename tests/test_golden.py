"""Golden numbers of the derived raw table (FIXTURES.md section 2)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF01
from staylens import registry
from staylens.operators import dedup, reports, timeseries
from staylens.plans.cleaning import cleaning_stages


def approx(x, digits=4):
    return round(x, digits)


@pytest.fixture(scope="module")
def small(spark):
    return cleaning_stages(registry._raw(spark, SF001)), registry._view(spark, SF001), registry._view(spark, SF001, "exact")


def test_sf0001_cleaning(small):
    st, _, _ = small
    c = dedup.duplicate_count(st.raw).first()
    assert (c.n_rows, c.n_distinct) == (1515, 1500)
    assert st.raw.where(F.col("`Blood Type`").isNull()).count() == 25
    m = st.dedup.agg(F.avg("`Billing Amount`").alias("m"), F.stddev_pop("`Billing Amount`").alias("s")).first()
    assert (approx(m.m), approx(m.s)) == (257219.4329, 246573.1477)
    assert st.clean.count() == 1497


def test_sf0001_tables_and_view(spark, small):
    _, view, exact = small
    t = registry._tables(spark, SF001)
    assert (t.patients.count(), t.patients.select("name").distinct().count()) == (200, 150)
    assert (t.admissions.count(), t.admissions.select("admission_date").distinct().count()) == (1453, 1068)
    assert t.billing.count() == 1453
    v = view.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("p"),
                 F.avg("length_of_stay").alias("s"), F.avg("total_charges").alias("c"),
                 F.count_if(F.col("total_charges") == 0).alias("z")).first()
    assert (v.n, v.p, approx(v.s, 6), approx(v.c), v.z) == (1815, 150, 15.307989, 196933.2922, 383)
    x = exact.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("p"),
                  F.avg("length_of_stay").alias("s"), F.avg("total_charges").alias("c")).first()
    assert (x.n, x.p, approx(x.s, 6), approx(x.c)) == (1437, 199, 15.429367, 249454.3718)


def test_sf0001_reports(small):
    _, view, _ = small
    g = {r.gender: r.avg_cost for r in reports.cost_by_group(view).collect()}
    assert g == {"Female": 203883.30, "Male": 189804.88}
    s = [(r.medical_condition, approx(r.avg_los, 6), r.n_patients) for r in reports.stay_by_group(view).collect()]
    assert s == [("AUTOMOBILE", 14.592742, 20), ("OTHER", 14.634304, 23), ("BUILDING", 14.760479, 28),
                 ("FURNITURE", 15.469388, 30), ("MACHINERY", 15.471698, 27), ("HOUSEHOLD", 17.060837, 22)]
    h = timeseries.monthly_counts(view)
    fit = timeseries.linear_fit(h).first()
    assert (fit.n_months, approx(fit.mean_y), approx(fit.slope, 8), approx(fit.intercept, 8), approx(fit.std_y, 8)) == \
        (79, 17.1139, -0.01876826, 17.84588608, 3.79535806)
    fc = timeseries.forecast(timeseries.linear_fit(h))
    assert approx(fc.agg(F.avg("value")).first()[0], 3) == 18.617
    s = timeseries.forecast_summary(timeseries.linear_fit(h)).first()
    assert (approx(s.predicted_1yr), approx(s.predicted_5yr), approx(s.predicted_10yr)) == (16.5606, 18.3524, 20.7652)


def test_sf001_view_and_forecast(spark):
    view = registry._view(spark, SF01)
    v = view.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("patient_id").alias("p"),
                 F.avg("length_of_stay").alias("s"), F.avg("total_charges").alias("c"),
                 F.count_if(F.col("total_charges") == 0).alias("z")).first()
    assert (v.n, v.p, approx(v.s, 6), approx(v.c), v.z) == (26367, 1500, 15.608602, 136658.2381, 12010)
    top = [(r.doctor, r.n_patients) for r in reports.top_groups(view).collect()][:3]
    assert top == [("Supplier#000000030", 143), ("Supplier#000000024", 141), ("Supplier#000000034", 141)]
    pct = {r.admission_type: approx(r.pct, 6) for r in reports.crosstab_pct(view).collect()
           if r.medical_condition == "AUTOMOBILE"}
    assert (pct["1-URGENT"], pct["2-HIGH"]) == (20.182841, 21.331458)
    fit = timeseries.linear_fit(timeseries.monthly_counts(view))
    f = fit.first()
    assert (f.n_months, approx(f.mean_y, 3), approx(f.slope, 8), approx(f.intercept, 8), approx(f.std_y, 8)) == \
        (79, 170.962, 0.06127069, 168.57246835, 13.09018672)
    s = timeseries.forecast_summary(fit).first()
    mean_all = timeseries.forecast(fit).agg(F.avg("value")).first()[0]
    assert (approx(mean_all), approx(s.predicted_1yr), approx(s.predicted_5yr), approx(s.predicted_10yr)) == \
        (217.5646, 176.9734, 211.1393, 263.1641)


def test_sf001_forecast_cards(spark):
    fit = timeseries.linear_fit(timeseries.monthly_counts(registry._view(spark, SF01)))
    s = timeseries.forecast_summary(fit, labels=True).first()
    assert s.current_label == "171 patients"
    assert (s.predicted_1yr_label, s.growth_1yr_label) == ("177 patients", "+3.5%")
    assert s.predicted_10yr_label == "263 patients"


def test_fail_on_null_keys(spark):
    from staylens.plans.normalise import normalise
    with pytest.raises(ValueError, match="admissions"):
        normalise(registry._clean(spark, SF001), on_bad="fail")
