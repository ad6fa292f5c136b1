"""Operators on hand-written rows: one test per rule of the survey's
semantics table (S4, S5, S7, S8, S13-S17) and the E/J operators."""

import datetime as dt

from pyspark.sql import functions as F

from staylens.operators import dedup, integrity, keys, outliers, profile, reports, timeseries
from staylens.plans.encounters import encounter_view
from staylens.plans.normalise import normalise


def d(s):
    return dt.date.fromisoformat(s)


def test_zero_variance_keeps_nothing(spark):
    # Zero variance -> no error, z NULL, no row kept
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r.z_score for r in outliers.zscore(df, "x").collect()] == [None, None]
    assert outliers.remove_outliers(df, "x").count() == 0


def test_outliers_inclusive_threshold_and_nulls(spark):
    vals = [0.0] * 9 + [10.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    # population z of 10 among nine zeros is exactly 3 -> kept (inclusive)
    assert outliers.remove_outliers(df, "x").count() == 10
    assert outliers.remove_outliers(df, "x", null_policy="propagate").count() == 0
    rep = outliers.outlier_report(df, "x").first()
    assert (rep.rows_in, rep.rows_kept, rep.rows_removed) == (11, 10, 1)


def test_outliers_per_group(spark):
    rows = [("a", float(v)) for v in [0] * 9 + [100]] + [("b", 5.0), ("b", 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    kept = outliers.remove_outliers(df, "x", threshold=2.0, group_cols=("g",))
    assert sorted((r.g, r.x) for r in kept.collect()) == [("a", 0.0)] * 9


def test_null_group_key_dropped(spark):
    # (a,1), (null,2) -> one group a = 1.0
    df = spark.createDataFrame([("a", 1.0), (None, 2.0)], "gender string, total_charges double")
    assert [tuple(r) for r in reports.cost_by_group(df).collect()] == [("a", 1.0)]


def test_duplicates_with_nulls(spark):
    # (1,null),(1,null) -> 1 surplus, 2 in group; keep-first keeps row_pos 0
    df = spark.createDataFrame([(1, None, 0), (1, None, 1), (2, "x", 2)], "a int, b string, row_pos long")
    c = dedup.duplicate_count(df).first()
    assert (c.n_rows, c.n_distinct, c.n_duplicates, c.n_in_groups) == (3, 2, 1, 2)
    assert sorted(r.row_pos for r in dedup.duplicate_rows(df).collect()) == [0, 1]
    assert sorted(r.row_pos for r in dedup.drop_duplicates(df).collect()) == [0, 2]
    sub = dedup.drop_duplicates(df.withColumn("c", F.col("row_pos") * 10), subset=["a"])
    assert sorted((r.a, r.c) for r in sub.collect()) == [(1, 0), (2, 20)]


def test_missing_report_and_ranges(spark):
    df = spark.createDataFrame([(1.0, None, d("2024-01-02")), (float("nan"), "x", None)],
                               "a double, b string, t date")
    rep = {r.column_name: (r.missing_count, r.missing_pct) for r in profile.missing_report(df).collect()}
    assert rep == {"a": (1, 50.0), "b": (1, 50.0), "t": (1, 50.0)}
    rng = profile.date_range(df, ["t"]).first()
    assert (rng.earliest, rng.latest) == (d("2024-01-02"), d("2024-01-02"))


def test_unique_values_first_appearance(spark):
    df = spark.createDataFrame([("b", 0), ("a", 1), (None, 2), ("b", 3)], "g string, row_pos long")
    got = sorted(profile.unique_values(df, ["g"]).collect(), key=lambda r: r.first_pos)
    assert [r.value for r in got] == ["b", "a", None]


def test_split_not_null_and_orphans(spark):
    # One of two rows has a NULL key -> 1 loaded, 1 quarantined
    df = spark.createDataFrame([(1, d("2024-01-01")), (2, None)], "id long, admission_date date")
    good, bad = integrity.split_not_null(df, ["admission_date"])
    assert (good.count(), bad.count()) == (1, 1)
    parent = spark.createDataFrame([(1,)], "id long")
    child = spark.createDataFrame([(1,), (3,), (None,)], "id long")
    assert [r.id for r in integrity.orphans(child, parent, "id").collect()] == [3]


def test_last_wins_lookup(spark):
    dim = spark.createDataFrame([("n", 1), ("n", 5), ("m", 2), (None, 9)], "name string, patient_id long")
    got = {r.name: r.patient_id for r in keys.last_wins_lookup(dim, "name", "patient_id").collect()}
    assert got == {"n": 5, "m": 2}


def _clean_rows(spark, rows):
    schema = ("Name string, Gender string, `Blood Type` string, `Medical Condition` string, "
              "`Date of Admission` date, `Discharge Date` date, `Admission Type` string, `Room Number` int, "
              "Doctor string, Hospital string, `Billing Amount` double, `Insurance Provider` string, row_pos long")
    return spark.createDataFrame(rows, schema)


def test_patient_last_wins(spark):
    # Name N with conditions X then Y -> admissions get the Y patient
    clean = _clean_rows(spark, [
        ("N", "F", "A", "X", d("2024-01-01"), d("2024-01-03"), "u", 1, "doc", "h", 10.0, "i", 0),
        ("N", "F", "A", "Y", d("2024-02-01"), d("2024-02-03"), "u", 1, "doc", "h", 20.0, "i", 1),
    ])
    t = normalise(clean)
    pats = {r.medical_condition: r.patient_id for r in t.patients.collect()}
    assert set(r.patient_id for r in t.admissions.collect()) == {pats["Y"]}
    view = encounter_view(t)
    assert set(r.medical_condition for r in view.collect()) == {"Y"}
    exact = encounter_view(normalise(clean, "exact"))
    assert sorted(r.medical_condition for r in exact.collect()) == ["X", "Y"]


def test_bill_last_wins(spark):
    # 2 admissions on one date, 2 bills -> first charge 0, second twice
    clean = _clean_rows(spark, [
        ("A", "F", "A", "X", d("2024-01-01"), d("2024-01-03"), "u", 1, "doc", "h", 10.0, "i", 0),
        ("B", "M", "A", "X", d("2024-01-01"), d("2024-01-05"), "u", 2, "doc", "h", 20.0, "i", 1),
    ])
    view = encounter_view(normalise(clean))
    got = sorted((r.length_of_stay, r.total_charges) for r in view.collect())
    assert got == [(2, 0.0), (4, 10.0), (4, 20.0)]


def test_charge_precision(spark):
    # The charge keeps all its digits
    clean = _clean_rows(spark, [
        ("A", "F", "A", "X", d("2024-01-01"), d("2024-01-03"), "u", 1, "doc", "h", 18856.281305978155, "i", 0)])
    assert encounter_view(normalise(clean)).first().total_charges == 18856.281305978155


def test_crosstab_drops_null_pairs(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "y")], "medical_condition string, admission_type string")
    got = [(r.medical_condition, r.admission_type, r.pct) for r in reports.crosstab_pct(df).collect()]
    assert got == [("a", "x", 100.0)]
    wide = reports.crosstab_pct_wide(df).collect()
    assert [tuple(r) for r in wide] == [("a", 100.0)]


def test_top_k_tie_break(spark):
    # Equal counts at the edge -> lower name kept
    rows = [(f"d{i}", p) for i in range(3) for p in range(3 - (i > 0))] + [("c", 0), ("c", 1)]
    df = spark.createDataFrame(rows, "doctor string, patient_id long")
    got = [(r.doctor, r.n_patients) for r in reports.top_groups(df, k=2).collect()]
    assert got == [("d0", 3), ("c", 2)]


def test_monthly_gap_fill_and_drop_last(spark):
    # Jan 1, Feb 0, Mar 1 (p2 twice), Apr dropped
    df = spark.createDataFrame([(d("2024-01-05"), 1), (d("2024-03-07"), 2), (d("2024-03-08"), 2),
                                (d("2024-04-01"), 3)], "admission_date date, patient_id long")
    got = [(r.month_end, r.k, r.n_patients) for r in timeseries.monthly_counts(df).orderBy("k").collect()]
    assert got == [(d("2024-01-31"), 0, 1), (d("2024-02-29"), 1, 0), (d("2024-03-31"), 2, 1)]


def test_monthly_per_group(spark):
    df = spark.createDataFrame([("a", d("2024-01-05"), 1), ("a", d("2024-03-01"), 1), ("b", d("2024-05-01"), 2),
                                ("b", d("2024-06-01"), 2), (None, d("2024-01-01"), 3)],
                               "g string, admission_date date, patient_id long")
    # every series ends with the whole table's last month (June, dropped): a's March is complete, April and May are 0
    rows = lambda **kw: [(r.g, r.month_end, r.k, r.n_patients) for r in timeseries.monthly_counts(df, group_cols=["g"], **kw).collect()]
    assert rows() == [("a", d("2024-01-31"), 0, 1), ("a", d("2024-02-29"), 1, 0), ("a", d("2024-03-31"), 2, 1),
                      ("a", d("2024-04-30"), 3, 0), ("a", d("2024-05-31"), 4, 0), ("b", d("2024-05-31"), 0, 1)]
    assert [r[:1] + r[2:] for r in rows(per_series_end=True)] == [("a", 0, 1), ("a", 1, 0), ("b", 0, 1)]
    assert [r[:1] + r[2:] for r in rows(end=d("2024-02-11"), drop_last=False)] == [("a", 0, 1), ("a", 1, 0)]


def test_one_month_fit_and_forecast(spark):
    # y = [5] -> slope 0, intercept 5; J5 month ends; k = 0 factor 1
    hist = spark.createDataFrame([(d("2024-01-31"), 0, 5)], "month_end date, k int, n_patients long")
    fit = timeseries.linear_fit(hist).first()
    assert (fit.n_months, fit.slope, fit.intercept, fit.std_y) == (1, 0.0, 5.0, 0.0)
    fc = timeseries.forecast(timeseries.linear_fit(hist)).orderBy("k").collect()
    assert [r.month_end for r in fc[:3]] == [d("2024-02-29"), d("2024-03-31"), d("2024-04-30")]
    assert fc[0].growth == 1.0 and fc[0].value == fc[0].base == 5.0
    assert all(abs((r.upper - r.value) - (r.value - r.lower)) < 1e-9 for r in fc)
    assert len(fc) == 120


def test_empty_history_gives_no_fit(spark):
    hist = spark.createDataFrame([], "month_end date, k int, n_patients long")
    assert timeseries.linear_fit(hist).count() == 0


def test_forecast_summary_matches_numpy(spark):
    import numpy as np
    y = np.array([3.0, 5.0, 4.0, 8.0, 9.0])
    hist = spark.createDataFrame([(d("2024-01-31"), i, int(v)) for i, v in enumerate(y)],
                                 "month_end date, k int, n_patients long")
    s = timeseries.forecast_summary(timeseries.linear_fit(hist)).first()
    slope, intercept = np.polyfit(np.arange(5.0), y, 1)
    pred = (intercept + slope * np.arange(5, 125)) * (1 + 0.04 / 12) ** np.arange(120)
    assert abs(s.current_avg - y.mean()) < 1e-9
    assert abs(s.predicted_1yr - pred[:12].mean()) < 1e-6
    assert abs(s.predicted_5yr - pred[48:60].mean()) < 1e-6
    assert abs(s.predicted_10yr - pred[-12:].mean()) < 1e-6
    assert abs(s.growth_1yr - (pred[:12].mean() - y.mean()) / y.mean() * 100) < 1e-6


def test_bounded_broadcast(spark):
    adm = spark.createDataFrame([(d("2024-01-01"), 1), (d("2024-01-10"), 2), (None, 3)],
                                "admission_date date, admission_id long")
    assert keys.day_span(adm, "admission_date") == 10
    assert keys.day_span(adm.where("false"), "admission_date") == 0
    lookup = keys.last_wins_lookup(adm, "admission_date", "admission_id")
    bills = spark.createDataFrame([(d("2024-01-10"), 5.0)], "admission_date date, total_charges double")
    hinted = bills.join(keys.bounded_broadcast(lookup, 10), "admission_date", "left")
    plain = bills.join(keys.bounded_broadcast(lookup, 10, max_rows=5), "admission_date", "left")
    assert "broadcast" in hinted._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "strategy=broadcast" not in plain._jdf.queryExecution().optimizedPlan().toString().lower()
    assert hinted.first().admission_id == 2


def test_view_for_sql_reports(spark):
    from conftest import SF001
    from staylens import registry
    from staylens.plans.encounters import register_view
    t = registry._tables(spark, SF001)
    view = register_view(t, prefix="t_")
    assert view.count() == spark.sql("SELECT count(*) FROM t_encounters").first()[0] == 1815


def test_bills_are_not_shuffled_for_the_view(spark):
    from conftest import SF001
    from staylens import registry
    from staylens.plans.normalise import Tables
    t = registry._tables(spark, SF001)
    assert t.billed_bound
    unbound = Tables(t.patients, t.admissions, t.billing)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(encounter_view(t)) == key(encounter_view(unbound))
    plan = encounter_view(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_crosstab_percentages_are_of_all_pairs(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("a", "z"), ("b", "x")], "medical_condition string, admission_type string")
    wide = {r["medical_condition"]: r.asDict() for r in reports.crosstab_pct_wide(df, values=["x", "y"]).collect()}
    assert wide["a"] == {"medical_condition": "a", "x": 25.0, "y": 25.0} and wide["b"]["x"] == 100.0


def test_reports_come_in_key_order(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("c", 3.0)], "gender string, total_charges double")
    assert [r.gender for r in reports.cost_by_group(df).collect()] == ["a", "b", "c"]


def test_fail_on_null_keys_and_exact_orphans(spark):
    import pytest
    from staylens.operators.integrity import orphan_report, split_not_null
    df = spark.createDataFrame([(1, "a"), (None, "b")], "k long, v string")
    with pytest.raises(ValueError):
        split_not_null(df, ["k"], on_bad="fail")
    assert split_not_null(df, ["v"], on_bad="fail")[0].count() == 2
    parent = spark.createDataFrame([(1,), (2,)], "k long")
    child = spark.createDataFrame([(1,), (3,), (None,), (3,)], "k long")
    assert tuple(orphan_report([("r", child, parent, "k")]).first()) == ("r", 4, 2)

def test_profiles_and_kpis_per_group(spark):
    df = spark.createDataFrame([("a", 1.0, d("2024-01-02"), 1, 3), ("a", None, d("2024-01-05"), 2, 5),
                                ("b", 2.0, None, 3, 7)],
                               "g string, x double, t date, patient_id long, length_of_stay int")
    miss = {(r.g, r.column_name): (r.missing_count, r.missing_pct)
            for r in profile.missing_report(df, ["x", "t"], group_cols=["g"]).collect()}
    assert miss == {("a", "x"): (1, 50.0), ("a", "t"): (0, 0.0), ("b", "x"): (0, 0.0), ("b", "t"): (1, 100.0)}
    rng = {r.g: (r.earliest, r.latest) for r in profile.date_range(df, ["t"], group_cols=["g"]).collect()}
    assert rng == {"a": (d("2024-01-02"), d("2024-01-05")), "b": (None, None)}
    k = {r.g: (r.total_patients, r.avg_stay, r.avg_cost)
         for r in reports.kpis(df.withColumnRenamed("x", "total_charges"), group_cols=["g"], labels=False).collect()}
    assert k == {"a": (2, 4.0, 1.0), "b": (1, 7.0, 2.0)}


def test_equal_bills_on_one_date_merge(spark):
    # Billing is distinct on (date, charge, insurer): two patients' equal
    # bills on one date become one bill (last-wins); exact keying keeps both
    clean = _clean_rows(spark, [
        ("A", "F", "A", "X", d("2024-01-01"), d("2024-01-03"), "u", 1, "doc", "h", 50.0, "i", 0),
        ("B", "M", "A", "X", d("2024-01-01"), d("2024-01-04"), "u", 2, "doc", "h", 50.0, "i", 1),
    ])
    assert normalise(clean).billing.count() == 1
    assert normalise(clean, "exact").billing.count() == 2


def test_growth_arithmetic_in_doubles(spark):
    # Rates summed left to right in floats, /12, compound power in doubles
    from staylens.schemas import GROWTH_FACTORS, monthly_growth_rate
    total = 0.0
    for _, r in GROWTH_FACTORS:
        total += r
    assert monthly_growth_rate() == total / 12
    hist = spark.createDataFrame([(d("2024-01-31"), 0, 5), (d("2024-02-29"), 1, 5)],
                                 "month_end date, k int, n_patients long")
    fc = {r.k: r.growth for r in timeseries.forecast(timeseries.linear_fit(hist)).collect()}
    for k in (1, 12, 119):
        assert abs(fc[k] - (1 + total / 12) ** k) <= 4e-16 * fc[k]
    assert dict(timeseries.forecast(timeseries.linear_fit(hist)).dtypes)["growth"] == "double"


def test_keep_null_groups(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 3.0)], "gender string, total_charges double")
    got = {r.gender: r.avg_cost for r in reports.cost_by_group(df, keep_null_groups=True).collect()}
    assert got == {"a": 1.0, None: 3.0}
