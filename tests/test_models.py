"""Readmissions, regression and correlation against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from staylens import registry
from staylens.operators import readmission as M
from staylens.operators.correlation import correlations
from staylens.operators.regression import design_of, linear_regression


def d(day):
    return dt.date(2020, 1, 1) + dt.timedelta(day)


def stays_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        patient = 0 if i % 3 == 0 else rng.randrange(1, 25)       # a third of all stays on one patient
        start = rng.randrange(0, 700)
        rows.append((patient, i, d(start), d(start + rng.randrange(-3, 40))))
    return rows


def neighbours(rows, horizon):
    by = {}
    for p, i, a, e in rows:
        by.setdefault(p, []).append((a, e, i))
    out = {}
    for p, s in by.items():
        s.sort()
        for k, (a, e, i) in enumerate(s):
            gap = (a - s[k - 1][1]).days if k else None
            ahead = (s[k + 1][0] - e).days if k + 1 < len(s) else None
            out[i] = (gap, gap is not None and 0 <= gap <= horizon, ahead, ahead is not None and 0 <= ahead <= horizon, k)
    return out


@pytest.mark.parametrize("horizon", [0, 30])
def test_readmissions_against_a_plain_loop(spark, horizon):
    rows = stays_of(horizon, 900)
    frame = spark.createDataFrame(rows, "patient_id int, admission_id int, admission_date date, discharge_date date")
    got = {r["admission_id"]: tuple(r[c] for c in ("gap_days", "readmitted", "days_to_next", "followed", "n_before"))
           for r in M.readmissions(frame, horizon).collect()}
    assert got == neighbours(rows, horizon)


def test_a_hot_patient_is_ordered_month_by_month(spark):
    frame = spark.createDataFrame(stays_of(1, 30), "patient_id int, admission_id int, admission_date date, discharge_date date")
    plan = M.readmissions(frame)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_month" in w for w in windows)


def test_stays_without_patient_or_dates_go(spark):
    rows = [(None, 1, d(0), d(1)), (1, 2, None, d(1)), (1, 3, d(0), None), (1, 4, d(5), d(6))]
    frame = spark.createDataFrame(rows, "patient_id int, admission_id int, admission_date date, discharge_date date")
    assert [(r["admission_id"], r["gap_days"], r["n_before"]) for r in M.readmissions(frame).collect()] == [(4, None, 0)]
    assert M.readmissions(frame.limit(0)).count() == 0


def newton(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p))
    return w


def test_readmission_model_equals_newton(spark):
    r = registry._readmissions(spark, SF001)
    rows = M.risk_rows(r, r.agg(F.max("admission_date")).scalar()).cache()
    got = {t["term"]: t["coefficient"] for t in M.readmission_model(rows, categorical=("admission_type",)).collect()}
    local = rows.select("label", "admission_type", *M.RISK_FEATURES).collect()
    levels = sorted({x["admission_type"] for x in local})[1:]
    x = np.array([[float(q["admission_type"] == v) for v in levels] + [q[c] for c in M.RISK_FEATURES] for q in local])
    want = newton(x, np.array([q["label"] for q in local]))
    names = ["(intercept)", *(f"admission_type={v}" for v in levels), *M.RISK_FEATURES]
    assert list(got) == names and np.allclose([got[n] for n in names], want, atol=1e-6)
    risk = M.readmission_risk(rows, categorical=("admission_type",)).select("label", "risk").collect()
    assert abs(sum(q["risk"] - q["label"] for q in risk)) < 1e-3 and all(0 < q["risk"] < 1 for q in risk)
    rows.unpersist()


def test_stays_too_recent_to_be_followed_are_not_learnt_from(spark):
    frame = spark.createDataFrame([(1, 1, d(0), d(1)), (1, 2, d(20), d(21)), (1, 3, d(40), d(45))],
                                  "patient_id int, admission_id int, admission_date date, discharge_date date")
    rows = M.risk_rows(M.readmissions(frame), F.lit(d(40))).collect()
    assert [(r["admission_id"], r["label"], r["came_before"]) for r in rows] == [(1, 1.0, 0.0)]


def test_least_squares_equals_numpy(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice(["x", "y", None]) if i % 9 == 0 else rng.choice("xy"), rng.gauss(50, 3), rng.gauss(1e6, 1e5) if i % 11 else None) for i in range(600)]
    rows = [(*r, 3 + 2 * (r[0] == "b") - (r[1] == "y") + 0.5 * r[2] + 1e-5 * (r[3] or 0) + rng.gauss(0, 1)) for r in rows]
    frame = spark.createDataFrame(rows, "g string, h string, u double, v double, y double")
    got = linear_regression(frame, "y", ("u", "v"), ("g", "h")).collect()
    used = [r for r in rows if None not in r]
    x = np.array([[1, r[0] == "b", r[0] == "c", r[1] == "y", r[2], r[3]] for r in used], float)
    y = np.array([r[4] for r in used])
    want, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert [r["term"] for r in got] == ["(intercept)", "g=b", "g=c", "h=y", "u", "v"]
    assert np.allclose([r["coefficient"] for r in got], want, rtol=1e-6, atol=1e-9)
    assert got[0]["n_rows"] == len(used)
    assert abs(got[0]["r_squared"] - (1 - ((y - x @ want) ** 2).sum() / ((y - y.mean()) ** 2).sum())) < 1e-9


def test_collinear_constant_and_empty(spark):
    frame = spark.createDataFrame([(float(i), 2.0 * i + 1, 7.0, "k", 3.0 * i) for i in range(20)], "a double, b double, c double, g string, y double")
    got = {r["term"]: r["coefficient"] for r in linear_regression(frame, "y", ("a", "b", "c"), ("g",)).collect()}
    assert got["b"] is None and got["c"] is None and abs(got["a"] - 3) < 1e-9 and abs(got["(intercept)"]) < 1e-9
    flat = linear_regression(frame, "c", ("a",)).collect()
    assert [r["r_squared"] for r in flat] == [None, None] and abs(flat[0]["coefficient"] - 7) < 1e-9 and abs(flat[1]["coefficient"]) < 1e-9
    empty = linear_regression(frame.limit(0), "y", ("a",), ("g",)).collect()
    assert [(r["term"], r["coefficient"], r["n_rows"]) for r in empty] == [("(intercept)", None, 0), ("a", None, 0)]


def test_levels_are_bounded(spark, monkeypatch):
    from staylens.operators import regression
    monkeypatch.setattr(regression, "MAX_LEVELS", 3)
    frame = spark.createDataFrame([(str(i), float(i)) for i in range(5)], "g string, y double")
    with pytest.raises(ValueError, match="more than 3 values"):
        design_of(frame, (), ("g",))


def test_correlations_leave_nulls_out_by_pair(spark):
    rows = [("a", 1.0, 2.0, 5.0), ("a", 2.0, None, 5.0), ("a", 3.0, 5.0, 5.0), ("a", 4.0, float("nan"), None), ("b", 1.0, None, None), (None, 9.0, 9.0, 9.0)]
    frame = spark.createDataFrame(rows, "g string, x double, y double, z double")
    got = {(r["g"], r["column_a"], r["column_b"]): (r["n_rows"], r["covar_pop"], r["corr"]) for r in correlations(frame, ("x", "y", "z"), ("g",)).collect()}
    assert len(got) == 6 and got["a", "x", "y"] == (2, 1.5, 1.0)
    assert got["a", "x", "z"] == (3, 0.0, None) and got["b", "x", "y"] == (0, None, None)
    assert correlations(frame.limit(0), ("x", "y")).collect()[0]["n_rows"] == 0
