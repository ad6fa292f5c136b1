"""Readmissions: a patient's stays in order, the days between them, and a
model of who comes back.

A patient's order is found in two steps, so that a patient with a third of
all stays is not one task's work: stays are ordered within (patient, month),
and what crosses a month's border is carried over from the months' first and
last stays, one row per patient and month.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions.dates import stay_days
from staylens.operators.regression import design_of

HORIZON_DAYS = 30


def ordered_stays(stays: DataFrame, entity: str = "patient_id", start: str = "admission_date",
                  end: str = "discharge_date", stay: str = "admission_id") -> DataFrame:
    """Stays with the end of the one before (`previous_end`), the start of the
    one after (`next_start`) and how many came before (`n_before`), in the
    order of start, end and id. Stays without a patient, start or end go."""
    rows = stays.where(F.col(entity).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
    rows = rows.withColumn("_month", F.trunc(F.col(start).cast("date"), "month"))
    order = F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.col(stay).alias("i"))
    months = rows.groupBy(entity, "_month").agg(F.min(order).alias("_first"), F.max(order).alias("_last"), F.count(F.lit(1)).alias("_n"))
    by_month = Window.partitionBy(entity).orderBy("_month")
    months = months.select(entity, "_month", F.lag("_last.e").over(by_month).alias("_before"), F.lead("_first.s").over(by_month).alias("_after"),
                           F.coalesce(F.sum("_n").over(by_month.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy(entity, "_month").orderBy(start, end, stay)
    rows = rows.withColumns({"_e": F.lag(end).over(inside), "_s": F.lead(start).over(inside), "_k": F.row_number().over(inside)})
    return (rows.join(months, [entity, "_month"])
            .withColumns({"previous_end": F.coalesce("_e", "_before"), "next_start": F.coalesce("_s", "_after"),
                          "n_before": F.col("_earlier") + F.col("_k") - 1})
            .drop("_month", "_e", "_s", "_k", "_before", "_after", "_earlier"))


def _within(days: Column, horizon_days: int) -> Column:
    return F.coalesce(days.between(0, horizon_days), F.lit(False))


def readmissions(stays: DataFrame, horizon_days: int = HORIZON_DAYS, entity: str = "patient_id", start: str = "admission_date",
                 end: str = "discharge_date", stay: str = "admission_id") -> DataFrame:
    """Per stay: gap_days (whole days since the patient's previous discharge),
    readmitted (within the horizon of it), days_to_next (admission) and followed
    (that one comes within the horizon). A stay that starts before the previous
    one ends has a negative gap and is no readmission; a first stay's gap and a
    last stay's days_to_next are NULL, and their flags false."""
    rows = ordered_stays(stays, entity, start, end, stay)
    gap, ahead = stay_days(start, "previous_end"), stay_days("next_start", end)
    return rows.withColumns({"gap_days": gap, "readmitted": _within(gap, horizon_days),
                             "days_to_next": ahead, "followed": _within(ahead, horizon_days)}).drop("previous_end", "next_start")


def risk_rows(found: DataFrame, last_day: Column, horizon_days: int = HORIZON_DAYS, start: str = "admission_date",
              end: str = "discharge_date") -> DataFrame:
    """Rows to learn from: a label (followed, 0 or 1) and the features known at
    discharge. Stays that end less than the horizon before `last_day` are left
    out, since what follows them is not in the table yet."""
    known = F.date_add(F.col(end).cast("date"), horizon_days) <= last_day
    return found.where(known).withColumns({
        "label": F.col("followed").cast("double"),
        "stay_days": stay_days(end, start).cast("double"),
        "earlier_stays": F.col("n_before").cast("double"),
        "came_before": (F.col("gap_days").isNotNull()).cast("double"),
        "years_since": F.coalesce(F.greatest(F.col("gap_days"), F.lit(0)) / 365.25, F.lit(0.0))})


RISK_FEATURES = ("stay_days", "earlier_stays", "came_before", "years_since")


def logistic_model(rows: DataFrame, label: str = "label", numeric: Iterable[str] = RISK_FEATURES, categorical: Iterable[str] = ()):
    """(terms, fitted model) of a logistic regression without regularisation,
    columns one-hot encoded with the first level left out. Rows with NULL in a
    used column are left out."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    design = design_of(rows, numeric, categorical)
    used = rows.dropna(subset=[label, *design.columns])
    points = used.select(F.col(label).cast("double").alias("label"), array_to_vector(F.array(*(c for _, c in design.terms()))).alias("features"))
    fit = LogisticRegression(regParam=0.0, maxIter=500, tol=1e-13, standardization=True, family="binomial").fit(points)
    return [name for name, _ in design.terms()], design, fit


def readmission_model(rows: DataFrame, label: str = "label", numeric: Iterable[str] = RISK_FEATURES, categorical: Iterable[str] = ()) -> DataFrame:
    """term, coefficient (log odds), one row per term, `(intercept)` first."""
    names, _, fit = logistic_model(rows, label, numeric, categorical)
    cells = [("(intercept)", float(fit.intercept)), *((n, float(c)) for n, c in zip(names, fit.coefficients))]
    return rows.sparkSession.createDataFrame(cells, "term string, coefficient double")


def readmission_risk(rows: DataFrame, label: str = "label", numeric: Iterable[str] = RISK_FEATURES, categorical: Iterable[str] = (),
                     name: str = "risk") -> DataFrame:
    """`rows` with the model's probability of a readmission, as a column
    expression (NULL where a used column is)."""
    _, design, fit = logistic_model(rows, label, numeric, categorical)
    score = F.lit(float(fit.intercept))
    for (_, c), w in zip(design.terms(), fit.coefficients):
        score = score + c * F.lit(float(w))
    return rows.withColumn(name, 1.0 / (1.0 + F.exp(-score)))
