"""The encounter view: Patients JOIN Admissions LEFT JOIN Billing.

    patient_id, gender, medical_condition, admission_date, discharge_date,
    doctor, admission_type, total_charges (0 when no bill), length_of_stay

Only admissions with both dates are kept, which also makes the patient side
an inner join. The billing side is a left join written as its two halves:

* matched   = admissions INNER JOIN bills       (one row per bill)
* unmatched = admissions without a billed id (charge 0)

Under last-wins keying every bill of a date lands on one admission, so a
busy date makes one admission id very hot on the billing side. AQE can split
a skewed side of an inner join but not the right side of a left join, so
the inner half keeps the hot key splittable; the anti half only needs the
distinct billed ids, which partial aggregation folds before the shuffle.
It is written as an outer join plus an IS NULL filter, not as LEFT ANTI:
Catalyst pushes an anti join below the patient join, which would make the
two halves different plans; this way both halves read one exchange of the
patient-admission rows (ReusedExchange).

Under last-wins keying the number of billed admissions has a proven bound
(the days between the first and the last admission, `Tables.billed_bound`).
When that bound is small, their stays are broadcast to the bills instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.dates import stay_days
from staylens.operators.keys import BROADCAST_MAX_ROWS
from staylens.plans.normalise import Tables
from staylens.schemas import ENCOUNTER_COLUMNS


def encounter_view(tables: Tables) -> DataFrame:
    """See above. Stays between timestamps are elapsed time in whole days."""
    timestamps = isinstance(tables.admissions.schema["admission_date"].dataType, T.TimestampType)
    # admission_id is a NOT NULL key; saying so gives both halves the same
    # filters (and so one shared exchange)
    adm = (tables.admissions
           .where(F.col("admission_date").isNotNull() & F.col("discharge_date").isNotNull()
                  & F.col("admission_id").isNotNull())
           .select("admission_id", "patient_id", "admission_date", "discharge_date", "doctor", "admission_type"))
    stays = tables.patients.select("patient_id", "gender", "medical_condition").join(adm, "patient_id")
    bills = tables.billing.where(F.col("admission_id").isNotNull()).select("admission_id", "total_charges")
    billed = bills.select(F.col("admission_id").alias("_billed")).distinct()
    if tables.billed_bound is not None and tables.billed_bound <= BROADCAST_MAX_ROWS:
        # Last-wins keying bills one admission per day at most: its stays go to
        # the bills, which are then not shuffled, however hot a day is.
        billed = F.broadcast(billed)
        known = stays.join(billed, F.col("admission_id") == F.col("_billed")).drop("_billed")
        matched = bills.join(F.broadcast(known), "admission_id").select(*stays.columns, "total_charges")
    else:
        matched = stays.join(bills, "admission_id")
    # anti join written as outer join + IS NULL: it stays above the patient
    # join, so both halves share the same exchange of `stays`
    unmatched = (stays.join(billed, F.col("admission_id") == F.col("_billed"), "left")
                 .where(F.col("_billed").isNull()).drop("_billed")
                 .withColumn("total_charges", F.lit(None).cast("double")))
    rows = matched.unionByName(unmatched)
    return rows.select(
        "patient_id", "gender", "medical_condition", "admission_date", "discharge_date", "doctor",
        "admission_type",
        F.coalesce(F.col("total_charges").cast("double"), F.lit(0.0)).alias("total_charges"),
        stay_days("discharge_date", "admission_date", timestamps).alias("length_of_stay"),
    ).select(*ENCOUNTER_COLUMNS)


def register_tables(tables: Tables, prefix: str = "") -> list[str]:
    """Temp views `patients`, `admissions`, `billing` (with an optional prefix)."""
    names = []
    for name in ("patients", "admissions", "billing"):
        getattr(tables, name).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def register_view(tables: Tables, prefix: str = "") -> DataFrame:
    """The tables, and the view over them as `encounters`, as temp views for
    reports written in SQL."""
    register_tables(tables, prefix)
    view = encounter_view(tables)
    view.createOrReplaceTempView(prefix + "encounters")
    return view
