"""Clean table -> Patients / Admissions / Billing, with key rules.

Keys are the first-appearance position of each distinct row (unique and in
insertion order, no global sort or single-task numbering).

Keying `"last_wins"` (parity with the source load): patients are distinct
(name, gender, blood type, condition); an admission is attached to the
*last* patient row with its name; a bill is attached to the *last*
admission with its admission date. `"exact"`: every clean row is its own
admission and bill, and the patient is found on all four attributes
(NULL-safe), so no row is re-attached.

Rows that break a NOT NULL key are quarantined, not loaded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.operators.dedup import distinct_first, distinct_first_staged
from staylens.operators.integrity import split_not_null
from staylens.operators.keys import bounded_broadcast, day_span, last_wins_lookup
from staylens.schemas import (ADMISSION_ATTRS, ADMISSION_KEYS, BILLING_ATTRS, BILLING_KEYS, PATIENT_ATTRS,
                              PATIENT_KEYS, RENAME_MAP, ROW_POS)


@dataclass
class Tables:
    patients: DataFrame
    admissions: DataFrame
    billing: DataFrame
    quarantine: dict = field(default_factory=dict)
    unsplit: dict = field(default_factory=dict)  # rows before the NOT NULL split
    billed_bound: int | None = None  # at most so many admissions have a bill (known under last-wins keying)


def _keep(name: str, df: DataFrame) -> DataFrame:
    return df


def rename_columns(clean: DataFrame, mapping: dict = RENAME_MAP) -> DataFrame:
    """Source names -> table names (columns not in the map are kept)."""
    return clean.withColumnsRenamed({k: v for k, v in mapping.items() if k in clean.columns})


def rename_project(clean: DataFrame, mapping: dict = RENAME_MAP) -> DataFrame:
    """Renamed table reduced to the columns the three tables use (+ row_pos)."""
    renamed = rename_columns(clean, mapping)
    keep = list(dict.fromkeys(PATIENT_ATTRS + ADMISSION_ATTRS + BILLING_ATTRS))
    return renamed.select(*keep, ROW_POS)


def normalise(clean: DataFrame, keying: str = "last_wins",
              stage: Callable[[str, DataFrame], DataFrame] = _keep, bound_dates: bool = True,
              on_bad: str = "quarantine", stage_rows: Callable[[str, DataFrame], DataFrame] = _keep) -> Tables:
    """Build the three tables. `stage(name, df)` is applied to each table as
    soon as it is built and the next table is keyed from its result, so a
    caller that writes each table (e.g. `plans.stages.materialised`) reads
    patients back to key admissions and admissions back to key bills,
    instead of recomputing them. `stage_rows(name, df)` is the same for the rows
    before the NOT NULL split: the tables, the quarantine and their counts are
    then filters over one written table, and admissions, which are mostly
    distinct, are told apart by written hashes. `bound_dates` sizes the date lookup by the
    admission date span (one min/max job) and broadcasts it when small.
    `on_bad="fail"` raises as soon as a table would lose rows to a NULL key
    (checked before the next table is built); the default quarantines them."""
    if on_bad not in ("quarantine", "fail"):
        raise ValueError(f"on_bad must be 'quarantine' or 'fail', not {on_bad!r}")

    billed_bound = None
    renamed = rename_columns(clean)
    patient_rows = stage_rows("patients", distinct_first(renamed, PATIENT_ATTRS, "patient_id"))
    patients, patients_bad = split_not_null(patient_rows, PATIENT_KEYS, on_bad, "patients")
    patients = stage("patients", patients)
    if keying == "last_wins":
        by_name = last_wins_lookup(patients, "name", "patient_id")
        if stage_rows is _keep:
            adm_rows = distinct_first(renamed, ADMISSION_ATTRS, "admission_id")
        else:
            adm_rows = distinct_first_staged(renamed, ADMISSION_ATTRS, "admission_id", stage_rows, "admissions")
        adm_rows = (adm_rows.join(by_name, "name", "left")
                    .select("admission_id", "patient_id", *ADMISSION_ATTRS[1:]))
        adm_rows = stage_rows("admissions", adm_rows)
        admissions, admissions_bad = split_not_null(adm_rows, ADMISSION_KEYS, on_bad, "admissions")
        admissions = stage("admissions", admissions)
        # one row per admission day at most: broadcast behind that bound, so
        # the bills are not shuffled for this lookup
        by_date = last_wins_lookup(admissions, "admission_date", "admission_id")
        if bound_dates and isinstance(admissions.schema["admission_date"].dataType, T.DateType):
            billed_bound = day_span(admissions, "admission_date")
            by_date = bounded_broadcast(by_date, billed_bound)
        bill_rows = (distinct_first(renamed, BILLING_ATTRS, "billing_id").join(by_date, "admission_date", "left")
                     .select("billing_id", "admission_id", "total_charges", "insurance_provider"))
    elif keying == "exact":
        keys = patients.select(*[F.col(a).alias(f"_p_{a}") for a in PATIENT_ATTRS], "patient_id")
        cond = [F.col(a).eqNullSafe(F.col(f"_p_{a}")) for a in PATIENT_ATTRS]
        adm_rows = (renamed.join(keys, cond, "left")
                    .select(F.col(ROW_POS).alias("admission_id"), "patient_id", *ADMISSION_ATTRS[1:]))
        adm_rows = stage_rows("admissions", adm_rows)
        admissions, admissions_bad = split_not_null(adm_rows, ADMISSION_KEYS, on_bad, "admissions")
        admissions = stage("admissions", admissions)
        # A row's admission is loaded when it has a date and its patient is, that is, has the patient keys.
        loaded = F.col("admission_date").isNotNull()
        for c in PATIENT_KEYS:
            loaded = loaded & F.col(c).isNotNull()
        bill_rows = renamed.select(F.col(ROW_POS).alias("billing_id"),
                                   F.when(loaded, F.col(ROW_POS)).alias("admission_id"),
                                   "total_charges", "insurance_provider")
    else:
        raise ValueError(f"keying must be 'last_wins' or 'exact', not {keying!r}")
    bill_rows = stage_rows("billing", bill_rows)
    billing, billing_bad = split_not_null(bill_rows, BILLING_KEYS, on_bad, "billing")
    billing = stage("billing", billing)
    return Tables(patients, admissions, billing,
                  {"patients": patients_bad, "admissions": admissions_bad, "billing": billing_bad},
                  {"patients": patient_rows, "admissions": adm_rows, "billing": bill_rows}, billed_bound)
