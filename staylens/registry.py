"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query starts from the driver's tables (through the derived raw
encounter table) and runs over all of it. Each intermediate table that many
queries read - raw, deduplicated/formatted, clean, the three normalised
tables, the view - is written once per application (`plans.stages`), the
way the reports of a dashboard read one loaded database; each query then
runs its own step over the whole of its input.

Doubles are rounded to 6 decimals here (and only here), so results can be
compared with the SQL oracle regardless of summation order; the library
itself returns full precision.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.dates import parse_date, stay_days
from staylens.functions.text import title_case
from staylens.operators import dedup, outliers, profile, readmission, reports, sketches, timeseries
from staylens.operators.correlation import correlations
from staylens.operators.integrity import not_null_counts, orphan_report, split_foreign_key
from staylens.operators.keys import last_wins_lookup
from staylens.operators.regression import linear_regression
from staylens.plans import cleaning
from staylens.plans.encounters import encounter_view, register_view
from staylens.plans.normalise import Tables, normalise, rename_project
from staylens.plans.stages import materialised, remembered, source_mark
from staylens.plans.store import EncounterStore, with_dense_ids
from staylens.schemas import (ADMISSION_KEYS, ADMIT_DATE, ADMIT_TYPE, BILLING, BILLING_KEYS, CATEGORY_COLUMNS, CONDITION,
                              DISCHARGE_DATE, GENDER, HOSPITAL, NAME, PATIENT_KEYS, PATIENTS_SCHEMA, RAW_COLUMNS, ROOM, ROW_POS, TOP_DOCTORS)
from staylens.session import scratch_path
from staylens.sources.files import create_tables, failed_casts, load_raw, read_raw_csv, read_table, save_csv, save_table, write_table
from staylens.sources.fixtures import dirtier, orphaned, other_dates, raw_encounters_text, with_age, with_times
from staylens.sources.inference import infer_types

DIGITS = 6
GROUP_FORECAST_KEY = "medical_condition"
#: After a folder's name: the table derived from it with more dirt in it.
DIRTIER = "::dirtier"
#: Queries that also run on that table, as dirty_<name>.
ON_DIRT = ("missing_report", "title_case_names", "parse_dates", "cleaning_report", "not_null_split", "fk_orphans_exact",
           "encounter_view_exact", "cost_by_gender", "stay_by_condition", "top_doctors", "monthly_patients", "forecast_by_group")
SOURCE_TABLES = ("orders", "customer", "nation", "supplier")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (for comparison with another engine)."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


# ---------------------------------------------------------------- stages
def _folder(sf: str) -> str:
    return sf.removesuffix(DIRTIER)


def _key(spark: SparkSession, sf: str, stage: str) -> str:
    """Key of a stage's table: source folder, state of its files, stage."""
    return f"{sf}|{source_mark(spark, [f'{_folder(sf)}/{t}.parquet' for t in SOURCE_TABLES])}|{stage}"


def _text(spark: SparkSession, sf: str) -> DataFrame:
    """The raw table as a file would hold it, derived from the order tables."""
    text = raw_encounters_text(spark, _folder(sf))
    return dirtier(text) if sf.endswith(DIRTIER) else text


def _raw_text(spark: SparkSession, sf: str) -> DataFrame:
    return materialised(spark, _key(spark, sf, "raw_text"), lambda: _text(spark, sf))


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    """The raw table, loaded (tokens -> NULL, numbers typed) and written once,
    with the hash of each row for the dedup."""
    def build() -> DataFrame:
        raw = load_raw(_text(spark, sf))
        return dedup.with_row_hash(raw, [c for c in raw.columns if c != ROW_POS])

    return materialised(spark, _key(spark, sf, "raw"), build).drop(dedup.ROW_HASH)


def _stages(spark: SparkSession, sf: str) -> cleaning.CleaningStages:
    """The cleaning run's tables. The raw rows, and the deduplicated ones as they
    were and formatted, are written once; the outlier step, the profiles and the
    run report scan them."""
    def build() -> cleaning.CleaningStages:
        raw = _raw(spark, sf)        # written: the stage of that name is read back
        return cleaning.cleaning_stages(raw, stage_rows=lambda name, df: materialised(spark, _key(spark, sf, name), lambda: df))

    return remembered(spark, _key(spark, sf, "stages"), build)


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    """The clean table: a filter of the written rows by the written statistics."""
    return _stages(spark, sf).clean


def _tables(spark: SparkSession, sf: str, keying: str = "last_wins") -> Tables:
    """The three tables, their rows written once and read back before the next
    one is keyed from them; table and quarantine are filters over these."""
    def stage(name: str, df: DataFrame) -> DataFrame:
        # patients do not depend on the keying: one table for both
        key = name if name == "patients" else f"{name}|{keying}"
        return materialised(spark, _key(spark, sf, key), lambda: df)

    return remembered(spark, _key(spark, sf, f"tables|{keying}"), lambda: normalise(_clean(spark, sf), keying, stage_rows=stage))


def _view(spark: SparkSession, sf: str, keying: str = "last_wins") -> DataFrame:
    return materialised(spark, _key(spark, sf, f"view|{keying}"), lambda: encounter_view(_tables(spark, sf, keying)))


# ---------------------------------------------------------------- cleaning
def q_missing_report(spark, sf):
    return rounded(profile.missing_report(_raw(spark, sf)))


def q_missing_report_by_group(spark, sf):
    return rounded(profile.missing_report(_raw(spark, sf), group_cols=(HOSPITAL,)))


def q_duplicate_count(spark, sf):
    return dedup.duplicate_count(_raw(spark, sf))


def q_duplicate_rows(spark, sf):
    return dedup.duplicate_rows(_raw(spark, sf))


def q_dedup_rows(spark, sf):
    return dedup.drop_duplicates(_raw(spark, sf))


def q_title_case_names(spark, sf):
    d = _stages(spark, sf).dedup
    return d.select(ROW_POS, F.col(NAME), title_case(F.col(NAME)).alias("name_title"))


def q_parse_dates(spark, sf):
    t = _stages(spark, sf).titled      # names formatted on the written deduplicated rows
    return t.select(ROW_POS,
                    F.col(f"`{ADMIT_DATE}`").alias("admission_text"),
                    parse_date(F.col(f"`{ADMIT_DATE}`")).alias("admission_date"),
                    F.col(f"`{DISCHARGE_DATE}`").alias("discharge_text"),
                    parse_date(F.col(f"`{DISCHARGE_DATE}`")).alias("discharge_date"))


def q_unique_values(spark, sf):
    return profile.unique_values(_stages(spark, sf).dated, CATEGORY_COLUMNS)


def q_outlier_report(spark, sf):
    return rounded(outliers.outlier_report(_stages(spark, sf).dated, BILLING))


def q_outliers_removed(spark, sf):
    rows = outliers.outlier_rows(_stages(spark, sf).dated, BILLING)
    return rounded(rows.select(ROW_POS, F.col(f"`{BILLING}`"), "z_score"))


def q_outliers_by_group(spark, sf):
    return rounded(outliers.outlier_report(_stages(spark, sf).dated, BILLING, group_cols=(HOSPITAL,)))


def q_date_range(spark, sf):
    return profile.date_range(_stages(spark, sf).clean, (ADMIT_DATE, DISCHARGE_DATE))


def q_clean_encounters(spark, sf):
    return _stages(spark, sf).clean


def q_cleaning_report(spark, sf):
    return rounded(cleaning.cleaning_report(_stages(spark, sf)))


def q_csv_round_trip(spark, sf):
    """The raw text with quotes, separators, outer blanks and a further column,
    written as CSV and read back."""
    text = _raw_text(spark, sf).drop(ROW_POS)
    text = (text.withColumn("Note", F.concat(F.col(HOSPITAL), F.lit(' ""x"", '), F.col("Gender")))
            .withColumn("Doctor", F.concat(F.lit('  Dr "'), F.col("Doctor"), F.lit('", '))))
    path = save_csv(text, scratch_path(spark, f"csv-{uuid.uuid4().hex}"))
    return read_raw_csv(spark, path).drop(ROW_POS)


def q_failed_casts(spark, sf):
    """Missing and malformed numbers, where every seventh charge is not a number
    and every eleventh is missing."""
    text = _raw_text(spark, sf)
    charge = (F.when(F.col(ROW_POS) % 7 == 0, F.lit("$1,200.50")).when(F.col(ROW_POS) % 11 == 0, F.lit("NA")).otherwise(F.col(f"`{BILLING}`")))
    return failed_casts(text.withColumn(BILLING, charge))


# ---------------------------------------------------------------- tables
def q_appended_patients(spark, sf):
    """The patients table written, and the same rows appended."""
    patients = _tables(spark, sf).patients
    path = write_table(patients, scratch_path(spark, f"appended-{uuid.uuid4().hex}"))
    return read_table(spark, write_table(patients, path, mode="append"))


def q_rename_project(spark, sf):
    return rename_project(_clean(spark, sf))


def q_patients(spark, sf):
    return _tables(spark, sf).patients


def q_admissions(spark, sf):
    return _tables(spark, sf).admissions


def q_billing(spark, sf):
    return _tables(spark, sf).billing


def q_last_patient_by_name(spark, sf):
    return last_wins_lookup(_tables(spark, sf).patients, "name", "patient_id")


def q_last_admission_by_date(spark, sf):
    return last_wins_lookup(_tables(spark, sf).admissions, "admission_date", "admission_id")


def q_not_null_split(spark, sf):
    t = _tables(spark, sf)
    parts = []
    for name, keys in (("patients", PATIENT_KEYS), ("admissions", ADMISSION_KEYS), ("billing", BILLING_KEYS)):
        counts = not_null_counts(t.unsplit[name], keys)
        parts.append(counts.select(F.lit(name).alias("table_name"), F.inline(F.array(
            F.struct(F.lit("loaded").alias("status"), F.col("loaded").alias("n_rows")),
            F.struct(F.lit("quarantined").alias("status"), F.col("quarantined").alias("n_rows"))))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _orphans(spark, sf, keying):
    t = _tables(spark, sf, keying)
    return orphan_report([
        ("admissions.patient_id", t.admissions, t.patients, "patient_id"),
        ("billing.admission_id", t.billing, t.admissions, "admission_id"),
    ])


def q_fk_orphans(spark, sf):
    return _orphans(spark, sf, "last_wins")


def q_fk_orphans_exact(spark, sf):
    return _orphans(spark, sf, "exact")


def q_encounter_view(spark, sf):
    return _view(spark, sf)


def q_encounter_view_exact(spark, sf):
    return _view(spark, sf, "exact")


def q_load_summary(spark, sf):
    return reports.load_summary(_view(spark, sf))


# ---------------------------------------------------------------- reports
def q_kpi_cards(spark, sf):
    return rounded(reports.kpis(_view(spark, sf), labels=True))


def q_kpi_cards_by_group(spark, sf):
    return rounded(reports.kpis(_view(spark, sf), labels=False, group_cols=(GROUP_FORECAST_KEY,)))


def q_cost_by_gender(spark, sf):
    return rounded(reports.cost_by_group(_view(spark, sf), "gender", labels=True))


def q_stay_by_condition(spark, sf):
    return rounded(reports.stay_by_group(_view(spark, sf), "medical_condition"))


def q_condition_labels(spark, sf):
    return reports.stay_by_group(_view(spark, sf), "medical_condition", labels=True).select("medical_condition", "n_patients_label")


def q_forecast_cards(spark, sf):
    cards = timeseries.forecast_summary(timeseries.linear_fit(_history(spark, sf)), labels=True)
    return cards.select(*[c for c in cards.columns if c.endswith("_label")])


def q_top_doctors(spark, sf):
    return reports.top_groups(_view(spark, sf), "doctor", k=TOP_DOCTORS)


def q_admission_type_pct(spark, sf):
    return rounded(reports.crosstab_pct(_view(spark, sf)))


def q_admission_type_pct_wide(spark, sf):
    return rounded(reports.crosstab_pct_wide(_view(spark, sf)))


def _history(spark, sf, groups=()):
    def stage(name: str, counts: DataFrame) -> DataFrame:
        return materialised(spark, _key(spark, sf, "|".join([name, *groups])), lambda: counts)

    return timeseries.monthly_counts(_view(spark, sf), group_cols=groups, stage=stage)


def q_monthly_patients(spark, sf):
    return _history(spark, sf)


def q_monthly_fit(spark, sf):
    return rounded(timeseries.linear_fit(_history(spark, sf)).drop("last_month_end"))


def q_forecast(spark, sf):
    return rounded(timeseries.forecast(timeseries.linear_fit(_history(spark, sf))))


def q_forecast_summary(spark, sf):
    return rounded(timeseries.forecast_summary(timeseries.linear_fit(_history(spark, sf))))


def q_forecast_series(spark, sf):
    h = _history(spark, sf)
    return rounded(timeseries.forecast_series(h, timeseries.forecast(timeseries.linear_fit(h))))


def q_forecast_by_group(spark, sf):
    groups = (GROUP_FORECAST_KEY,)
    fit = timeseries.linear_fit(_history(spark, sf, groups), group_cols=groups)
    return rounded(timeseries.forecast_summary(fit, groups, carry=("n_months", "slope", "intercept")))


def q_incomplete_rows(spark, sf):
    """Rows of the dirtier raw table by the first column that is missing."""
    return profile.incomplete_report(_raw(spark, sf + DIRTIER), RAW_COLUMNS)


def q_complete_rows(spark, sf):
    return profile.drop_incomplete(_raw(spark, sf + DIRTIER), RAW_COLUMNS)


def q_mixed_dates(spark, sf):
    """Admission dates in either of two formats."""
    rows = load_raw(other_dates(_raw_text(spark, sf)))
    return rows.select(ROW_POS, parse_date(F.col(f"`{ADMIT_DATE}`"), ("yyyy-M-d", "d/M/yyyy")).alias("admission_date"))


def q_catalog_patients(spark, sf):
    """The patients in a catalog table: created once, then rows appended to it."""
    name = f"patients_{uuid.uuid4().hex}"
    for _ in range(2):          # the second time it exists
        create_tables(spark, {name: PATIENTS_SCHEMA}, location=scratch_path(spark, "catalog"))
    return spark.table(save_table(_tables(spark, sf).patients, name, mode="append"))


def q_sql_report(spark, sf):
    """A report written in SQL over the registered views."""
    prefix = f"v{uuid.uuid4().hex}_"
    register_view(_tables(spark, sf), prefix)
    return rounded(spark.sql(
        f"SELECT p.gender, e.admission_type, count(*) AS n_rows, avg(e.length_of_stay) AS avg_stay FROM {prefix}encounters e "
        f"JOIN {prefix}patients p USING (patient_id) GROUP BY p.gender, e.admission_type"))


# ---------------------------------------------------------------- models and relations
def _readmissions(spark, sf):
    """Stays of patients known by all their attributes, with what comes before and after."""
    stays = _tables(spark, sf, "exact").admissions
    return materialised(spark, _key(spark, sf, "readmissions"), lambda: readmission.readmissions(stays))


def q_readmissions(spark, sf):
    return _readmissions(spark, sf).select("patient_id", "admission_id", "admission_date", "gap_days", "readmitted", "days_to_next", "followed", "n_before")


def q_readmission_rate(spark, sf):
    """Share of stays that are followed by another within the horizon, by admission type."""
    r = _readmissions(spark, sf)
    return rounded(r.groupBy("admission_type").agg(F.count(F.lit(1)).alias("n_stays"), F.count_if("followed").alias("n_followed"),
                                                   F.avg(F.col("followed").cast("double")).alias("rate"), F.avg("gap_days").alias("avg_gap_days")))


def q_readmission_model(spark, sf):
    r = _readmissions(spark, sf)
    rows = readmission.risk_rows(r, r.agg(F.max("admission_date")).scalar())
    return rounded(readmission.readmission_model(rows, categorical=("admission_type",)))


def _stay_rows(spark, sf):
    rows = _clean(spark, sf)
    return rows.withColumn("stay", stay_days(DISCHARGE_DATE, ADMIT_DATE))


def q_stay_regression(spark, sf):
    """Stay on condition, admission type, room and charge."""
    return rounded(linear_regression(_stay_rows(spark, sf), "stay", (ROOM, BILLING), (CONDITION, ADMIT_TYPE)))


def q_charge_regression(spark, sf):
    """Charge (in thousands) on age, stay and condition."""
    rows = with_age(_stay_rows(spark, sf)).withColumn("charge", F.col(f"`{BILLING}`") / 1000)
    return rounded(linear_regression(rows, "charge", ("Age", "stay"), (CONDITION,)))


def q_age_cost_correlation(spark, sf):
    """Age, charge (in thousands), stay and room against each other, by gender."""
    rows = with_age(_stay_rows(spark, sf)).withColumn("charge", F.col(f"`{BILLING}`") / 1000)
    return rounded(correlations(rows, ("Age", "charge", "stay", ROOM), (GENDER,)))


def q_medication_by_condition(spark, sf):
    rows = _clean(spark, sf).withColumnsRenamed({CONDITION: "medical_condition", "Medication": "medication"})
    return rounded(reports.crosstab_pct(rows, "medical_condition", "medication"))


def q_hospital_stays(spark, sf):
    """Mean stay and stays of each hospital, shortest first."""
    rows = _stay_rows(spark, sf).withColumnRenamed(HOSPITAL, "hospital").where("hospital IS NOT NULL AND stay IS NOT NULL")
    return rounded(rows.groupBy("hospital").agg(F.avg("stay").alias("avg_stay"), F.count(F.lit(1)).alias("n_stays")))


def _dense(spark, sf):
    def stage(name: str, df: DataFrame) -> DataFrame:
        return materialised(spark, _key(spark, sf, f"dense|{name}"), lambda: df)

    return remembered(spark, _key(spark, sf, "dense"), lambda: with_dense_ids(_tables(spark, sf), stage))


def q_dense_patients(spark, sf):
    return _dense(spark, sf).patients


def q_dense_admissions(spark, sf):
    return _dense(spark, sf).admissions


def q_dense_billing(spark, sf):
    return _dense(spark, sf).billing


def _two_loads(spark, sf):
    """A store that took the clean rows of even orders, then those of odd ones."""
    def build() -> Tables:
        store = EncounterStore(spark, scratch_path(spark, f"store-{uuid.uuid4().hex}"))
        clean, odd = _clean(spark, sf), F.floor(F.col(ROW_POS) / 2) % 2
        for half in (0, 1):
            store.append(clean.where(odd == half))
        return store.tables()

    return remembered(spark, _key(spark, sf, "two_loads"), build)


def q_two_loads_patients(spark, sf):
    return _two_loads(spark, sf).patients


def q_two_loads_admissions(spark, sf):
    return _two_loads(spark, sf).admissions


def q_two_loads_billing(spark, sf):
    return _two_loads(spark, sf).billing


def _sketches(spark, sf):
    return materialised(spark, _key(spark, sf, "sketches"), lambda: sketches.distinct_sketches(
        _view(spark, sf), "patient_id", "admission_date", ("medical_condition",)))


def q_patients_by_year(spark, sf):
    """Distinct patients per year and condition, exact and whether the merged
    monthly sketches come within 2%."""
    year = F.year("month_end").alias("year")
    estimated = sketches.distinct_in(_sketches(spark, sf), (year, "medical_condition"))
    rows = _view(spark, sf).where("medical_condition IS NOT NULL")
    exact = rows.groupBy(F.year("admission_date").alias("year"), "medical_condition").agg(F.count_distinct("patient_id").alias("n_patients"))
    near = F.abs(F.col("n_estimated") - F.col("n_patients")) <= 0.02 * F.col("n_patients")
    return exact.join(estimated, ["year", "medical_condition"], "left").select("year", "medical_condition", "n_patients", F.coalesce(near, F.lit(False)).alias("within_2pct"))


def q_inferred_types(spark, sf):
    """Types of the raw text, up to one misfit in fifty values."""
    return infer_types(_raw_text(spark, sf), max_bad=0.02)


def q_inferred_types_strict(spark, sf):
    return infer_types(_raw_text(spark, sf + DIRTIER))


def q_detected_dates(spark, sf):
    """Admission dates in the format of the first one."""
    rows = load_raw(other_dates(_raw_text(spark, sf)))
    dated = cleaning.format_dates_detected(rows, (ADMIT_DATE,))
    return dated.select(ROW_POS, F.col(f"`{ADMIT_DATE}`").alias("admission_date"))


def q_encounter_view_timestamps(spark, sf):
    """The view over stays with a time of day, every row its own admission."""
    def stage(name: str, df: DataFrame) -> DataFrame:
        return materialised(spark, _key(spark, sf, f"times|{name}"), lambda: df)

    tables = remembered(spark, _key(spark, sf, "times"), lambda: normalise(
        cleaning.cleaning_stages(load_raw(with_times(_raw_text(spark, sf))), timestamps=True, stage_rows=stage).clean, "exact", stage=stage))
    text = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("admission_date", "discharge_date")}
    return encounter_view(tables).withColumns(text)


def q_loaded_bills(spark, sf):
    """Bills with an admission, and the orphans, split while loading."""
    t = _tables(spark, sf + DIRTIER)
    loaded, bad = split_foreign_key(orphaned(t.billing), t.admissions, "admission_id")
    return loaded.withColumn("status", F.lit("loaded")).unionByName(bad.withColumn("status", F.lit("quarantined")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}


def _on_dirt(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: fn(spark, sf + DIRTIER)


QUERIES |= {f"dirty_{name}": _on_dirt(QUERIES[name]) for name in ON_DIRT}
