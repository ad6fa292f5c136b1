"""Schemas, column maps and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Raw encounter file: column names as they appear in the source file.
# ---------------------------------------------------------------------------
NAME = "Name"
GENDER = "Gender"
BLOOD_TYPE = "Blood Type"
CONDITION = "Medical Condition"
ADMIT_DATE = "Date of Admission"
DOCTOR = "Doctor"
HOSPITAL = "Hospital"
INSURER = "Insurance Provider"
BILLING = "Billing Amount"
ROOM = "Room Number"
ADMIT_TYPE = "Admission Type"
DISCHARGE_DATE = "Discharge Date"
MEDICATION = "Medication"
TEST_RESULTS = "Test Results"
ROW_POS = "row_pos"

RAW_COLUMNS = (
    NAME, GENDER, BLOOD_TYPE, CONDITION, ADMIT_DATE, DOCTOR, HOSPITAL,
    INSURER, BILLING, ROOM, ADMIT_TYPE, DISCHARGE_DATE, MEDICATION, TEST_RESULTS,
)

# Every column is text in the file; the load step types the two numeric ones
# (what a CSV reader infers for them) and leaves the dates for the date step.
RAW_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])
RAW_TYPES = {BILLING: T.DoubleType(), ROOM: T.IntegerType()}

# Columns whose distinct values the cleaning run lists.
CATEGORY_COLUMNS = (GENDER, BLOOD_TYPE, CONDITION, INSURER, ADMIT_TYPE, MEDICATION, TEST_RESULTS)

# Columns that must not be null in the normalised tables.
PATIENT_KEYS = ("name",)
ADMISSION_KEYS = ("admission_date", "patient_id")
BILLING_KEYS = ("admission_id",)

# Source column -> table column (the file keeps Name and Gender,
# which the tables spell in lower case).
RENAME_MAP = {
    "Name": "name",
    "Gender": "gender",
    "Blood Type": "blood_type",
    "Medical Condition": "medical_condition",
    "Date of Admission": "admission_date",
    "Discharge Date": "discharge_date",
    "Admission Type": "admission_type",
    "Room Number": "room_number",
    "Doctor": "doctor",
    "Hospital": "hospital",
    "Billing Amount": "total_charges",
    "Insurance Provider": "insurance_provider",
}

PATIENT_ATTRS = ("name", "gender", "blood_type", "medical_condition")
ADMISSION_ATTRS = ("name", "admission_date", "discharge_date", "admission_type",
                   "room_number", "doctor", "hospital")
BILLING_ATTRS = ("admission_date", "total_charges", "insurance_provider")

PATIENTS_SCHEMA = T.StructType([
    T.StructField("patient_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("gender", T.StringType(), True),
    T.StructField("blood_type", T.StringType(), True),
    T.StructField("medical_condition", T.StringType(), True),
])
ADMISSIONS_SCHEMA = T.StructType([
    T.StructField("admission_id", T.LongType(), False),
    T.StructField("patient_id", T.LongType(), False),
    T.StructField("admission_date", T.DateType(), False),
    T.StructField("discharge_date", T.DateType(), True),
    T.StructField("admission_type", T.StringType(), True),
    T.StructField("room_number", T.IntegerType(), True),
    T.StructField("doctor", T.StringType(), True),
    T.StructField("hospital", T.StringType(), True),
])
BILLING_SCHEMA = T.StructType([
    T.StructField("billing_id", T.LongType(), False),
    T.StructField("admission_id", T.LongType(), False),
    T.StructField("total_charges", T.DoubleType(), True),
    T.StructField("insurance_provider", T.StringType(), True),
])
ENCOUNTER_COLUMNS = ("patient_id", "gender", "medical_condition", "admission_date",
                     "discharge_date", "doctor", "admission_type", "total_charges",
                     "length_of_stay")

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------

# Text a CSV reader turns into a missing value (pandas' default na_values).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Default date format of the date-parsing step: month and day with or without
# a leading zero.
DATE_FORMAT = "yyyy-M-d"
TIMESTAMP_FORMAT = "yyyy-M-d H:mm:ss"

# Outlier rule: |z| <= 3 is kept.
OUTLIER_THRESHOLD = 3.0

# Top-k of the doctor report.
TOP_DOCTORS = 10

# Forecast horizon in months.
FORECAST_HORIZON = 120

# Annual growth rates of the forecast, in this order; they are summed in this
# order and divided by 12 for the monthly compound rate.
GROWTH_FACTORS = (
    ("Population Growth", 0.007),
    ("Obesity Trend", 0.015),
    ("Diabetes Trend", 0.013),
    ("Aging Effect", 0.01),
    ("Mortality Rate", -0.005),
)

# Summary windows of the forecast: (name, first month index, last month index).
FORECAST_WINDOWS = (
    ("1yr", 0, 11),
    ("5yr", 48, 59),
    ("10yr", 108, 119),
)


def total_annual_growth(factors=GROWTH_FACTORS) -> float:
    """Sum of the annual rates, added left to right in float arithmetic."""
    total = 0.0
    for _, rate in factors:
        total = total + rate
    return total


def monthly_growth_rate(factors=GROWTH_FACTORS) -> float:
    return total_annual_growth(factors) / 12
