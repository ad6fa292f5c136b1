"""SQL statements of every registered query, for DuckDB.

The tables of the driver are registered as views (orders, customer, ...).
Each statement restates the whole chain as common table expressions -
derived raw table, token handling, dedup, title case, dates, z-score
filter, normalised tables, encounter view - and then the query itself, so a
result can be checked against an engine that shares no code with Spark.
Doubles are rounded to 6 decimals, as on the Spark side.
"""

from __future__ import annotations

# Everything the statements need is written out here, so that an error in the
# library's own constants does not repeat itself on this side.
# Text that means "missing" to the CSV reader.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
             "None", "n/a", "nan", "null")
RAW_COLUMNS = ("Name", "Gender", "Blood Type", "Medical Condition", "Date of Admission", "Doctor", "Hospital", "Insurance Provider",
               "Billing Amount", "Room Number", "Admission Type", "Discharge Date", "Medication", "Test Results")
CATEGORY_COLUMNS = ("Gender", "Blood Type", "Medical Condition", "Insurance Provider", "Admission Type", "Medication", "Test Results")
RENAME_MAP = {"Name": "name", "Gender": "gender", "Blood Type": "blood_type", "Medical Condition": "medical_condition",
              "Date of Admission": "admission_date", "Discharge Date": "discharge_date", "Admission Type": "admission_type",
              "Room Number": "room_number", "Doctor": "doctor", "Hospital": "hospital", "Billing Amount": "total_charges",
              "Insurance Provider": "insurance_provider"}
PATIENT_ATTRS = ("name", "gender", "blood_type", "medical_condition")
ADMISSION_ATTRS = ("name", "admission_date", "discharge_date", "admission_type", "room_number", "doctor", "hospital")
BILLING_ATTRS = ("admission_date", "total_charges", "insurance_provider")
MEDICATIONS = ("Aspirin", "Ibuprofen", "Lipitor", "Paracetamol", "Penicillin")
TEST_RESULTS = ("Normal", "Abnormal", "Inconclusive")
_GROWTH = repr(1.0 + (0.007 + 0.015 + 0.013 + 0.01 - 0.005) / 12)     # a month's growth

D = 6  # rounding digits


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _r(expr: str) -> str:
    return f"round({expr}, {D})"


_TOKENS = "(" + ", ".join(_s(t) for t in NA_TOKENS) + ")"
_DATA = ", ".join(_q(c) for c in RAW_COLUMNS)
_NUMERIC = {"Billing Amount": "DOUBLE", "Room Number": "INTEGER"}


def _case(value: str, words) -> str:
    whens = " ".join(f"WHEN {i} THEN {_s(w)}" for i, w in enumerate(words[:-1]))
    return f"CASE {value} {whens} ELSE {_s(words[-1])} END"


_CASED = r"[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"


def _title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '{_CASED}'), "
            f"lambda r: upper(r[1]) || lower(r[2:])), '')")


def _date(x: str) -> str:
    return f"CAST(try_strptime({x}, '%Y-%m-%d') AS DATE)"


def _raw_select() -> str:
    parts = []
    for c in RAW_COLUMNS:
        v = f"CASE WHEN {_q(c)} IN {_TOKENS} THEN NULL ELSE {_q(c)} END"
        if c in _NUMERIC:
            v = f"TRY_CAST({v} AS {_NUMERIC[c]})"
        parts.append(f"{v} AS {_q(c)}")
    return ", ".join(parts)


_RENAMED = ", ".join(f"{_q(src)} AS {dst}" for src, dst in RENAME_MAP.items())
_P = ", ".join(PATIENT_ATTRS)
_A = ", ".join(ADMISSION_ATTRS)
_B = ", ".join(BILLING_ATTRS)
_A_OUT = ", ".join(f"a.{c}" for c in ADMISSION_ATTRS[1:])

def _stays(admissions: str, bills: str) -> str:
    """Complete stays of known patients, once per bill, or once with charge 0."""
    return f"""
        WITH stay AS (
          SELECT admission_id, patient_id, gender, medical_condition, admission_date, discharge_date, doctor, admission_type,
                 datediff('day', admission_date, discharge_date) AS days
          FROM {admissions} INNER JOIN (SELECT patient_id, gender, medical_condition FROM patients) USING (patient_id)
          WHERE admission_date IS NOT NULL AND discharge_date IS NOT NULL)
        SELECT patient_id, gender, medical_condition, admission_date, discharge_date, doctor, admission_type,
               ifnull(total_charges::DOUBLE, 0.0) AS total_charges, days::INTEGER AS length_of_stay
        FROM stay LEFT JOIN (SELECT admission_id, total_charges FROM {bills}) USING (admission_id)"""


CTES = [
    ("base", """
        SELECT o.o_orderkey AS k, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate,
               o.o_orderpriority, c.c_name, c.c_mktsegment, n.n_name, s.s_name
        FROM orders o
        JOIN customer c ON o.o_custkey = c.c_custkey
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN supplier s ON s.s_suppkey = o.o_orderkey % (SELECT count(*) FROM supplier)"""),
    ("copies", "SELECT *, unnest(CASE WHEN k % 100 = 7 THEN [0, 1] ELSE [0] END) AS dup FROM base"),
    ("raw_text", f"""
        SELECT
          CASE WHEN k % 3 = 0 THEN upper('pat o''neil-' || substr(c_name, 10))
               ELSE lower('pat o''neil-' || substr(c_name, 10)) END AS "Name",
          CASE WHEN o_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS "Gender",
          CASE WHEN k % 61 = 0 THEN NULL ELSE CAST(o_custkey % 8 AS VARCHAR) END AS "Blood Type",
          CASE WHEN k % 50 = 0 THEN 'OTHER' ELSE c_mktsegment END AS "Medical Condition",
          CASE WHEN k % 97 = 0 THEN 'not a date' WHEN k % 53 = 0 THEN ''
               ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS "Date of Admission",
          s_name AS "Doctor",
          n_name AS "Hospital",
          o_orderstatus AS "Insurance Provider",
          printf('%.2f', CASE WHEN k % 500 = 1 THEN o_totalprice * 20 ELSE o_totalprice END) AS "Billing Amount",
          CAST(k % 400 + 101 AS VARCHAR) AS "Room Number",
          o_orderpriority AS "Admission Type",
          CASE WHEN k % 89 = 0 THEN NULL
               ELSE strftime(CAST(o_orderdate AS DATE) + CAST(k % 30 + 1 AS INTEGER), '%Y-%m-%d') END
            AS "Discharge Date",
          CASE WHEN k % 73 = 0 THEN 'None' ELSE {_case('o_custkey % 5', MEDICATIONS)} END AS "Medication",
          CASE WHEN k % 71 = 0 THEN 'NA' ELSE {_case('k % 3', TEST_RESULTS)} END AS "Test Results",
          k * 2 + dup AS row_pos
        FROM copies"""),
    ("raw", f"SELECT {_raw_select()}, row_pos FROM raw_text"),
    ("dedup", f"SELECT {_DATA}, min(row_pos) AS row_pos FROM raw GROUP BY ALL"),
    ("titled", f"SELECT * REPLACE ({_title(_q('Name'))} AS \"Name\") FROM dedup"),
    ("dated", f"""SELECT * REPLACE ({_date(_q('Date of Admission'))} AS "Date of Admission",
                                   {_date(_q('Discharge Date'))} AS "Discharge Date") FROM titled"""),
    ("ostats", 'SELECT avg("Billing Amount") AS m, stddev_pop("Billing Amount") AS s FROM dated'),
    ("scored", 'SELECT d.*, (SELECT m FROM ostats) AS _m, (SELECT s FROM ostats) AS _s, '
               '("Billing Amount" - (SELECT m FROM ostats)) / NULLIF((SELECT s FROM ostats), 0) AS _z '
               'FROM dated d'),
    ("clean", "SELECT * EXCLUDE (_m, _s, _z) FROM scored WHERE abs(_z) <= 3"),
    ("ren", f"SELECT {_RENAMED}, row_pos FROM clean"),
    ("patients_all", f"SELECT min(row_pos) AS patient_id, {_P} FROM ren GROUP BY ALL"),
    ("patients", "SELECT * FROM patients_all WHERE name IS NOT NULL"),
    ("name_lk", "SELECT name, max(patient_id) AS patient_id FROM patients GROUP BY name"),
    ("adm_rows", f"SELECT min(row_pos) AS admission_id, {_A} FROM ren GROUP BY ALL"),
    ("adm_all", f"SELECT a.admission_id, l.patient_id, {_A_OUT} FROM adm_rows a LEFT JOIN name_lk l ON a.name = l.name"),
    ("admissions", "SELECT * FROM adm_all WHERE admission_date IS NOT NULL AND patient_id IS NOT NULL"),
    ("date_lk", "SELECT admission_date, max(admission_id) AS admission_id FROM admissions GROUP BY admission_date"),
    ("bill_rows", f"SELECT min(row_pos) AS billing_id, {_B} FROM ren GROUP BY ALL"),
    ("bill_all", "SELECT b.billing_id, d.admission_id, b.total_charges, b.insurance_provider "
                 "FROM bill_rows b LEFT JOIN date_lk d ON b.admission_date = d.admission_date"),
    ("billing", "SELECT * FROM bill_all WHERE admission_id IS NOT NULL"),
    ("view", _stays("admissions", "billing")),
]

_EXACT_CTES = [
    ("x_rows", "SELECT r.*, p.patient_id FROM ren r LEFT JOIN patients p ON "
               + " AND ".join(f"r.{a} IS NOT DISTINCT FROM p.{a}" for a in PATIENT_ATTRS)),
    ("x_adm", f"SELECT row_pos AS admission_id, patient_id, {', '.join(ADMISSION_ATTRS[1:])} FROM x_rows "
              "WHERE admission_date IS NOT NULL AND patient_id IS NOT NULL"),
    ("x_bill", "SELECT row_pos AS billing_id, row_pos AS admission_id, total_charges, insurance_provider "
               "FROM x_rows WHERE admission_date IS NOT NULL AND patient_id IS NOT NULL"),
    ("x_view", _stays("x_adm", "x_bill")),
]


def _series_ctes(prefix: str, group: str | None) -> list[tuple[str, str]]:
    """Monthly distinct patients (gap-filled, last month dropped), fit."""
    g = f"{group}, " if group else ""
    gsel = f"{group} AS g, " if group else ""
    gkey = "g, " if group else ""
    where = f" AND {group} IS NOT NULL" if group else ""
    gby = "GROUP BY g" if group else ""
    join_g = "c.g = s.g AND " if group else ""
    return [
        (f"{prefix}counts", f"SELECT {gsel}last_day(admission_date) AS month_end, "
                            f"count(DISTINCT patient_id) AS n FROM view WHERE admission_date IS NOT NULL{where} "
                            f"GROUP BY ALL"),
        (f"{prefix}bounds", f"SELECT {gkey}CAST(date_trunc('month', min(month_end)) AS DATE) AS lo, "
                            f"(SELECT CAST(date_trunc('month', max(admission_date)) AS DATE) FROM view) AS hi FROM {prefix}counts {gby}"),
        (f"{prefix}spine", f"SELECT {gkey}lo, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), "
                           f"CAST(hi AS TIMESTAMP) - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS DATE) AS m "
                           f"FROM {prefix}bounds"),
        (f"{prefix}monthly", f"SELECT {'s.g, ' if group else ''}last_day(s.m) AS month_end, "
                             f"CAST(datediff('month', s.lo, s.m) AS INTEGER) AS k, "
                             f"CAST(coalesce(c.n, 0) AS BIGINT) AS n_patients "
                             f"FROM {prefix}spine s LEFT JOIN {prefix}counts c "
                             f"ON {join_g}c.month_end = last_day(s.m)"),
        (f"{prefix}fit", f"""
            SELECT {gkey}count(*) AS n_months,
                   coalesce(regr_slope(n_patients, k), 0) AS slope,
                   coalesce(regr_intercept(n_patients, k), avg(n_patients)) AS intercept,
                   stddev_pop(n_patients) AS std_y, avg(n_patients) AS mean_y,
                   max(month_end) AS last_month_end
            FROM {prefix}monthly {gby}"""),
        (f"{prefix}fk", f"SELECT *, CAST(unnest(range(0, 120)) AS INTEGER) AS k FROM {prefix}fit WHERE n_months > 0"),
        (f"{prefix}fc", f"""
            SELECT {gkey}k, last_day(last_month_end + to_months(CAST(k + 1 AS INTEGER))) AS month_end,
                   intercept + slope * CAST(n_months + k AS DOUBLE) AS base,
                   pow(CAST('{_GROWTH}' AS DOUBLE), CAST(k AS DOUBLE)) AS growth,
                   std_y * sqrt(1.0 + CAST(k AS DOUBLE) / CAST(n_months AS DOUBLE)) AS band,
                   mean_y
            FROM {prefix}fk"""),
        (f"{prefix}fcv", f"SELECT *, base * growth AS value FROM {prefix}fc"),
        (f"{prefix}summary", f"""
            SELECT {gkey}any_value(mean_y) AS current_avg,
                   avg(value) FILTER (WHERE k BETWEEN 0 AND 11) AS predicted_1yr,
                   avg(value) FILTER (WHERE k BETWEEN 48 AND 59) AS predicted_5yr,
                   avg(value) FILTER (WHERE k BETWEEN 108 AND 119) AS predicted_10yr
            FROM {prefix}fcv {gby}"""),
    ]


SERIES = _series_ctes("s_", None)
GSERIES = _series_ctes("g_", "medical_condition")


def _with(*extra: list[tuple[str, str]]) -> str:
    ctes = list(CTES)
    for e in extra:
        ctes += e
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes) + "\n"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _missing() -> str:
    counts = ", ".join(
        f"count(*) FILTER (WHERE {_q(c)} IS NULL{' OR isnan(' + _q(c) + ')' if _NUMERIC.get(c) == 'DOUBLE' else ''})"
        f" AS m{i}" for i, c in enumerate(RAW_COLUMNS))
    rows = [f"SELECT {_s(c)} AS column_name, {i} AS position, m{i} AS missing_count, "
            f"{_r(f'CAST(m{i} AS DOUBLE) / n * 100.0')} AS missing_pct FROM mr" for i, c in enumerate(RAW_COLUMNS)]
    return _with([("mr", f"SELECT count(*) AS n, {counts} FROM raw")]) + _union(rows)


def _missing_by_group(group: str) -> str:
    cols = [c for c in RAW_COLUMNS if c != group]
    counts = ", ".join(
        f"count(*) FILTER (WHERE {_q(c)} IS NULL{' OR isnan(' + _q(c) + ')' if _NUMERIC.get(c) == 'DOUBLE' else ''})"
        f" AS m{i}" for i, c in enumerate(cols))
    rows = [f"SELECT {_q(group)}, {_s(c)} AS column_name, {i} AS position, m{i} AS missing_count, "
            f"{_r(f'CAST(m{i} AS DOUBLE) / n * 100.0')} AS missing_pct FROM mg" for i, c in enumerate(cols)]
    return _with([("mg", f"SELECT {_q(group)}, count(*) AS n, {counts} FROM raw GROUP BY {_q(group)}")]) + _union(rows)


def _growth(name: str) -> str:
    return f"{_r(f'(predicted_{name} - current_avg) / current_avg * 100.0')} AS growth_{name}"


def _summary_cols() -> str:
    return (f"{_r('current_avg')} AS current_avg, {_r('predicted_1yr')} AS predicted_1yr, "
            f"{_r('predicted_5yr')} AS predicted_5yr, {_r('predicted_10yr')} AS predicted_10yr, "
            f"{_growth('1yr')}, {_growth('5yr')}, {_growth('10yr')}")


def _unique_rows(src: str) -> str:
    return _union([f"SELECT {_s(c)} AS column_name, CAST({_q(c)} AS VARCHAR) AS value, row_pos FROM {src}"
                   for c in CATEGORY_COLUMNS])


def _cleaning_report() -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {_q(c)} IS NULL) AS m{i}" for i, c in enumerate(RAW_COLUMNS))
    miss = []
    for i, c in enumerate(RAW_COLUMNS):
        miss.append(f"SELECT 'missing' AS step, 'missing_count' AS metric, {_s(c)} AS column_name, "
                    f"CAST(m{i} AS DOUBLE) AS value, CAST(NULL AS DATE) AS value_date FROM mr")
        miss.append(f"SELECT 'missing', 'missing_pct', {_s(c)}, {_r(f'CAST(m{i} AS DOUBLE) / n * 100.0')}, "
                    f"CAST(NULL AS DATE) FROM mr")
    dup = ("SELECT CAST(sum(c) AS DOUBLE) AS n_rows, CAST(sum(c - 1) AS DOUBLE) AS n_dup, "
           "CAST(coalesce(sum(CASE WHEN c > 1 THEN c END), 0) AS DOUBLE) AS n_groups "
           f"FROM (SELECT count(*) AS c FROM raw GROUP BY {_DATA})")
    parts = miss + [
        "SELECT 'duplicates', 'rows', CAST(NULL AS VARCHAR), n_rows, CAST(NULL AS DATE) FROM dc",
        "SELECT 'duplicates', 'duplicates', CAST(NULL AS VARCHAR), n_dup, CAST(NULL AS DATE) FROM dc",
        "SELECT 'duplicates', 'rows_in_groups', CAST(NULL AS VARCHAR), n_groups, CAST(NULL AS DATE) FROM dc",
        f"SELECT 'unique', 'distinct_values', column_name, CAST(count(DISTINCT value) + "
        f"max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS DOUBLE), CAST(NULL AS DATE) "
        f"FROM ({_unique_rows('dated')}) GROUP BY column_name",
        "SELECT 'outliers', 'rows_in', 'Billing Amount', CAST(count(*) AS DOUBLE), CAST(NULL AS DATE) FROM scored",
        "SELECT 'outliers', 'rows_removed', 'Billing Amount', "
        "CAST(count(*) FILTER (WHERE NOT coalesce(abs(_z) <= 3, false)) AS DOUBLE), CAST(NULL AS DATE) FROM scored",
        "SELECT 'save', 'rows', CAST(NULL AS VARCHAR), CAST(count(*) AS DOUBLE), CAST(NULL AS DATE) FROM clean",
    ]
    for c in ("Date of Admission", "Discharge Date"):
        parts.append(f"SELECT 'date_range', 'earliest', {_s(c)}, CAST(NULL AS DOUBLE), min({_q(c)}) FROM clean")
        parts.append(f"SELECT 'date_range', 'latest', {_s(c)}, CAST(NULL AS DOUBLE), max({_q(c)}) FROM clean")
    return _with([("mr", f"SELECT count(*) AS n, {counts} FROM raw"), ("dc", dup)]) + _union(parts)


def _outlier_group() -> str:
    return _with([
        ("gst", 'SELECT "Hospital" AS g, avg("Billing Amount") AS m, stddev_pop("Billing Amount") AS s '
                'FROM dated GROUP BY "Hospital"'),
        ("gsc", 'SELECT d."Hospital", g.m, g.s, ("Billing Amount" - g.m) / NULLIF(g.s, 0) AS z '
                'FROM dated d LEFT JOIN gst g ON d."Hospital" IS NOT DISTINCT FROM g.g'),
    ]) + (f'SELECT "Hospital", count(*) AS rows_in, count(*) FILTER (WHERE abs(z) <= 3) AS rows_kept, '
          f"count(*) FILTER (WHERE NOT coalesce(abs(z) <= 3, false)) AS rows_removed, "
          f"{_r('any_value(m)')} AS mean, {_r('any_value(s)')} AS std FROM gsc GROUP BY \"Hospital\"")


def _not_null_split() -> str:
    parts = []
    for table, allrows in (("patients", "patients_all"), ("admissions", "adm_all"), ("billing", "bill_all")):
        parts.append(f"SELECT {_s(table)} AS table_name, 'loaded' AS status, count(*) AS n_rows FROM {table}")
        parts.append(f"SELECT {_s(table)}, 'quarantined', (SELECT count(*) FROM {allrows}) - "
                     f"(SELECT count(*) FROM {table})")
    return _with() + _union(parts)


def _orphans(admissions: str, bills: str) -> str:
    return _union([
        f"SELECT 'admissions.patient_id' AS relation, count(*) AS n_child, "
        f"count(*) FILTER (WHERE patient_id IS NOT NULL AND patient_id NOT IN (SELECT patient_id FROM patients)) "
        f"AS n_orphans FROM {admissions}",
        f"SELECT 'billing.admission_id', count(*), "
        f"count(*) FILTER (WHERE admission_id IS NOT NULL AND admission_id NOT IN "
        f"(SELECT admission_id FROM {admissions})) FROM {bills}"])


def _card(value: str) -> str:
    return f"printf('%.0f patients', {value})"


def _signed(window: str) -> str:
    return f"printf('%+.1f%%', (predicted_{window} - current_avg) / current_avg * 100.0)"


SQL: dict[str, str] = {
    # cleaning
    "missing_report": _missing(),
    "missing_report_by_group": _missing_by_group("Hospital"),
    "duplicate_count": _with() + (
        "SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(c - 1) AS BIGINT) AS n_duplicates, "
        "CAST(coalesce(sum(CASE WHEN c > 1 THEN c END), 0) AS BIGINT) AS n_in_groups "
        f"FROM (SELECT count(*) AS c FROM raw GROUP BY {_DATA})"),
    "duplicate_rows": _with() + f"SELECT * FROM raw QUALIFY count(*) OVER (PARTITION BY {_DATA}) > 1",
    "dedup_rows": _with() + "SELECT * FROM dedup",
    "title_case_names": _with() + f"SELECT row_pos, \"Name\", {_title(_q('Name'))} AS name_title FROM dedup",
    "parse_dates": _with() + (
        f'SELECT row_pos, "Date of Admission" AS admission_text, {_date(_q("Date of Admission"))} AS admission_date, '
        f'"Discharge Date" AS discharge_text, {_date(_q("Discharge Date"))} AS discharge_date FROM titled'),
    "unique_values": _with() + (
        f"SELECT column_name, value, min(row_pos) AS first_pos FROM ({_unique_rows('dated')}) GROUP BY ALL"),
    "outlier_report": _with() + (
        "SELECT count(*) AS rows_in, count(*) FILTER (WHERE abs(_z) <= 3) AS rows_kept, "
        "count(*) FILTER (WHERE NOT coalesce(abs(_z) <= 3, false)) AS rows_removed, "
        f"{_r('any_value(_m)')} AS mean, {_r('any_value(_s)')} AS std FROM scored"),
    "outliers_removed": _with() + (
        f'SELECT row_pos, "Billing Amount", {_r("_z")} AS z_score FROM scored '
        "WHERE NOT coalesce(abs(_z) <= 3, false)"),
    "outliers_by_group": _outlier_group(),
    "date_range": _with() + _union([
        f"SELECT {_s(c)} AS column_name, min({_q(c)}) AS earliest, max({_q(c)}) AS latest FROM clean"
        for c in ("Date of Admission", "Discharge Date")]),
    "clean_encounters": _with() + "SELECT * FROM clean",
    "cleaning_report": _cleaning_report(),
    "csv_round_trip": _with() + (
        """SELECT * REPLACE ('  Dr "' || "Doctor" || '", ' AS "Doctor"), "Hospital" || ' ""x"", ' || "Gender" AS "Note" """
        "FROM (SELECT * EXCLUDE (row_pos) FROM raw)"),
    "failed_casts": _with() + (
        "SELECT 'Billing Amount' AS column_name, count(*) FILTER (WHERE row_pos % 7 <> 0 AND row_pos % 11 = 0) AS n_missing, "
        "count(*) FILTER (WHERE row_pos % 7 = 0) AS n_bad FROM raw UNION ALL SELECT 'Room Number', 0, 0"),
    # tables
    "appended_patients": _with() + "SELECT * FROM patients UNION ALL SELECT * FROM patients",
    "rename_project": _with() + f"SELECT {_P}, {', '.join(ADMISSION_ATTRS[1:])}, total_charges, "
                                "insurance_provider, row_pos FROM ren",
    "patients": _with() + "SELECT * FROM patients",
    "admissions": _with() + "SELECT * FROM admissions",
    "billing": _with() + "SELECT * FROM billing",
    "last_patient_by_name": _with() + "SELECT * FROM name_lk",
    "last_admission_by_date": _with() + "SELECT * FROM date_lk",
    "not_null_split": _not_null_split(),
    "fk_orphans": _with() + _orphans("admissions", "billing"),
    "fk_orphans_exact": _with(_EXACT_CTES) + _orphans("x_adm", "x_bill"),
    "encounter_view": _with() + "SELECT * FROM view",
    "encounter_view_exact": _with(_EXACT_CTES) + "SELECT * FROM x_view",
    "load_summary": _with() + "SELECT count(*) AS n_rows, count(DISTINCT patient_id) AS n_patients, "
                              "9 AS n_columns FROM view",
    # reports
    "kpi_cards": _with() + (
        "SELECT total_patients, round(avg_stay, 6) AS avg_stay, round(avg_cost, 6) AS avg_cost, "
        "format('{:,}', total_patients) AS total_patients_label, "
        "printf('%.1f days', avg_stay) AS avg_stay_label, "
        "'$' || format('{:,.2f}', avg_cost) AS avg_cost_label "
        "FROM (SELECT count(DISTINCT patient_id) AS total_patients, avg(length_of_stay) AS avg_stay, "
        "avg(total_charges) AS avg_cost FROM view)"),
    "kpi_cards_by_group": _with() + (
        "SELECT medical_condition, count(DISTINCT patient_id) AS total_patients, "
        f"{_r('avg(length_of_stay)')} AS avg_stay, {_r('avg(total_charges)')} AS avg_cost "
        "FROM view WHERE medical_condition IS NOT NULL GROUP BY medical_condition"),
    "cost_by_gender": _with() + (
        "SELECT gender, round(round_even(avg(total_charges) * 100, 0) / 100, 6) AS avg_cost, "
        "'$' || format('{:,.2f}', round_even(avg(total_charges) * 100, 0) / 100) AS avg_cost_label "
        "FROM view WHERE gender IS NOT NULL GROUP BY gender"),
    "stay_by_condition": _with() + (
        f"SELECT medical_condition, {_r('avg(length_of_stay)')} AS avg_los, "
        "count(DISTINCT patient_id) AS n_patients FROM view WHERE medical_condition IS NOT NULL "
        "GROUP BY medical_condition"),
    "condition_labels": _with() + (
        "SELECT medical_condition, count(DISTINCT patient_id) || ' patients' AS n_patients_label FROM view "
        "WHERE medical_condition IS NOT NULL GROUP BY medical_condition"),
    "forecast_cards": _with(SERIES) + "SELECT " + ", ".join(
        [_card("current_avg") + " AS current_label"]
        + [f"{_card('predicted_' + w)} AS predicted_{w}_label, {_signed(w)} AS growth_{w}_label" for w in ("1yr", "5yr", "10yr")]) + " FROM s_summary",
    "top_doctors": _with() + (
        "SELECT doctor, count(DISTINCT patient_id) AS n_patients FROM view WHERE doctor IS NOT NULL "
        "GROUP BY doctor ORDER BY n_patients DESC, doctor LIMIT 10"),
    "admission_type_pct": _with() + (
        "SELECT medical_condition, admission_type, n_rows, "
        f"{_r('CAST(n_rows AS DOUBLE) / sum(n_rows) OVER (PARTITION BY medical_condition) * 100.0')} AS pct "
        "FROM (SELECT medical_condition, admission_type, count(*) AS n_rows FROM view "
        "WHERE medical_condition IS NOT NULL AND admission_type IS NOT NULL GROUP BY ALL)"),
    "admission_type_pct_wide": _with([
        ("pairs", "SELECT medical_condition, admission_type, count(*) AS n FROM view "
                  "WHERE medical_condition IS NOT NULL AND admission_type IS NOT NULL GROUP BY ALL"),
        ("pcts", "SELECT medical_condition, admission_type, "
                 f"{_r('CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY medical_condition) * 100.0')} AS pct "
                 "FROM pairs"),
    ]) + "SELECT medical_condition, " + ", ".join(
        f"coalesce(max(pct) FILTER (WHERE admission_type = {_s(t)}), 0) AS {_q(t)}"
        for t in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM pcts GROUP BY medical_condition",
    "monthly_patients": _with(SERIES) + "SELECT month_end, k, n_patients FROM s_monthly",
    "monthly_fit": _with(SERIES) + (
        f"SELECT n_months, {_r('slope')} AS slope, {_r('intercept')} AS intercept, {_r('std_y')} AS std_y, "
        f"{_r('mean_y')} AS mean_y FROM s_fit WHERE n_months > 0"),
    "forecast": _with(SERIES) + (
        f"SELECT k, month_end, {_r('base')} AS base, {_r('growth')} AS growth, {_r('value')} AS value, "
        f"{_r('value - band')} AS lower, {_r('value + band')} AS upper FROM s_fcv"),
    "forecast_summary": _with(SERIES) + f"SELECT {_summary_cols()} FROM s_summary",
    "forecast_series": _with(SERIES) + _union([
        "SELECT month_end, 'history' AS kind, round(CAST(n_patients AS DOUBLE), 6) AS value, "
        "CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper FROM s_monthly",
        f"SELECT month_end, 'forecast', {_r('value')}, {_r('value - band')}, {_r('value + band')} FROM s_fcv"]),
    "forecast_by_group": _with(GSERIES) + (
        f"SELECT f.g AS medical_condition, f.n_months, {_r('f.slope')} AS slope, {_r('f.intercept')} AS intercept, "
        f"{_summary_cols()} FROM g_fit f JOIN g_summary s ON f.g = s.g"),
}

# ---------------------------------------------------------------- models and relations
_READMIT = [("r", """
    SELECT *, datediff('day', pe, admission_date)::INTEGER AS gap_days, datediff('day', discharge_date, ns)::INTEGER AS days_to_next
    FROM (SELECT *, lag(discharge_date) OVER w AS pe, lead(admission_date) OVER w AS ns, row_number() OVER w - 1 AS n_before
          FROM x_adm WHERE discharge_date IS NOT NULL
          WINDOW w AS (PARTITION BY patient_id ORDER BY admission_date, discharge_date, admission_id))""")]
_WITHIN = "coalesce({} BETWEEN 0 AND 30, FALSE)".format
_STAY = """datediff('day', "Date of Admission", "Discharge Date")"""
_AGE_NO = """TRY_CAST(regexp_extract("Name", '([0-9]+)$', 1) AS INTEGER)"""
_AGE = f"CASE WHEN {_AGE_NO} % 17 <> 0 THEN {_AGE_NO} % 73 + 18 END"
_CONDITIONS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "OTHER")
_TYPES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _least_squares(target: str, numeric: dict[str, str], levels: dict[str, tuple[str, ...]]) -> str:
    """Normal equations over `clean`, solved by Gauss-Jordan steps in a recursive CTE."""
    names = ["(intercept)"] + [f"{c}={v}" for c, vs in levels.items() for v in vs[1:]] + list(numeric)
    d, k = len(names), len(names) - len(numeric)
    cols = [f"CAST({target} AS DOUBLE) AS y"] + [f"CAST({e} AS DOUBLE) AS v{i}" for i, e in enumerate(numeric.values())]
    cols += [f"{_q(c)} AS c{i}" for i, c in enumerate(levels)]
    present = " AND ".join(["y IS NOT NULL", *(f"v{i} IS NOT NULL" for i in range(len(numeric))), *(f"c{i} IS NOT NULL" for i in range(len(levels)))])
    x = ["1.0::DOUBLE"] + [f"CASE WHEN c{i} = {_s(v)} THEN 1.0 ELSE 0.0 END::DOUBLE" for i, vs in enumerate(levels.values()) for v in vs[1:]]
    x += [f"(v{i} - m{i}) / s{i}" for i in range(len(numeric))]
    means = ", ".join(f"avg(v{i}) AS m{i}, stddev_pop(v{i}) AS s{i}" for i in range(len(numeric)))
    ctes = [
        ("lq", f"SELECT * FROM (SELECT {', '.join(cols)} FROM clean) WHERE {present}"),
        ("lm", f"SELECT count(*) AS n, avg(y) AS my, stddev_pop(y) AS sy, {means} FROM lq"),
        ("lx", f"SELECT [{', '.join(x)}, (y - my) / sy] AS x FROM lq, lm"),
        ("lg", f"SELECT i, j, sum(x[i] * x[j]) AS v FROM lx, (SELECT unnest(range(1, {d + 2})) AS i), (SELECT unnest(range(1, {d + 2})) AS j) GROUP BY i, j"),
        ("l0", f"SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM lg WHERE i <= {d} GROUP BY i)"),
        ("lj", f"""SELECT 1 AS k, m FROM l0 UNION ALL
            SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
                     ELSE list_transform(r, lambda v, j: v - r[k] / m[k][k] * m[k][j]) END)
            FROM lj WHERE k <= {d}"""),
        ("lb", f"SELECT list_transform(m, lambda r: r[{d + 1}]) AS b FROM lj WHERE k = {d + 1}"),
        ("lr", f"SELECT 1 - ((SELECT v FROM lg WHERE i = {d + 1} AND j = {d + 1}) - (SELECT sum(b[i] * v) FROM lg, lb WHERE j = {d + 1} AND i <= {d})) "
               f"/ (SELECT v FROM lg WHERE i = {d + 1} AND j = {d + 1}) AS r2"),
    ]
    shift = " - ".join(["my + b[1] * sy", *(f"b[{k + i + 1}] * sy / s{i} * m{i}" for i in range(len(numeric)))])
    rows = [f"SELECT {_s(names[0])} AS term, {_r(shift)} AS coefficient, n::BIGINT AS n_rows, {_r('r2')} AS r_squared FROM lb, lm, lr"]
    for i, t in enumerate(names[1:], 1):
        scale = f" / s{i - k}" if i >= k else ""
        rows.append(f"SELECT {_s(t)}, {_r(f'b[{i + 1}] * sy{scale}')}, n, {_r('r2')} FROM lb, lm, lr")
    return "WITH RECURSIVE" + _with(ctes)[4:] + _union(rows)


def _correlations(columns: dict[str, str], group: str) -> str:
    names = list(columns)
    base = ", ".join(f"CAST({e} AS DOUBLE) AS v{i}" for i, e in enumerate(columns.values()))
    rows = []
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            rows.append(f"SELECT {_q(group)}, {_s(a)} AS column_a, {_s(names[j])} AS column_b, count(*) AS n_rows, {_r(f'covar_pop(v{i}, v{j})')} AS covar_pop, "
                        f"CASE WHEN min(v{i}) < max(v{i}) AND min(v{j}) < max(v{j}) THEN {_r(f'corr(v{i}, v{j})')} END AS corr "
                        f"FROM cv WHERE v{i} IS NOT NULL AND v{j} IS NOT NULL GROUP BY {_q(group)}")
    return _with([("cv", f"SELECT {_q(group)}, {base} FROM clean WHERE {_q(group)} IS NOT NULL")]) + _union(rows)


_DENSE = [
    ("d_pat", "SELECT row_number() OVER (ORDER BY patient_id) AS d, * FROM patients"),
    ("d_adm", "SELECT row_number() OVER (ORDER BY admission_id) AS d, * FROM admissions"),
    ("d_bill", "SELECT row_number() OVER (ORDER BY billing_id) AS d, * FROM billing"),
]


def _two_loads() -> list[tuple[str, str]]:
    """Clean rows of even orders loaded, then those of odd ones."""
    out: list[tuple[str, str]] = []
    for i in (1, 2):
        before = lambda t: f"(SELECT count(*) FROM {t}1)" if i == 2 else "0"  # noqa: B023, E731
        both = lambda t: f"(SELECT * FROM {t}1 UNION ALL SELECT * FROM {t}2)" if i == 2 else f"{t}1"  # noqa: B023, E731
        out += [
            (f"half{i}", f"SELECT * FROM ren WHERE row_pos // 2 % 2 = {i - 1}"),
            (f"pat{i}", f"SELECT {before('pat')} + row_number() OVER (ORDER BY f) AS patient_id, {_P} "
                        f"FROM (SELECT min(row_pos) AS f, {_P} FROM half{i} GROUP BY ALL) WHERE name IS NOT NULL"),
            (f"nlk{i}", f"SELECT name, max(patient_id) AS patient_id FROM {both('pat')} GROUP BY name"),
            (f"adm{i}", f"SELECT {before('adm')} + row_number() OVER (ORDER BY f) AS admission_id, patient_id, {_A_OUT} "
                        f"FROM (SELECT min(row_pos) AS f, {_A} FROM half{i} GROUP BY ALL) a JOIN nlk{i} USING (name) WHERE admission_date IS NOT NULL"),
            (f"dlk{i}", f"SELECT admission_date, max(admission_id) AS admission_id FROM {both('adm')} GROUP BY admission_date"),
            (f"bill{i}", f"SELECT {before('bill')} + row_number() OVER (ORDER BY f) AS billing_id, admission_id, total_charges, insurance_provider "
                         f"FROM (SELECT min(row_pos) AS f, {_B} FROM half{i} GROUP BY ALL) JOIN dlk{i} USING (admission_date)"),
        ]
    return out


def _inferred(max_bad: float) -> str:
    parts = []
    for c in RAW_COLUMNS:
        v = "trim(v)"
        fits = {"boolean": f"lower({v}) IN ('true', 'false')",
                "int": f"regexp_full_match({v}, '[+-]?[0-9]+') AND TRY_CAST({v} AS INTEGER) IS NOT NULL",
                "bigint": f"regexp_full_match({v}, '[+-]?[0-9]+') AND TRY_CAST({v} AS BIGINT) IS NOT NULL",
                "double": rf"regexp_full_match({v}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')",
                "date": f"try_strptime({v}, '%Y-%m-%d') IS NOT NULL"}
        bad = ", ".join(f"count(*) FILTER (WHERE v IS NOT NULL AND NOT ({e})) AS b_{t}" for t, e in fits.items())
        good = {t: f"n_values > 0 AND b_{t} <= n_values * {max_bad}" for t in fits}
        kind = " ".join(f"WHEN {g} THEN {_s(t)}" for t, g in good.items())
        number = " ".join(f"WHEN {g} THEN b_{t}" for t, g in good.items())
        parts.append(f"SELECT {_s(c)} AS column_name, CASE {kind} ELSE 'string' END AS type, n_values, n_missing, CASE {number} ELSE 0 END::BIGINT AS n_bad "
                     f"FROM (SELECT count(v) AS n_values, count(*) - count(v) AS n_missing, {bad} "
                     f"FROM (SELECT CASE WHEN {_q(c)} IN {_TOKENS} THEN NULL ELSE {_q(c)} END AS v FROM raw_text))")
    return _with() + _union(parts)


def _with_times() -> str:
    """The exact view over admission and discharge times."""
    k, admit = "row_pos // 2", '"Date of Admission"'
    time = f"{admit} || printf(' %02d:%02d:00', CAST({k} % 24 AS INTEGER), CAST({k} % 60 AS INTEGER))"
    dated = f"try_strptime({admit}, '%Y-%m-%d') IS NOT NULL"
    ctes = []
    for name, body in [*CTES, *_EXACT_CTES]:
        if name == "raw_text":
            ctes.append(("plain_text", body))
            body = f"""SELECT * REPLACE (CASE WHEN {dated} THEN {time} ELSE {admit} END AS "Date of Admission",
                CASE WHEN {k} % 19 = 0 AND {dated} THEN strftime(strptime({time}, '%Y-%m-%d %H:%M:%S') - INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S')
                     ELSE "Discharge Date" || printf(' %02d:30:00', CAST({k} * 7 % 24 AS INTEGER)) END AS "Discharge Date") FROM plain_text"""
        if name == "dated":
            body = ", ".join(f"try_strptime({_q(c)}, '%Y-%m-%d %H:%M:%S') AS {_q(c)}" for c in ("Date of Admission", "Discharge Date"))
            body = f"SELECT * REPLACE ({body}) FROM titled"
        if name == "x_view":
            body = body.replace("datediff('day', admission_date, discharge_date)", "CAST(trunc((epoch_us(discharge_date) - epoch_us(admission_date)) / 86400000000.0) AS INTEGER)")
        ctes.append((name, body))
    return ("WITH " + ",\n".join(f"{name} AS ({body})" for name, body in ctes)
            + "\nSELECT * REPLACE (strftime(admission_date, '%Y-%m-%d %H:%M:%S') AS admission_date, strftime(discharge_date, '%Y-%m-%d %H:%M:%S') AS discharge_date) FROM x_view")


_OTHER_DATE = """CASE WHEN try_strptime("Date of Admission", '%Y-%m-%d') IS NOT NULL AND row_pos // 2 % 5 <> 2
                  THEN strftime(strptime("Date of Admission", '%Y-%m-%d'), '%-d/%-m/%Y') ELSE "Date of Admission" END"""
SQL |= {
    "incomplete_rows": _with() + (
        "SELECT reason, count(*) AS n_rows, sum(n)::BIGINT AS n_missing FROM (SELECT CASE "
        + " ".join(f"WHEN {_q(c)} IS NULL THEN {_s(c)}" for c in RAW_COLUMNS) + " ELSE 'complete' END AS reason, "
        + " + ".join(f"({_q(c)} IS NULL)::INTEGER" for c in RAW_COLUMNS) + " AS n FROM raw) GROUP BY reason"),
    "complete_rows": _with() + "SELECT * FROM raw WHERE " + " AND ".join(f"{_q(c)} IS NOT NULL" for c in RAW_COLUMNS),
    "mixed_dates": _with([("other", f"SELECT row_pos, {_OTHER_DATE} AS v FROM raw_text")])
    + "SELECT row_pos, CAST(coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%d/%m/%Y')) AS DATE) AS admission_date FROM other",
    "catalog_patients": _with() + "SELECT * FROM patients",
    "sql_report": _with() + (
        f"SELECT gender, admission_type, count(*) AS n_rows, {_r('avg(length_of_stay)')} AS avg_stay FROM view GROUP BY gender, admission_type"),
    "readmissions": _with(_EXACT_CTES, _READMIT) + (
        f"SELECT patient_id, admission_id, admission_date, gap_days, {_WITHIN('gap_days')} AS readmitted, days_to_next, "
        f"{_WITHIN('days_to_next')} AS followed, n_before FROM r"),
    "readmission_rate": _with(_EXACT_CTES, _READMIT) + (
        f"SELECT admission_type, count(*) AS n_stays, count(*) FILTER (WHERE {_WITHIN('days_to_next')}) AS n_followed, "
        f"{_r('avg(' + _WITHIN('days_to_next') + '::INTEGER)')} AS rate, {_r('avg(gap_days)')} AS avg_gap_days FROM r GROUP BY admission_type"),
    "stay_regression": _least_squares(_STAY, {"Room Number": '"Room Number"', "Billing Amount": '"Billing Amount"'},
                                      {"Medical Condition": _CONDITIONS, "Admission Type": _TYPES}),
    "charge_regression": _least_squares('"Billing Amount" / 1000', {"Age": _AGE, "stay": _STAY}, {"Medical Condition": _CONDITIONS}),
    "age_cost_correlation": _correlations({"Age": _AGE, "charge": '"Billing Amount" / 1000', "stay": _STAY, "Room Number": '"Room Number"'}, "Gender"),
    "medication_by_condition": _with([("mc", 'SELECT "Medical Condition" AS medical_condition, "Medication" AS medication, count(*) AS n_rows FROM clean '
                                             'WHERE "Medical Condition" IS NOT NULL AND "Medication" IS NOT NULL GROUP BY ALL')])
    + f"SELECT *, {_r('CAST(n_rows AS DOUBLE) / sum(n_rows) OVER (PARTITION BY medical_condition) * 100.0')} AS pct FROM mc",
    "hospital_stays": _with() + (f'SELECT "Hospital" AS hospital, {_r(f"avg({_STAY})")} AS avg_stay, count(*) AS n_stays FROM clean '
                                 f'WHERE "Hospital" IS NOT NULL AND {_STAY} IS NOT NULL GROUP BY ALL'),
    "dense_patients": _with(_DENSE) + "SELECT * EXCLUDE (d) REPLACE (d AS patient_id) FROM d_pat",
    "dense_admissions": _with(_DENSE) + "SELECT a.* EXCLUDE (d) REPLACE (a.d AS admission_id, p.d AS patient_id) FROM d_adm a JOIN d_pat p USING (patient_id)",
    "dense_billing": _with(_DENSE) + "SELECT b.* EXCLUDE (d) REPLACE (b.d AS billing_id, a.d AS admission_id) FROM d_bill b JOIN d_adm a USING (admission_id)",
    **{f"two_loads_{name}": _with(_two_loads()) + f"SELECT * FROM {t}1 UNION ALL SELECT * FROM {t}2"
       for name, t in (("patients", "pat"), ("admissions", "adm"), ("billing", "bill"))},
    "patients_by_year": _with() + (
        "SELECT year(admission_date)::INTEGER AS year, medical_condition, count(DISTINCT patient_id) AS n_patients, TRUE AS within_2pct "
        "FROM view WHERE medical_condition IS NOT NULL GROUP BY 1, 2"),
    "inferred_types": _inferred(0.02),
    "inferred_types_strict": _inferred(0.0),
    "detected_dates": _with([
        ("other", f'SELECT row_pos, CASE WHEN v IN {_TOKENS} THEN NULL ELSE v END AS v FROM (SELECT row_pos, {_OTHER_DATE} AS v FROM raw_text)'),
        ("way", "SELECT arg_min(v, row_pos) LIKE '%/%' AS slashes FROM other "
                "WHERE try_strptime(v, '%Y-%m-%d') IS NOT NULL OR try_strptime(v, '%d/%m/%Y') IS NOT NULL")])
    + "SELECT row_pos, CAST(CASE WHEN slashes THEN try_strptime(v, '%d/%m/%Y') ELSE try_strptime(v, '%Y-%m-%d') END AS DATE) AS admission_date FROM other, way",
    "encounter_view_timestamps": _with_times(),
    "loaded_bills": _with([
        ("moved", "SELECT * REPLACE (CASE WHEN billing_id // 2 % 31 = 0 THEN NULL WHEN billing_id // 2 % 13 = 0 THEN admission_id * 2 + 1000001 ELSE admission_id END AS admission_id) FROM billing")])
    + "SELECT *, CASE WHEN admission_id IS NULL OR admission_id IN (SELECT admission_id FROM admissions) THEN 'loaded' ELSE 'quarantined' END AS status FROM moved",
}

#: Statements of other names that are over the dirtier table.
_ON_DIRT = {name: name for name in ("loaded_bills", "inferred_types_strict", "incomplete_rows", "complete_rows")}

# The same statements over a raw table with more dirt, for the queries dirty_<name>.
_PLAIN_TEXT = "raw_text AS ("
_DIRTIER_TEXT = """raw_text AS (
        SELECT * REPLACE (
          CASE WHEN row_pos // 2 % 211 = 0 THEN NULL WHEN row_pos // 2 % 37 = 0 THEN '日' || "Name" ELSE "Name" END AS "Name",
          CASE WHEN row_pos // 2 % 31 = 0 THEN NULL ELSE "Gender" END AS "Gender",
          CASE WHEN row_pos // 2 % 47 = 0 THEN NULL ELSE "Medical Condition" END AS "Medical Condition",
          CASE WHEN row_pos // 2 % 29 = 0 THEN NULL ELSE "Doctor" END AS "Doctor",
          CASE WHEN "Date of Admission" LIKE '1995-07%' THEN NULL
               WHEN row_pos // 2 % 41 = 0 THEN replace("Date of Admission", '-0', '-') ELSE "Date of Admission" END AS "Date of Admission",
          CASE WHEN row_pos // 2 % 41 = 0 THEN replace("Discharge Date", '-0', '-') ELSE "Discharge Date" END AS "Discharge Date")
        FROM plain_text),
"""
_ON_DIRT |= {name: f"dirty_{name}" for name in (
    "missing_report", "title_case_names", "parse_dates", "cleaning_report", "not_null_split", "fk_orphans_exact",
    "encounter_view_exact", "cost_by_gender", "stay_by_condition", "top_doctors", "monthly_patients", "forecast_by_group")}
for _name, _as in _ON_DIRT.items():
    _head, _tail = SQL[_name].split(_PLAIN_TEXT, 1)
    _body, _rest = _tail.split("),\nraw AS (", 1)
    SQL[_as] = f"{_head}plain_text AS ({_body}),\n{_DIRTIER_TEXT}raw AS ({_rest}"
