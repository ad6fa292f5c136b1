"""Sources and sinks: CSV and Parquet round trips, row order, tables."""

import os

from pyspark.sql import functions as F

from conftest import SF001
from staylens.schemas import ADMISSIONS_SCHEMA, PATIENTS_SCHEMA, RAW_COLUMNS
from staylens.sources import files
from staylens.sources.fixtures import raw_encounters_text


def _write_csv(spark, path, n_files):
    text = raw_encounters_text(spark, SF001)
    (text.repartitionByRange(n_files, "row_pos").sortWithinPartitions("row_pos").drop("row_pos")
     .write.mode("overwrite").option("header", True).csv(path))
    return [r.Name for r in text.orderBy("row_pos").select("Name").collect()]


def test_csv_single_file_keeps_file_order(spark, scratch_dir):
    path = os.path.join(scratch_dir, "raw1")
    names = _write_csv(spark, path, 1)
    raw = files.read_raw_csv(spark, path)
    assert raw.columns == list(RAW_COLUMNS) + ["row_pos"]
    assert [r.Name for r in raw.orderBy("row_pos").collect()] == names
    assert dict(raw.dtypes)["Billing Amount"] == "double" and dict(raw.dtypes)["Room Number"] == "int"
    # tokens are missing values after the load ('' and 'not a date' handling differ: only '' is a token)
    assert raw.where(F.col("`Date of Admission`") == "").count() == 0


def test_csv_many_files_numbered_in_order(spark, scratch_dir):
    path = os.path.join(scratch_dir, "raw3")
    names = _write_csv(spark, path, 3)
    raw = files.read_raw_csv(spark, path)
    got = raw.orderBy("row_pos").collect()
    assert [r.Name for r in got] == names
    assert [r.row_pos for r in got] == list(range(len(names)))


def test_parquet_write_modes(spark, scratch_dir):
    path = os.path.join(scratch_dir, "t")
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    files.write_table(df, path)
    files.write_table(df, path)                      # overwrite: idempotent
    assert files.read_table(spark, path).count() == 5
    files.write_table(df, path, mode="append")      # append: adds again
    assert files.read_table(spark, path).count() == 10
    csv = files.save_csv(df, os.path.join(scratch_dir, "c"))
    assert spark.read.option("header", True).csv(csv).count() == 5


def test_create_tables_and_append(spark, scratch_dir):
    made = files.create_tables(spark, {"patients_t": PATIENTS_SCHEMA, "admissions_t": ADMISSIONS_SCHEMA},
                               location=os.path.join(scratch_dir, "db"))
    assert made == ["patients_t", "admissions_t"]
    files.create_tables(spark, {"patients_t": PATIENTS_SCHEMA})  # IF NOT EXISTS
    rows = spark.createDataFrame([(1, "A", "F", None, "X")], PATIENTS_SCHEMA)
    files.save_table(rows, "patients_t", mode="append")
    files.save_table(rows, "patients_t", mode="append")
    assert spark.table("patients_t").count() == 2
    assert files.key_scan(spark, "patients_t", ["patient_id", "name"]).columns == ["patient_id", "name"]


def test_csv_many_splits_per_file_numbered_in_order(spark, scratch_dir):
    path = os.path.join(scratch_dir, "raw_split")
    names = _write_csv(spark, path, 2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    old_open = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = files.read_raw_csv(spark, path)
        assert raw.rdd.getNumPartitions() > 4
        got = raw.orderBy("row_pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", old_open)
    assert [r.Name for r in got] == names
    assert [r.row_pos for r in got] == list(range(len(names)))


def test_materialised_tables_written_once_and_deleted(spark):
    from staylens.plans import stages
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    a = stages.materialised(spark, "test|once", build)
    b = stages.materialised(spark, "test|once", build)
    assert a.count() == b.count() == 3 and len(calls) == 1
    folder = a.inputFiles()[0].replace("file:", "").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    stages.forget(spark, keys=["test|once"], delete_files=True)   # only this table
    assert not os.path.exists(folder)
    stages.materialised(spark, "test|once", build)        # rebuilt after forget
    assert len(calls) == 2


HEADER = ",".join(RAW_COLUMNS)
ROW = "Ann,F,A+,Flu,2024-1-5,Dr,H,I,12.5,7,Urgent,2024-01-09,Aspirin,Normal"


def _file(scratch_dir, text):
    path = os.path.join(scratch_dir, "raw.csv")
    with open(path, "w") as f:
        f.write(text)
    return path


def test_csv_columns_by_name_and_extra_columns(spark, scratch_dir):
    names = ["Age", *reversed(RAW_COLUMNS)]
    cells = dict(zip(RAW_COLUMNS, ROW.split(",")), Age="61")
    raw = files.read_raw_csv(spark, _file(scratch_dir, ",".join(names) + "\n" + ",".join(cells[n] for n in names) + "\n"))
    assert raw.columns == [*RAW_COLUMNS, "Age", "row_pos"]
    assert raw.first()["Name"] == "Ann" and raw.first()["Age"] == "61" and raw.first()["Billing Amount"] == 12.5


def test_csv_without_a_needed_column_is_refused(spark, scratch_dir):
    import pytest
    with pytest.raises(ValueError, match="Test Results"):
        files.read_raw_csv(spark, _file(scratch_dir, HEADER.rsplit(",", 1)[0] + "\n"))


def test_csv_quotes_line_breaks_and_blanks(spark, scratch_dir):
    text = HEADER + '\n"Ann ""Bo"" Li' + ROW[3:].replace(",F,", '",F,', 1) + '\n"two\nlines' + ROW[3:].replace(",F,", '",F,', 1) + "\n"
    raw = files.read_raw_csv(spark, _file(scratch_dir, text), multi_line=True)
    assert [r["Name"] for r in raw.orderBy("row_pos").collect()] == ['Ann "Bo" Li', "two\nlines"]
    df = spark.createDataFrame([("  lead", 'a "q", b', "x ")], "a string, b string, c string")
    path = files.save_csv(df, os.path.join(scratch_dir, "out"))
    assert tuple(spark.read.option("header", True).option("escape", '"').csv(path).first()) == ("  lead", 'a "q", b', "x ")


def test_malformed_lines_stop_the_read_or_are_set_aside(spark, scratch_dir):
    import pytest
    path = _file(scratch_dir, "\n".join([HEADER, ROW, ROW + ",more", "Short,F", ROW.replace("Ann", '"a,b"')]) + "\n")
    with pytest.raises(Exception, match="more fields than the header"):
        files.read_raw_csv(spark, path).collect()
    raw = files.read_raw_csv(spark, path, on_malformed="quarantine")
    assert sorted(r["Name"] for r in raw.collect()) == ["Ann", "Short", "a,b"]
    assert raw.count() == 3 and raw.where("Name = 'Short'").first()["Doctor"] is None
    assert [r.line for r in files.malformed_lines(spark, path).collect()] == [ROW + ",more"]


def test_failed_casts_are_not_missing_values(spark):
    df = spark.createDataFrame([("$1,200.50", "1"), ("NA", "x"), ("3.5", "2")], "`Billing Amount` string, `Room Number` string")
    assert sorted(tuple(r) for r in files.failed_casts(df).collect()) == [("Billing Amount", 1, 1), ("Room Number", 0, 1)]


def test_positions_are_dense_for_any_number_of_partitions(spark):
    df = spark.range(5000).repartition(37)
    got = [r.row_pos for r in files.dense_positions(df, start=100).collect()]
    assert sorted(got) == list(range(100, 5100))
