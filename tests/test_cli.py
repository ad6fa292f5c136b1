"""The command line: load a raw CSV, then compute the reports."""

import os

from pyspark.sql import functions as F

from conftest import SF001
from staylens.__main__ import main
from staylens.sources.fixtures import raw_encounters_text


def test_load_then_report(spark, scratch_dir, capsys):
    raw = os.path.join(scratch_dir, "raw")
    (raw_encounters_text(spark, SF001).coalesce(1).sortWithinPartitions("row_pos").drop("row_pos")
     .write.option("header", True).csv(raw))
    tables = os.path.join(scratch_dir, "tables")
    out = os.path.join(scratch_dir, "reports")
    main(["load", "--raw", raw, "--out", tables])
    out_text = capsys.readouterr().out
    assert "patients: 200 rows" in out_text and "clean: 1497 rows" in out_text
    main(["report", "--tables", tables, "--out", out])
    # same numbers as the golden sf0.001 run (FIXTURES.md)
    assert spark.read.parquet(os.path.join(tables, "patients")).count() == 200
    kpi = spark.read.parquet(os.path.join(out, "kpi_cards")).first()
    assert (kpi.total_patients, round(kpi.avg_cost, 4)) == (150, 196933.2922)
    assert spark.read.parquet(os.path.join(out, "encounters")).count() == 1815
    assert spark.read.parquet(os.path.join(out, "forecast")).count() == 120
    rep = spark.read.parquet(os.path.join(tables, "cleaning_report"))
    assert rep.where((F.col("step") == "save") & (F.col("metric") == "rows")).first().value == 1497.0


def test_load_with_outliers_per_group(spark, scratch_dir):
    from staylens.operators.outliers import remove_outliers
    from staylens.plans.cleaning import cleaning_stages
    from staylens.sources.files import read_raw_csv
    raw = os.path.join(scratch_dir, "raw")
    (raw_encounters_text(spark, SF001).coalesce(1).sortWithinPartitions("row_pos").drop("row_pos")
     .write.option("header", True).csv(raw))
    tables = os.path.join(scratch_dir, "tables")
    main(["load", "--raw", raw, "--out", tables, "--outlier-group-by", "Hospital"])
    dated = cleaning_stages(read_raw_csv(spark, raw)).dated
    want = remove_outliers(dated, "Billing Amount", group_cols=["Hospital"]).count()
    assert spark.read.parquet(os.path.join(tables, "clean")).count() == want
