"""Incremental load of raw files: exactly the rows of a batch load."""

import os

from pyspark.sql import functions as F

from conftest import SF001
from staylens.operators.dedup import drop_duplicates
from staylens.schemas import RAW_COLUMNS
from staylens.sources.fixtures import raw_encounters, raw_encounters_text
from staylens.streaming.ingest import KEY_BITS, KEY_PART, ROW_KEY, append_batch, load_batch, new_rows, start_ingest, stored_hashes


def _write_parts(spark, text, folder, lo, hi):
    part = text.where((F.col("row_pos") >= lo) & (F.col("row_pos") < hi)).orderBy("row_pos").drop("row_pos")
    part.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def test_stream_loads_each_distinct_row_once(spark, scratch_dir):
    text = raw_encounters_text(spark, SF001)
    src = os.path.join(scratch_dir, "in")
    n = text.agg(F.max("row_pos")).first()[0] + 1
    # two arrivals; the second overlaps the first so duplicates cross batches
    _write_parts(spark, text, os.path.join(src, "a"), 0, n // 2 + 200)
    _write_parts(spark, text, os.path.join(src, "b"), n // 2, n)
    table = os.path.join(scratch_dir, "raw_table")
    q = start_ingest(spark, os.path.join(src, "*"), table, os.path.join(scratch_dir, "ckpt"),
                     max_files_per_trigger=1)
    q.awaitTermination(300)
    got = spark.read.parquet(table)
    want = drop_duplicates(raw_encounters(spark, SF001))
    assert got.count() == want.count() == 1500
    cols = [f"`{c}`" for c in RAW_COLUMNS]
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_replayed_batch_adds_nothing(spark, scratch_dir):
    text = raw_encounters_text(spark, SF001).drop("row_pos").limit(50)
    table = os.path.join(scratch_dir, "t")
    append_batch(text, 0, table)
    append_batch(text, 0, table)
    assert spark.read.parquet(table).count() == text.distinct().count()


def test_a_batch_reads_the_partitions_of_its_own_rows(spark, scratch_dir):
    text = raw_encounters_text(spark, SF001).drop("row_pos")
    table = os.path.join(scratch_dir, "t")
    append_batch(text, 0, table)
    stored = spark.read.parquet(table)
    assert 200 < len(stored.inputFiles()) <= 2 ** KEY_BITS       # one file a partition
    few = load_batch(text.limit(5), stored.count()).cache()
    hashes = stored_hashes(few, stored)
    plan = hashes._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan parquet"):]
    assert "PartitionFilters: [" in scan and KEY_PART in scan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert f"ReadSchema: struct<{ROW_KEY}:bigint>" in scan           # no value column
    assert hashes.count() == few.count() <= 5
    read = {r[0] for r in stored.where(F.col(KEY_PART).isin([r[KEY_PART] for r in few.collect()])).select(F.input_file_name()).distinct().collect()}
    assert len(read) <= 5
    assert new_rows(few, stored).count() == 0


def test_new_rows_read_no_values_and_equal_hashes_are_compared(spark, scratch_dir):
    text = raw_encounters_text(spark, SF001).drop("row_pos").limit(40)
    table = os.path.join(scratch_dir, "t")
    append_batch(text, 0, table)
    stored = spark.read.parquet(table)
    other = text.withColumn("Name", F.concat(F.lit("x"), F.col("Name")))
    fresh = load_batch(other, 100).cache()
    assert new_rows(fresh, stored) is fresh          # no hash met again: nothing joined
    # the same hash on other values: the row is new
    first = stored.orderBy("row_pos").first()
    clash = fresh.limit(1).withColumn(ROW_KEY, F.lit(first[ROW_KEY])).withColumn(KEY_PART, F.lit(first[KEY_PART]))
    assert new_rows(clash, stored).count() == 1


def test_empty_batches_and_tables_without_partitions(spark, scratch_dir):
    text = raw_encounters_text(spark, SF001).drop("row_pos").limit(40)
    table, plain = os.path.join(scratch_dir, "t"), os.path.join(scratch_dir, "plain")
    append_batch(text.limit(0), 0, table)
    assert not os.path.exists(table)
    load_batch(text.limit(20)).drop(KEY_PART).write.parquet(plain)
    append_batch(text, 1, plain)
    append_batch(text.limit(0), 2, plain)
    got = spark.read.parquet(plain)
    assert KEY_PART not in got.columns and got.count() == text.distinct().count()
    assert got.select("row_pos").distinct().count() == got.count()
