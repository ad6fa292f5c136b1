"""Dedup by hashes, the written cleaning tables and the store's loads."""

import os

import pytest
from pyspark.sql import functions as F

from staylens.operators import dedup, keys
from staylens.plans.cleaning import cleaning_report, cleaning_stages
from staylens.plans.normalise import normalise
from staylens.plans.store import EncounterStore
from staylens.schemas import RAW_COLUMNS

TYPES = {"Billing Amount": "double", "Room Number": "int"}
SCHEMA = ", ".join(f"`{c}` {TYPES.get(c, 'string')}" for c in RAW_COLUMNS) + ", row_pos bigint"


def raw_rows(spark):
    rows = []
    for i in range(60):
        row = {c: f"{c} {i % 5}" for c in RAW_COLUMNS} | {
            "Name": None if i % 11 == 0 else f"pat o'neil-{i % 7}", "Billing Amount": None if i % 13 == 0 else float(i % 20),
            "Room Number": i % 3, "Date of Admission": f"2020-01-{i % 28 + 1:02d}", "Discharge Date": None if i % 9 == 0 else "2020-03-01"}
        rows += [tuple(row[c] for c in RAW_COLUMNS) + (10 * i + k,) for k in range(1 + (i % 4 == 0) * 2)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def stage_in(folder, seen):
    def stage(name, df):
        seen.append(name)
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.parquet(f"{folder}/{name}")
    return stage


def same(a, b):
    return sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("case", ["hashes", "one hash", "no copies", "many shared"])
def test_rows_of_one_hash_are_told_apart(spark, scratch_dir, monkeypatch, case):
    raw = raw_rows(spark)
    if case == "no copies":
        raw = raw.where("row_pos % 10 = 0").dropDuplicates(RAW_COLUMNS)
    if case == "many shared":
        monkeypatch.setattr(keys, "BROADCAST_MAX_ROWS", 0)
    hashed = dedup.with_row_hash(raw, RAW_COLUMNS)
    if case == "one hash":      # rows that are not equal but have the same hash
        hashed = hashed.withColumn(dedup.ROW_HASH, F.lit(1).cast("bigint"))
    got = dedup.group_first(hashed, RAW_COLUMNS, stage_in(scratch_dir, []), "t")
    assert same(got, raw.groupBy(*RAW_COLUMNS).agg(F.min("row_pos").alias("row_pos"), F.count(F.lit(1)).alias(dedup.COPIES)))


def test_cleaning_writes_the_rows_once_formatted(spark, scratch_dir):
    raw, seen = raw_rows(spark), []
    staged, lazy = cleaning_stages(raw, stage_rows=stage_in(scratch_dir, seen)), cleaning_stages(raw)
    assert seen == ["raw", "raw-shared", "formatted", "stats"]
    for name in ("dedup", "titled", "dated", "clean"):
        a, b = getattr(staged, name), getattr(lazy, name)
        assert a.schema.simpleString() == b.schema.simpleString() and same(a, b), name
    report = cleaning_report(staged)
    assert same(report, cleaning_report(lazy))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "/formatted" in plan and "/raw" not in plan            # no second grouping of the raw rows
    for name in ("dedup", "dated", "clean"):
        assert "Exchange" not in getattr(staged, name)._jdf.queryExecution().executedPlan().toString().split("Subquery")[0], name


def test_cleaning_shuffles_hashes_not_rows(spark, scratch_dir):
    shuffled = []

    def stage(name, df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffled.extend(line for line in plan.splitlines() if "Exchange hashpartitioning" in line and name == "raw-shared")
        df.write.parquet(f"{scratch_dir}/{name}")
        return spark.read.parquet(f"{scratch_dir}/{name}")

    rows = raw_rows(spark).dropDuplicates(RAW_COLUMNS)
    cleaning_stages(rows, stage_rows=stage)
    assert len(shuffled) == 1 and "_row_hash" in shuffled[0] and "Name" not in shuffled[0]


def test_staged_admissions_equal_lazy_ones(spark, scratch_dir):
    clean, seen = cleaning_stages(raw_rows(spark)).clean, []
    staged, lazy = normalise(clean, stage_rows=stage_in(scratch_dir, seen)), normalise(clean)
    assert "admissions-shared" in seen
    for t in ("patients", "admissions", "billing"):
        assert same(getattr(staged, t), getattr(lazy, t)) and same(staged.quarantine[t], lazy.quarantine[t]), t


def test_a_load_tells_admissions_apart_by_hashes(spark, scratch_dir, monkeypatch):
    clean = cleaning_stages(raw_rows(spark)).clean
    one = EncounterStore(spark, os.path.join(scratch_dir, "one"))
    one.append(clean)
    load = one.loads()[0]
    assert spark.read.parquet(f"{one.path}/loads/{load}/admissions-shared").columns == [dedup.ROW_HASH]
    monkeypatch.setattr(keys, "BROADCAST_MAX_ROWS", 0)            # as if too many hashes were shared
    two = EncounterStore(spark, os.path.join(scratch_dir, "two"))
    two.append(clean)
    for t in ("patients", "admissions", "billing"):
        assert same(one.read(t), two.read(t)), t
    ids = [r[0] for r in one.read("admissions").select("admission_id").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
