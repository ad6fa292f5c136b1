"""Dense ids, the store of several loads, key bitmaps, sketches, inference."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from staylens import registry
from staylens.functions.dates import KNOWN_FORMATS, format_number, parse_date_as
from staylens.operators import dense, integrity
from staylens.operators.sketches import distinct_in, distinct_sketches
from staylens.plans import cleaning
from staylens.plans.store import EncounterStore
from staylens.sources.inference import infer_types, typed


def to(folder):
    def stage(name, df):
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.parquet(f"{folder}/{name}")
    return stage


def test_dense_ids_follow_the_order_and_stay(spark, scratch_dir):
    values = random.Random(1).sample(range(10 ** 6), 5000)
    frame = spark.createDataFrame([(v,) for v in values], "v long").repartition(7)
    ids = dense.dense_ids(frame, "v", "id", to(scratch_dir), start=11)
    first, second = ({r["v"]: r["id"] for r in ids.collect()} for _ in range(2))
    assert first == second == {v: i for i, v in enumerate(sorted(values), 11)}
    plan = ids._jdf.queryExecution().optimizedPlan().toString()
    assert "block" in plan and ids.columns == ["v", "id"]
    assert dense.dense_ids(frame.limit(0), "v", "id", to(scratch_dir + "/none")).count() == 0


def test_offsets_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "PARTS_AT_ONCE", 3)
    rng = random.Random(2)
    sizes = [(p, rng.randrange(1, 50)) for p in range(0, 60, 2)]
    got = {r["part"]: r["offset"] for r in dense.running_offsets(spark.createDataFrame(sizes, "part long, n long")).collect()}
    want, at = {}, 0
    for p, n in sizes:
        want[p], at = at, at + n
    assert got == want


def clean_halves(spark):
    clean = registry._clean(spark, SF001)
    odd = F.floor(F.col("row_pos") / 2) % 2
    return clean.where(odd == 0), clean.where(odd == 1)


def test_a_load_that_fails_leaves_nothing(spark, scratch_dir, monkeypatch):
    store, (one, two) = EncounterStore(spark, scratch_dir), clean_halves(spark)
    assert store.loads() == [] and store.read("patients").count() == 0
    store.append(one)
    before = [store.read(t).count() for t in ("patients", "admissions", "billing")]
    with pytest.raises(ValueError, match="admissions: rows with NULL"):
        store.append(two, on_bad="fail")                  # patients are written, admissions have NULL dates
    number = EncounterStore._numbered

    def broken(self, table, *rest):
        if table == "billing":
            raise RuntimeError("lost")
        return number(self, table, *rest)

    monkeypatch.setattr(EncounterStore, "_numbered", broken)
    with pytest.raises(RuntimeError, match="lost"):
        store.append(two)
    monkeypatch.undo()
    assert len(os.listdir(f"{scratch_dir}/loads")) == 3 and len(store.loads()) == 1
    assert [store.read(t).count() for t in ("patients", "admissions", "billing")] == before
    store.append(two)
    ids = sorted(r[0] for r in store.read("patients").select("patient_id").collect())
    assert ids == list(range(1, len(ids) + 1)) and len(ids) > before[0]


def test_two_loads_at_once_do_not_both_commit(spark, scratch_dir):
    store = EncounterStore(spark, scratch_dir)
    store._commit(1, "a")
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):
        store._commit(1, "b")
    assert store.loads() == ["a"]
    open(f"{scratch_dir}/commits/00000002", "w").close()     # a commit cut off before its name
    assert store.loads() == ["a"]


def test_foreign_keys_by_bitmap(spark):
    rng = random.Random(3)
    parents = rng.sample(range(200_000), 3000) + [0, 32767, 32768, 32769, 65536]
    keys = [*parents[:500], *rng.sample(range(300_000), 2000), 0, 1, 32767, 32768, 32769, 65535, 65536, None, None, -5]
    parent = spark.createDataFrame([(p,) for p in parents] + [(None,)], "pid long")
    child = spark.createDataFrame(list(enumerate(keys)), "row int, fk long")
    loaded, bad = integrity.split_foreign_key(child, parent, "fk", "pid")
    known = set(parents)
    assert sorted(r["row"] for r in bad.collect()) == [i for i, k in enumerate(keys) if k is not None and k not in known]
    assert loaded.count() + bad.count() == len(keys) and loaded.columns == child.columns


def test_children_are_not_shuffled_while_the_bitmap_is_small(spark, monkeypatch):
    child = registry._tables(spark, SF001).billing
    parent = registry._tables(spark, SF001).admissions
    loaded, _ = integrity.split_foreign_key(child, parent, "admission_id")
    plan = loaded._jdf.queryExecution().executedPlan().toString()
    join = plan.index("BroadcastHashJoin")
    scan = plan.index("billing_id", join)
    assert "Exchange hashpartitioning(admission_id" not in plan and "BroadcastExchange" in plan and scan > join
    monkeypatch.setattr(integrity, "BITMAP_MAX_SPAN", 10)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    wide, _ = integrity.split_foreign_key(child, parent, "admission_id")
    assert "BroadcastHashJoin" not in wide._jdf.queryExecution().executedPlan().toString() and wide.count() == loaded.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_empty_parents_orphan_every_key(spark):
    child = spark.createDataFrame([(1, 5), (2, None)], "row int, fk long")
    loaded, bad = integrity.split_foreign_key(child, spark.createDataFrame([], "pid long"), "fk", "pid")
    assert [r["row"] for r in loaded.collect()] == [2] and [r["row"] for r in bad.collect()] == [1]


def test_sketches_of_months_add_up(spark):
    rows = [(p, dt.date(2020, 1 + (p * 7 + k) % 12, 3), "ab"[p % 2]) for p in range(6000) for k in range(2)] + [(None, dt.date(2020, 1, 1), "a"), (1, None, "a"), (1, dt.date(2020, 1, 1), None)]
    frame = spark.createDataFrame(rows, "p long, day date, g string")
    held = distinct_sketches(frame, "p", "day", ("g",))
    assert held.count() == 24
    got = {r["g"]: r["n_estimated"] for r in distinct_in(held, ("g",)).collect()}
    assert all(abs(n - 3000) <= 60 for n in got.values())
    part = distinct_in(held, (), F.lit(dt.date(2020, 3, 1)), F.lit(dt.date(2020, 5, 31))).first()["n_estimated"]
    exact = len({p for p, day, g in rows if p is not None and day is not None and g and 3 <= day.month <= 5})
    assert abs(part - exact) <= 0.02 * exact


def test_types_are_the_narrowest_that_fit(spark):
    rows = [("1", "1", "1.5", "true", "2020-1-5", "x", "9999999999", None, "12abc"), ("NA", "x", "NA", "FALSE", "", "1", "3", "NA", "7"), ("-7", "3", "2e3", None, "2020-12-31", None, "null", "", "8")]
    names = [f"c{i}" for i in range(9)]
    text = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = {r["column_name"]: r[1:] for r in infer_types(text).collect()}
    assert {n: got[n][0] for n in names} == dict(zip(names, ["int", "string", "double", "boolean", "date", "string", "bigint", "string", "string"]))
    assert got["c0"] == ("int", 2, 1, 0) and got["c7"] == ("string", 0, 3, 0)
    loose = {r["column_name"]: (r["type"], r["n_bad"]) for r in infer_types(text, max_bad=0.34).collect()}
    assert loose["c1"] == ("int", 1) and loose["c8"] == ("int", 1)
    out = typed(text, infer_types(text, max_bad=0.34))
    assert dict(out.dtypes)["c4"] == "date" and [r["c1"] for r in out.collect()] == [1, None, 3] and [r["c8"] for r in out.collect()] == [None, 7, 8]


def test_dates_by_the_first_format(spark):
    rows = [(3, "2020-01-02"), (1, "not a date"), (2, "31/12/2020"), (4, "1/2/2020"), (5, None)]
    frame = spark.createDataFrame(rows, "row_pos long, day string")
    out = {r["row_pos"]: r["day"] for r in cleaning.format_dates_detected(frame, ("day",)).collect()}
    assert out == {1: None, 2: dt.date(2020, 12, 31), 3: None, 4: dt.date(2020, 2, 1), 5: None}
    none = cleaning.format_dates_detected(frame.where("row_pos = 1"), ("day",)).collect()
    assert [r["day"] for r in none] == [None]
    row = spark.range(1).select(*(format_number(F.lit(x)) for x in ("2020-1-2", "13/1/2020", "1/13/2020", "2020/1/3", "3.1.2020", "20200103", "x")),
                                parse_date_as(F.lit("1/13/2020"), F.lit(3))).first()
    assert list(row) == [1, 2, 3, 4, 5, 6, None, dt.date(2020, 1, 13)] and len(KNOWN_FORMATS) == 6
