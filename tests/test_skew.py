"""A third of the rows on one key: results stay whole and equal, and AQE
splits the hot side of the view's inner join."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from staylens import registry
from staylens.operators import dedup, reports
from staylens.plans.encounters import encounter_view
from staylens.plans.normalise import normalise

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture()
def skew_conf(spark):
    old = {k: spark.conf.get(k, None) for k in list(CONF) + ["spark.sql.adaptive.skewJoin.enabled"]}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _hot(spark):
    clean = registry._clean(spark, SF001)
    # a third of the rows on one admission date -> one admission gets their bills
    return clean.withColumn("Date of Admission",
                            F.when(F.col("row_pos") % 3 == 0, F.lit("1996-01-01").cast("date"))
                            .otherwise(F.col("`Date of Admission`")))


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_hot_admission_is_split_and_exact(spark, skew_conf):
    t = normalise(_hot(spark), bound_dates=False)
    hot = t.billing.groupBy("admission_id").count().orderBy(F.desc("count")).first()
    assert hot["count"] * 4 > t.billing.count()           # the hot key holds over a quarter of the bills
    view = encounter_view(t)
    got = _rows(view)
    phys = view._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in phys
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    plain = encounter_view(normalise(_hot(spark), bound_dates=False))
    assert got == _rows(plain)


def test_hot_duplicate_group_kept_whole(spark, skew_conf):
    raw = registry._raw(spark, SF001)
    first = raw.where(F.col("row_pos") == F.lit(raw.agg(F.min("row_pos")).first()[0]))
    n = raw.count()
    # add n/2 copies of one row: that group is a third of the rows
    copies = (first.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n // 2 - 1))))
              .withColumn("row_pos", F.col("row_pos") + 10_000_000 + F.col("_c")).drop("_c"))
    hot = raw.unionByName(copies)
    c = dedup.duplicate_count(hot).first()
    assert c.n_rows == n + n // 2 and c.n_distinct == dedup.duplicate_count(raw).first().n_distinct
    assert dedup.duplicate_rows(hot).count() == c.n_in_groups
    kept = dedup.drop_duplicates(hot)
    assert kept.where(F.col("row_pos") >= 10_000_000).count() == 0   # the first copy wins


def test_hot_group_report(spark, skew_conf):
    view = registry._view(spark, SF001).withColumn(
        "doctor", F.when(F.col("patient_id") % 3 == 0, F.lit("hot")).otherwise(F.col("doctor")))
    got = [(r.doctor, r.n_patients) for r in reports.top_groups(view, k=3).collect()]
    seen = {}
    for r in view.select("doctor", "patient_id").collect():   # brute force on the small fixture
        seen.setdefault(r.doctor, set()).add(r.patient_id)
    want = sorted(((d, len(p)) for d, p in seen.items()), key=lambda x: (-x[1], x[0]))[:3]
    assert got == want and "hot" in seen
