"""The three tables as a store that takes one load after another.

A load appends to all three tables or to none: its rows are written under a
folder of their own, which readers see only once its name is in the next
commit file. Ids go on from the largest stored ones, dense and in the order
of the rows; the lookups (name to patient, date to admission) run over the
stored rows and the new ones, so a later row wins over all earlier loads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.operators.dedup import distinct_first, distinct_first_staged
from staylens.operators.dense import dense_ids
from staylens.operators.integrity import split_not_null
from staylens.operators.keys import bounded_broadcast, day_span, last_wins_lookup
from staylens.plans.normalise import Tables, rename_columns
from staylens.schemas import (ADMISSION_ATTRS, ADMISSION_KEYS, ADMISSIONS_SCHEMA, BILLING_ATTRS, BILLING_KEYS,
                              BILLING_SCHEMA, PATIENT_ATTRS, PATIENT_KEYS, PATIENTS_SCHEMA)

SCHEMAS = {"patients": PATIENTS_SCHEMA, "admissions": ADMISSIONS_SCHEMA, "billing": BILLING_SCHEMA}
IDS = {"patients": "patient_id", "admissions": "admission_id", "billing": "billing_id"}


class EncounterStore:
    """`path` is a folder on storage that every node sees."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---------------------------------------------------------------- commits
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def loads(self) -> list[str]:
        """Folders of the committed loads, in order (their number, not their
        rows, reaches the driver). A commit file without a name is not there yet."""
        folder, fs = self._fs(f"{self.path}/commits")
        if not fs.exists(folder):
            return []
        out = []
        for status in sorted(fs.listStatus(folder), key=lambda s: s.getPath().getName()):
            stream = fs.open(status.getPath())
            try:
                name = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if name.endswith("\n"):
                out.append(name.strip())
        return out

    def _commit(self, number: int, load: str) -> None:
        """Fails when another load took the number, which leaves this one unseen."""
        target, fs = self._fs(f"{self.path}/commits/{number:08d}")
        stream = fs.create(target, False)
        try:
            stream.write(bytearray(f"{load}\n".encode()))
        finally:
            stream.close()

    # ---------------------------------------------------------------- tables
    def read(self, table: str, loads: list[str] | None = None) -> DataFrame:
        """Rows of all committed loads of `patients`, `admissions` or `billing`."""
        loads = self.loads() if loads is None else loads
        if not loads:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*(f"{self.path}/loads/{x}/{table}" for x in loads))

    def tables(self) -> Tables:
        loads = self.loads()
        return Tables(*(self.read(t, loads) for t in SCHEMAS))

    def _stage(self, load: str):
        """Writes a table under a load's folder and reads it back."""
        def stage(name: str, df: DataFrame) -> DataFrame:
            path = f"{self.path}/loads/{load}/{name}"
            df.write.mode("overwrite").parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        return stage

    def _numbered(self, table: str, rows: DataFrame, order: str, loads: list[str], load: str) -> DataFrame:
        """The load's rows of a table with their ids, written."""
        last = self.read(table, loads).agg(F.max(IDS[table])).first()[0] or 0
        stage = self._stage(load)
        numbered = dense_ids(rows, order, IDS[table], stage, name=f"{table}-ranged", start=last + 1)
        return stage(table, numbered.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMAS[table].fields)))

    def append(self, clean: DataFrame, on_bad: str = "quarantine") -> Tables:
        """Load a clean table after what is stored, under last-wins keying, and
        commit it. Rows with a NULL key are left out (in the result's
        `quarantine`), or with `on_bad="fail"` stop the load; a load that stops
        anywhere before its commit leaves nothing that readers see. Returns the
        load's own rows."""
        loads, load = self.loads(), uuid.uuid4().hex
        renamed = rename_columns(clean)
        rows, bad = split_not_null(distinct_first(renamed, PATIENT_ATTRS, "_first"), PATIENT_KEYS, on_bad, "patients")
        patients = self._numbered("patients", rows, "_first", loads, load)
        quarantine = {"patients": bad}

        known = self.read("patients", loads).unionByName(patients)
        rows = distinct_first_staged(renamed, ADMISSION_ATTRS, "_first", self._stage(load), "admissions").join(last_wins_lookup(known, "name", "patient_id"), "name", "left")
        rows, quarantine["admissions"] = split_not_null(rows, ADMISSION_KEYS, on_bad, "admissions")
        admissions = self._numbered("admissions", rows, "_first", loads, load)

        known = self.read("admissions", loads).unionByName(admissions)
        by_date = bounded_broadcast(last_wins_lookup(known, "admission_date", "admission_id"), day_span(known, "admission_date"))
        rows = distinct_first(renamed, BILLING_ATTRS, "_first").join(by_date, "admission_date", "left")
        rows, quarantine["billing"] = split_not_null(rows, BILLING_KEYS, on_bad, "billing")
        billing = self._numbered("billing", rows, "_first", loads, load)
        self._commit(len(loads) + 1, load)
        return Tables(patients, admissions, billing, quarantine)


def with_dense_ids(tables: Tables, stage) -> Tables:
    """The tables with ids 1..n in the order of their ids, and foreign keys that follow."""
    new = {t: dense_ids(getattr(tables, t), IDS[t], "_new", stage, name=f"{t}-ranged") for t in SCHEMAS}
    patients, admissions, billing = new["patients"], new["admissions"], new["billing"]
    patient = patients.select("patient_id", F.col("_new").alias("_patient"))
    admission = admissions.select("admission_id", F.col("_new").alias("_admission"))
    admissions = admissions.join(patient, "patient_id").withColumn("patient_id", F.col("_patient"))
    billing = billing.join(admission, "admission_id").withColumn("admission_id", F.col("_admission"))
    out = {"patients": patients, "admissions": admissions, "billing": billing}
    return Tables(*(out[t].withColumn(IDS[t], F.col("_new")).select(*(f.name for f in SCHEMAS[t].fields)) for t in SCHEMAS))
