"""Spark session set-up and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Settings the library is tuned for. On a cluster they come from the job
# submission; `get_session` only fills in what is not already set.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
STATIC_CONF = ("spark.ui.enabled", "spark.ui.showConsoleProgress")


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "staylens", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session.

    `master` and `shuffle_partitions` are for local runs and tests; on a
    cluster leave them unset so the submitted configuration wins.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    wanted = dict(extra or {})
    if shuffle_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in wanted.items():          # asked for by the caller
        builder = builder.config(key, value)
    if SparkSession.getActiveSession() is None:
        submitted = SparkConf()
        for key in STATIC_CONF:                # settings that only a new session takes
            if key not in wanted and not submitted.contains(key):
                builder = builder.config(key, DEFAULT_CONF[key])
    spark = builder.getOrCreate()
    for key, value in DEFAULT_CONF.items():
        if key not in STATIC_CONF and key not in wanted and spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(master: str) -> bool:
    """One machine, one JVM: a local folder is a shared one."""
    return master.startswith("local") and not master.startswith("local-cluster")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder (`spark.checkpoint.dir`).

    The cluster names a shared folder there; it is used as is. When it is
    unset, a scratch folder is made and set on a local master (tests); on any
    other, executors would not share it, so this raises.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # client without a SparkContext: the server's setting rules
        sc = None
    current = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if current:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc is None or not _is_local(sc.master):
        raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="staylens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder (reliable checkpoint).

    The data survive the loss of any executor, unlike a local checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "tables", name)
