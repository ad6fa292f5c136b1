"""Materialised intermediate tables.

The clean table, the three normalised tables and the encounter view are
read by many reports. Recomputing them inside every report repeats the
dedup, the statistics and the joins; instead each is written once as
Parquet under the shared checkpoint folder (`spark.checkpoint.dir`) and
read back, so later scans get column pruning and filter pushdown, and the
data survive the loss of any executor. Tables are keyed by Spark
application and a caller-given key (e.g. source folder, `source_mark` of its
files, stage name), so a changed source is not answered from an old table.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from staylens.session import scratch_path

_TABLES: dict[tuple[str, str], str] = {}
_FRAMES: dict[tuple[str, str], object] = {}
_LOCK = threading.RLock()  # re-entrant: building a view materialises its tables


def _app_id(spark: SparkSession) -> str:
    return spark.conf.get("spark.app.id", None) or spark.sparkContext.applicationId


def materialised(spark: SparkSession, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Parquet copy of `build()` for this application, written on first use."""
    app = _app_id(spark)
    slot = (app, key)
    with _LOCK:
        path = _TABLES.get(slot)
        if path is None:
            digest = hashlib.sha1(key.encode()).hexdigest()[:16]
            path = scratch_path(spark, f"{app}/{digest}")
            build().write.mode("overwrite").parquet(path)
            _TABLES[slot] = path
            _FRAMES[slot] = spark.read.parquet(path)
        return _FRAMES[slot]


def remembered(spark: SparkSession, key: str, build: Callable[[], object]) -> object:
    """The same (immutable) DataFrame, or bundle of them, for a key within
    an application: plans that every report starts from are built once."""
    slot = (_app_id(spark), key)
    with _LOCK:
        if slot not in _FRAMES:
            _FRAMES[slot] = build()
        return _FRAMES[slot]


def source_mark(spark: SparkSession, paths: Iterable[str]) -> str:
    """A short text that changes when a file under the paths does (names,
    lengths, modification times), for the key of a table made from them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = hashlib.sha1()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        files = fs.listFiles(p, True) if fs.exists(p) else None
        for line in sorted(_files(files)):
            seen.update(line.encode())
    return seen.hexdigest()[:16]


def _files(files):
    while files is not None and files.hasNext():
        f = files.next()
        yield f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}\n"


def forget(spark: SparkSession | None = None, keys=None, delete_files: bool = False) -> None:
    """Drop the bookkeeping of this application's tables (the given `keys`,
    or all; without a session, everything). With `delete_files`, also delete
    them through the Hadoop FileSystem API (HDFS, object stores, local): the
    listed tables, or the application's whole table folder."""
    with _LOCK:
        if spark is None:
            _TABLES.clear()
            _FRAMES.clear()
            return
        app = _app_id(spark)
        for slot in [s for s in _FRAMES if s[0] == app and (keys is None or s[1] in keys)]:
            del _FRAMES[slot]
        slots = [s for s in _TABLES if s[0] == app and (keys is None or s[1] in keys)]
        paths = [_TABLES.pop(s) for s in slots]
        if delete_files:
            targets = [scratch_path(spark, app)] if keys is None else paths
            jvm = spark.sparkContext._jvm
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            for target in targets:
                path = jvm.org.apache.hadoop.fs.Path(target)
                path.getFileSystem(conf).delete(path, True)


def stage_to(folder: str) -> Callable[[str, DataFrame], DataFrame]:
    """A `stage` hook for `cleaning_stages` / `normalise`: write each table
    as Parquet under `folder` (on storage every node sees) and read it back,
    so later steps scan it instead of recomputing it."""
    def stage(name: str, df: DataFrame) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)
    return stage
