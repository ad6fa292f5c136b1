"""Intermediate tables, files and Arrow batches shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.session import ensure_checkpoint_dir

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows per Arrow batch unless the session names its own number: texts are
#: a few kB each, so a batch stays near 1 MB and long ones near 100 MB.
DEFAULT_BATCH_ROWS = 500


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table or file set, in the shared
    folder that the cluster names in spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors, and later reads prune columns."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `written` that no later step reads."""
    for t in tables:
        spark, path = t.sparkSession, t._written_at
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of long texts, unless the session sets a bound."""
    if spark.conf.get(BATCH_ROWS, None) in (None, "10000"):
        spark.conf.set(BATCH_ROWS, str(DEFAULT_BATCH_ROWS))


def tidy(run):
    """A mapInArrow function that gives its freed memory back at the end of a
    task: workers are used again by later stages, which count it otherwise."""
    def then_release(batches):
        yield from run(batches)
        import ctypes
        import gc

        import pyarrow as pa
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc has it
        if trim is not None:
            trim(0)
    return then_release


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, want: str) -> str:
    """`want`, with underscores added until no column of `df` has that name."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want += "_"
    return want


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """`df` with columns named c0, c1, ... (for tasks that take any name: dotted,
    repeated, clashing), and what the named ones are called there."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), [f"c{df.columns.index(n)}" for n in names]


def col(name: str):
    """A column by its exact name (dots and backquotes included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def open_fs(path: str):
    """(file system, path in it) of a shared path, for a task or the driver."""
    import pyarrow.fs as pafs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path[len("file:"):]
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path
