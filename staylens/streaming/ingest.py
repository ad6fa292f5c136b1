"""Incremental load of raw encounter files with Structured Streaming.

New raw files in a folder are loaded micro-batch by micro-batch into one
Parquet table of raw rows (typed, missing-value tokens resolved), the way
rows are appended to a table in the batch load:

* each batch gets `row_pos`, dense and going on from the largest stored one,
  so "first"/"last" keep meaning arrival order, whatever the number of read
  partitions or batches;
* duplicate rows are dropped within the batch (first kept) and against the
  rows already stored. The stored table keeps a 64-bit hash of each row;
  the anti join uses the hash as its equi-key and compares every column
  NULL-safely, so a hash collision never drops a row;
* because of that anti join a replayed batch (after a failure between the
  write and the commit of the stream checkpoint) adds nothing twice.

The batch steps that need whole-table statistics (outliers, keys, reports)
run on the loaded table with the batch API.

Cost: the stored table is partitioned by the first bits of the row hash.
A micro-batch reads the hash column of the partitions that its own rows fall
in, and the value columns only of partitions where a hash is met again: none
for a batch of new rows, its own rows' partitions for a replayed one. A batch
with many more rows than partitions still reads the whole hash column (8 bytes
a row), so triggers should carry many files each (`maxFilesPerTrigger` or
`availableNow`). New rows are shuffled once, so a batch adds at most one file
to each partition (`spark.sql.adaptive` may split large ones).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from staylens.operators.dedup import drop_duplicates
from staylens.schemas import NA_TOKENS, RAW_COLUMNS, RAW_TEXT_SCHEMA, ROW_POS
from staylens.sources.files import dense_positions, load_raw

ROW_KEY = "row_key"
#: Partition column of the stored table: the first KEY_BITS bits of the row
#: hash. Fixed with the tables' layout, so that every batch prunes alike.
KEY_PART = "key_part"
KEY_BITS = 8


def raw_file_stream(spark: SparkSession, src_dir: str, schema: T.StructType = RAW_TEXT_SCHEMA,
                    fmt: str = "csv", max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream of raw text rows from files arriving in `src_dir`."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(src_dir)


def _q(name: str):
    return F.col(f"`{name}`")


def load_batch(batch: DataFrame, start: int = 0, columns: Iterable[str] = RAW_COLUMNS,
               tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """One micro-batch of text rows -> raw rows with row_pos (from `start` on,
    dense in read order), row_key and key_part, duplicates inside the batch
    dropped (first kept)."""
    cols = list(columns)
    raw = drop_duplicates(load_raw(dense_positions(batch, ROW_POS, start), tokens), subset=cols)
    keyed = raw.withColumn(ROW_KEY, F.xxhash64(*[_q(c) for c in cols]))
    return keyed.withColumn(KEY_PART, F.shiftrightunsigned(ROW_KEY, 64 - KEY_BITS).cast("int"))


def _parts(rows: DataFrame) -> list[int]:
    """The partitions that rows fall in: at most 2^KEY_BITS numbers."""
    return [r[0] for r in rows.select(KEY_PART).distinct().collect()]


def stored_hashes(loaded: DataFrame, stored: DataFrame) -> DataFrame:
    """The hashes of `stored` met again in `loaded`, read from the partitions
    of `loaded` only."""
    near = stored.where(F.col(KEY_PART).isin(_parts(loaded))).select(KEY_PART, ROW_KEY)
    return near.join(loaded.select(ROW_KEY), ROW_KEY, "left_semi")


def new_rows(loaded: DataFrame, stored: DataFrame | None, columns: Iterable[str] = RAW_COLUMNS) -> DataFrame:
    """Rows of `loaded` not yet in `stored` (hash as join key, every column
    compared NULL-safely). Values are read from the partitions with a hash
    that is met again; a table stored without partitions is read whole."""
    if stored is None:
        return loaded
    if KEY_PART in stored.columns:
        met = _parts(stored_hashes(loaded, stored))
        if not met:
            return loaded
        stored = stored.where(F.col(KEY_PART).isin(met))
    cols = list(columns)
    seen = stored.select(F.col(ROW_KEY).alias("_k"), *[_q(c).alias(f"_s{i}") for i, c in enumerate(cols)])
    cond = [F.col(ROW_KEY) == F.col("_k")] + [_q(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(cols)]
    return loaded.join(seen, cond, "left_anti")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None when nothing is there; other errors rise."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(path)


def append_batch(batch: DataFrame, batch_id: int, table_path: str,
                 columns: Iterable[str] = RAW_COLUMNS) -> None:
    """foreachBatch body: load, drop known rows, append. Positions go on from
    the largest one stored (a maximum from the files' statistics). A batch
    without rows writes nothing; a table stored without partitions goes on
    without them."""
    cols = list(columns)
    stored = _stored(batch.sparkSession, table_path)
    last = stored.agg(F.max(ROW_POS)).first()[0] if stored is not None else None
    loaded = load_batch(batch, 0 if last is None else last + 1, cols).persist()
    try:
        if loaded.isEmpty():
            return
        fresh = new_rows(loaded, stored, cols)
        if stored is None or KEY_PART in stored.columns:
            fresh.repartition(KEY_PART).write.mode("append").partitionBy(KEY_PART).parquet(table_path)
        else:
            fresh.drop(KEY_PART).write.mode("append").parquet(table_path)
    finally:
        loaded.unpersist()


def start_ingest(spark: SparkSession, src_dir: str, table_path: str, checkpoint: str,
                 available_now: bool = True, max_files_per_trigger: int | None = None,
                 schema: T.StructType = RAW_TEXT_SCHEMA) -> StreamingQuery:
    """Start the load. `available_now` processes what is there and stops;
    otherwise it keeps polling for new files. `checkpoint` must be on
    storage every node sees (the stream's progress survives restarts)."""
    columns = [f.name for f in schema.fields]
    writer = (raw_file_stream(spark, src_dir, schema, max_files_per_trigger=max_files_per_trigger)
              .writeStream.foreachBatch(lambda df, bid: append_batch(df, bid, table_path, columns))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
