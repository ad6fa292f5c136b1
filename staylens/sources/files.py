"""Scans and sinks: raw CSV, tables, row order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.functions.text import with_null_tokens
from staylens.operators.keys import bounded_broadcast
from staylens.schemas import NA_TOKENS, RAW_TEXT_SCHEMA, RAW_TYPES, ROW_POS


def with_row_pos(df: DataFrame, order_cols: Iterable[str] | None = None, name: str = ROW_POS) -> DataFrame:
    """Add a long `row_pos` that follows file order ("first"/"last" rules use it).

    * `order_cols`: the data carry their own order (e.g. an ingest sequence).
      One long column is used as is; several columns are sorted on and the
      sorted rows get increasing ids.
    * one input file: `monotonically_increasing_id()` right after the scan
      grows with the file offset (splits of one file are numbered in order).
    * several files: each input split (file, start offset) is counted, the
      splits are ordered by file and offset, and every row gets its split's
      running offset plus its place inside the split: dense positions in file
      order. The file is scanned twice (count, read); the table of splits is
      broadcast behind its bound (files plus read partitions), so the rows are
      neither sorted nor shuffled.
    """
    if order_cols:
        cols = list(order_cols)
        if len(cols) == 1 and isinstance(df.schema[cols[0]].dataType, T.LongType):
            return df.withColumn(name, F.col(cols[0]))
        return df.orderBy(*cols).withColumn(name, F.monotonically_increasing_id())
    n_files = _n_input_files(df)
    if n_files is not None and n_files <= 1:
        return df.withColumn(name, F.monotonically_increasing_id())
    return _number_by_split(df, name, n_files)


def _n_input_files(df: DataFrame) -> int | None:
    """Number of files under a scan, counted in the JVM (no path comes to Python)."""
    try:
        return len(df._jdf.inputFiles())
    except Exception:  # a client without the JVM frame: not known
        return None


def _number_by_split(df: DataFrame, name: str, n_files: int | None = None) -> DataFrame:
    meta = df.select("*", F.col("_metadata.file_path").alias("_fp"),
                     F.col("_metadata.file_block_start").alias("_fb"),
                     F.monotonically_increasing_id().alias("_id"))
    # one row per input split; the running sum is over splits, not rows
    splits = meta.groupBy("_fp", "_fb").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_id0"))
    before = Window.orderBy("_fp", "_fb").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # every file's splits but its last fill a read partition: no more splits than files and partitions
    bound = n_files + df.rdd.getNumPartitions() if n_files is not None else None
    offsets = bounded_broadcast(splits.select("_fp", "_fb", "_off", "_id0"), bound)
    return (meta.join(offsets, ["_fp", "_fb"])
            .withColumn(name, F.col("_off") + F.col("_id") - F.col("_id0"))
            .drop("_fp", "_fb", "_id", "_off", "_id0"))


def dense_positions(df: DataFrame, name: str = ROW_POS, start: int = 0) -> DataFrame:
    """Number the rows start, start + 1, ... in read order: place in the read
    partition plus the rows of the partitions before (one row per partition)."""
    ids = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    sizes = ids.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (ids.join(bounded_broadcast(offsets, df.rdd.getNumPartitions()), "_part")
            .withColumn(name, F.lit(start).cast("long") + F.col("_off") + place).drop("_id", "_part", "_off"))


def type_raw(df: DataFrame, types: Mapping[str, T.DataType] = RAW_TYPES) -> DataFrame:
    """Cast the numeric text columns; text that is not a number becomes NULL
    (`failed_casts` counts such values apart from missing ones)."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in types.items() if c in df.columns})


def load_raw(text: DataFrame, tokens: Iterable[str] = NA_TOKENS,
             types: Mapping[str, T.DataType] = RAW_TYPES) -> DataFrame:
    """Text table as read from the file -> raw table: missing-value tokens
    become NULL, then numeric columns are typed (token handling first, so
    `NA` in a number column is a missing value, not a bad number)."""
    text_cols = [c for c in text.columns if c != ROW_POS]
    return type_raw(with_null_tokens(text, text_cols, tokens), types)


def failed_casts(text: DataFrame, tokens: Iterable[str] = NA_TOKENS,
                 types: Mapping[str, T.DataType] = RAW_TYPES) -> DataFrame:
    """Per typed column: values that are missing, and values that are there but
    not of the type (loaded as NULL too): column_name, n_missing, n_bad."""
    cols = [c for c in types if c in text.columns]
    known = with_null_tokens(text, cols, tokens)
    counts = known.agg(*[F.struct(F.count_if(F.col(f"`{c}`").isNull()).alias("n_missing"),
                                  F.count_if(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(types[c]).isNull()).alias("n_bad"))
                         .alias(f"_c{i}") for i, c in enumerate(cols)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_c{i}.n_missing").alias("n_missing"),
                                                     F.col(f"_c{i}.n_bad").alias("n_bad")) for i, c in enumerate(cols)])))


def _csv_lines(spark: SparkSession, path: str, required: Iterable[str], multi_line: bool) -> tuple[DataFrame, list[str]]:
    """All lines as text columns named by the header, and the line itself in
    `_line` where its number of fields is not the header's."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    names = reader.csv(path).columns                     # reads the header only
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _LINE]])
    lines = (reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _LINE)
             .option("columnPruning", False).csv(path))
    return lines, names


_LINE = "_line"


def _too_long(names: list[str]):
    """Does the line have more fields than the header? (Separators outside quotes.)
    Spark refuses scans of the line alone, so the first field is looked at too."""
    outside = F.regexp_replace(F.col(_LINE), '"[^"]*"', "")
    scanned = F.coalesce(F.length(F.col(f"`{names[0]}`")), F.lit(0)) >= 0
    return scanned & F.coalesce(F.size(F.split(outside, ",", -1)) > len(names), F.lit(False))


def malformed_lines(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Lines with more fields than the header, as they stand in the file: line."""
    lines, names = _csv_lines(spark, path, (), multi_line)
    return lines.where(_too_long(names)).select(F.col(_LINE).alias("line"))


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_TEXT_SCHEMA,
                 tokens: Iterable[str] = NA_TOKENS, order_cols: Iterable[str] | None = None,
                 multi_line: bool = False, on_malformed: str = "fail") -> DataFrame:
    """Raw encounter CSV (header line) -> raw table with `row_pos`.

    Columns are taken by the header's names, in any order; those of `schema`
    must be there, others are kept as text after them (and count in the
    full-row dedup). All fields are read as text (no inference pass over the
    data), numbered in file order, then loaded with `load_raw`.

    Quotes inside quoted fields are doubled. `multi_line` also reads quoted
    line breaks; a file is then one split. A line with too few fields ends in
    NULLs; one with too many stops the read, or with
    `on_malformed="quarantine"` is left to `malformed_lines`.
    """
    if on_malformed not in ("fail", "quarantine"):
        raise ValueError(f"on_malformed must be 'fail' or 'quarantine', not {on_malformed!r}")
    lines, names = _csv_lines(spark, path, [f.name for f in schema.fields], multi_line)
    known = [f.name for f in schema.fields]
    numbered = with_row_pos(lines, order_cols)
    bad = _too_long(names)
    if on_malformed == "fail":
        numbered = numbered.where(F.when(bad, F.raise_error(F.concat(F.lit("more fields than the header: "), F.col(_LINE))).cast("boolean"))
                                  .otherwise(F.lit(True)))
    else:
        numbered = numbered.where(~bad)
    columns = [*known, *(c for c in names if c not in known), ROW_POS]
    return load_raw(numbered.select(*[F.col(f"`{c}`") for c in columns]), tokens)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Re-scan of a written table (column pruning and filters reach the scan)."""
    return spark.read.format(fmt).load(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: Iterable[str] | None = None) -> str:
    """Write a table. `overwrite` by default, so a re-run is idempotent;
    `append` adds rows like an insert."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":    # fields as they are: blanks kept, quotes doubled
        writer = (writer.option("header", True).option("escape", '"')
                  .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def save_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Cleaned table as CSV with a header line (a folder of part files)."""
    return write_table(df, path, mode=mode, fmt="csv")


def create_tables(spark: SparkSession, tables: Mapping[str, T.StructType], location: str | None = None,
                  database: str | None = None) -> list[str]:
    """Create empty Parquet tables if they do not exist (fixed schemas).

    NOT NULL columns are kept in the schema; rows are checked before they
    are written (`split_not_null`), since file tables do not enforce it.
    """
    made = []
    for name, schema in tables.items():
        full = f"{database}.{name}" if database else name
        if not spark.catalog.tableExists(full):
            kwargs = {"path": f"{location}/{name}"} if location else {}
            spark.catalog.createTable(full, source="parquet", schema=schema, **kwargs)
        made.append(full)
    return made


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> str:
    """Write into a catalog table (`append` adds rows, `overwrite` replaces)."""
    df.write.mode(mode).format("parquet").saveAsTable(name)
    return name


def key_scan(spark: SparkSession, table: str, columns: Iterable[str]) -> DataFrame:
    """Two-column key scan of a table; only these columns are read."""
    return spark.table(table).select(*columns)
