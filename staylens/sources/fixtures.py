"""Raw encounter table derived from the driver's order tables.

The driver's tables are clean, so the derivation adds the dirt the cleaning
steps exist for (duplicates, unparseable dates, missing values, outliers,
mixed-case names). One row per order, k = o_orderkey:

    orders JOIN customer (o_custkey) JOIN nation (c_nationkey)
           JOIN supplier (s_suppkey = k % count(supplier))

plus one extra copy of every row with k % 100 = 7. Everything is a column
expression on those joins, so the table grows with the order table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.schemas import RAW_COLUMNS, ROW_POS
from staylens.sources.files import load_raw


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(value: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(words[-1])
    for i in range(len(words) - 2, -1, -1):
        out = F.when(value == i, F.lit(words[i])).otherwise(out)
    return out


# Fixed values of the two profiled-only columns.
MEDICATIONS = ("Aspirin", "Ibuprofen", "Lipitor", "Paracetamol", "Penicillin")
TEST_RESULTS = ("Normal", "Abnormal", "Inconclusive")


def raw_encounters_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as text, the way a CSV file holds it, plus `row_pos`."""
    orders = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n_supplier = supplier.agg(F.count(F.lit(1))).scalar()

    k = F.col("o_orderkey")
    rows = (orders
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .withColumn("_supp", k % n_supplier)
            .join(supplier, F.col("_supp") == F.col("s_suppkey"))
            # the duplicate copy: a generator, not a join
            .withColumn("dup", F.explode(F.when(k % 100 == 7, F.array(F.lit(0), F.lit(1)))
                                          .otherwise(F.array(F.lit(0))))))

    order_day = F.to_date(F.col("o_orderdate"))
    base_name = F.concat(F.lit("pat o'neil-"), F.substring(F.col("c_name"), 10, 1 << 20))
    cols = {
        "Name": F.when(k % 3 == 0, F.upper(base_name)).otherwise(F.lower(base_name)),
        "Gender": F.when(F.col("o_custkey") % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")),
        "Blood Type": F.when(k % 61 == 0, F.lit(None).cast("string"))
                       .otherwise((F.col("o_custkey") % 8).cast("string")),
        "Medical Condition": F.when(k % 50 == 0, F.lit("OTHER")).otherwise(F.col("c_mktsegment")),
        "Date of Admission": F.when(k % 97 == 0, F.lit("not a date"))
                              .when(k % 53 == 0, F.lit(""))
                              .otherwise(F.date_format(order_day, "yyyy-MM-dd")),
        "Doctor": F.col("s_name"),
        "Hospital": F.col("n_name"),
        "Insurance Provider": F.col("o_orderstatus"),
        "Billing Amount": F.format_string(
            "%.2f", F.when(k % 500 == 1, F.col("o_totalprice") * 20).otherwise(F.col("o_totalprice"))),
        "Room Number": (k % 400 + 101).cast("string"),
        "Admission Type": F.col("o_orderpriority"),
        "Discharge Date": F.when(k % 89 == 0, F.lit(None).cast("string"))
                           .otherwise(F.date_format(F.date_add(order_day, (k % 30 + 1).cast("int")), "yyyy-MM-dd")),
        "Medication": F.when(k % 73 == 0, F.lit("None")).otherwise(_pick(F.col("o_custkey") % 5, MEDICATIONS)),
        "Test Results": F.when(k % 71 == 0, F.lit("NA")).otherwise(_pick(k % 3, TEST_RESULTS)),
    }
    out = rows.select(*[cols[c].alias(c) for c in RAW_COLUMNS], (k * 2 + F.col("dup")).alias(ROW_POS))
    # A small order table is one split (one task for every later scan of
    # the derived table); spread it over the cores. Inputs that already have
    # at least that many splits keep their layout: no shuffle at scale.
    try:
        cores = spark.sparkContext.defaultParallelism
        splits = orders.rdd.getNumPartitions()
    except Exception:  # no SparkContext on this client: keep the layout
        return out
    if splits < cores:
        out = out.repartition(cores, ROW_POS)
    return out


def dirtier(text: DataFrame) -> DataFrame:
    """The same table with dirt that the plain one has not: NULL names, genders,
    conditions and doctors, names that start with a letter without case, dates
    without leading zeros, and a month (July 1995) without admissions."""
    k = F.floor(F.col(ROW_POS) / 2)
    null = F.lit(None).cast("string")
    short = lambda c: F.when(k % 41 == 0, F.replace(F.col(f"`{c}`"), F.lit("-0"), F.lit("-"))).otherwise(F.col(f"`{c}`"))
    return text.withColumns({
        "Name": F.when(k % 211 == 0, null).when(k % 37 == 0, F.concat(F.lit("日"), F.col("Name"))).otherwise(F.col("Name")),
        "Gender": F.when(k % 31 == 0, null).otherwise(F.col("Gender")),
        "Medical Condition": F.when(k % 47 == 0, null).otherwise(F.col("`Medical Condition`")),
        "Doctor": F.when(k % 29 == 0, null).otherwise(F.col("Doctor")),
        "Date of Admission": F.when(F.col("`Date of Admission`").startswith("1995-07"), null).otherwise(short("Date of Admission")),
        "Discharge Date": short("Discharge Date"),
    })


def raw_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table as loaded: tokens -> NULL, numbers typed, `row_pos` kept."""
    return load_raw(raw_encounters_text(spark, sf_dir))


def with_age(df: DataFrame, name: str = "Name") -> DataFrame:
    """An `Age` column: one age for each customer number in the name, none for
    every 17th customer."""
    number = F.regexp_extract(F.col(f"`{name}`"), "([0-9]+)$", 1).try_cast("int")
    return df.withColumn("Age", F.when(number % 17 != 0, number % 73 + 18))


def with_times(text: DataFrame) -> DataFrame:
    """The two dates with a time of day; of every 19th order the discharge comes
    a day and a half before the admission."""
    k = F.floor(F.col(ROW_POS) / 2)
    admit, leave = F.col("`Date of Admission`"), F.col("`Discharge Date`")
    admitted = F.concat(admit, F.format_string(" %02d:%02d:00", (k % 24).cast("int"), (k % 60).cast("int")))
    left = F.concat(leave, F.format_string(" %02d:30:00", (k * 7 % 24).cast("int")))
    before = F.date_format(F.try_to_timestamp(admitted, F.lit("yyyy-MM-dd HH:mm:ss")) - F.expr("INTERVAL 36 HOURS"), "yyyy-MM-dd HH:mm:ss")
    dated = F.try_to_date(admit, "yyyy-MM-dd").isNotNull()
    return text.withColumns({"Date of Admission": F.when(dated, admitted).otherwise(admit),
                             "Discharge Date": F.when((k % 19 == 0) & dated, before).otherwise(left)})


def other_dates(text: DataFrame) -> DataFrame:
    """Admission dates of which the first, and most others, are written day first."""
    k = F.floor(F.col(ROW_POS) / 2)
    admit = F.col("`Date of Admission`")
    day = F.try_to_date(admit, "yyyy-MM-dd")
    return text.withColumn("Date of Admission", F.when(day.isNotNull() & (k % 5 != 2), F.date_format(day, "d/M/yyyy")).otherwise(admit))


def orphaned(billing: DataFrame) -> DataFrame:
    """Bills of which every 13th points to an admission that is not there, and
    every 31st to none."""
    k = F.floor(F.col("billing_id") / 2)
    return billing.withColumn("admission_id", F.when(k % 31 == 0, F.lit(None).cast("bigint"))
                              .when(k % 13 == 0, F.col("admission_id") * 2 + 1_000_001).otherwise(F.col("admission_id")))
