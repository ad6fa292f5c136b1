"""Scalar functions on hand-written values (FIXTURES section 3)."""

import datetime as dt

from pyspark.sql import functions as F

from staylens.functions import dates, labels, numeric, text
from staylens.schemas import NA_TOKENS


def test_null_tokens(spark):
    # A,1.5,None / ,NA, / B,nan,N/A -> missing per column 1, 2, 3
    df = spark.createDataFrame([("A", "1.5", "None"), ("", "NA", ""), ("B", "nan", "N/A")], "a string, b string, c string")
    out = text.with_null_tokens(df)
    counts = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in "abc"]).first()
    assert (counts.a, counts.b, counts.c) == (1, 2, 3)


def test_every_token_is_missing(spark):
    df = spark.createDataFrame([(t,) for t in NA_TOKENS] + [("x",), (" NA",)], "v string")
    got = [r.v for r in text.with_null_tokens(df).collect()]
    assert got[: len(NA_TOKENS)] == [None] * len(NA_TOKENS)
    assert got[-2:] == ["x", " NA"]  # exact match unless trim=True
    trimmed = [r.v for r in text.with_null_tokens(df, trim=True).collect()]
    assert trimmed[-1] is None


def test_title_case(spark):
    # Capitalise after any non-letter, like Python's str.title()
    cases = ["o'BRIEN mary-jane", "DR. aNN 3rd x2y", "don't", "élan ünal", "", None]
    df = spark.createDataFrame([(c,) for c in cases], "v string")
    got = [r.t for r in df.select(text.title_case("v").alias("t")).collect()]
    assert got == ["O'Brien Mary-Jane", "Dr. Ann 3Rd X2Y", "Don'T", "Élan Ünal", "", None]
    assert got[:4] == [c.title() for c in cases[:4]]


def test_parse_date(spark):
    # S3: one explicit format; everything else becomes NULL, no error
    vals = ["2024-01-31", "01/02/2024", "bad", None, "2024-02-30", "2024-01-31 10:00:00"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.d for r in df.select(dates.parse_date("v").alias("d")).collect()]
    assert got == [dt.date(2024, 1, 31), None, None, None, None, None]
    two = [r.d for r in df.select(dates.parse_date("v", ("yyyy-MM-dd", "MM/dd/yyyy")).alias("d")).collect()]
    assert two[:2] == [dt.date(2024, 1, 31), dt.date(2024, 1, 2)]


def test_round_half_even(spark):
    # 2.345 -> 2.35, 0.125 -> 0.12, 2.675 -> 2.68 (array-library rounding)
    df = spark.createDataFrame([(2.345,), (0.125,), (2.675,)], "x double")
    got = [r.y for r in df.select(numeric.round_half_even("x", 2).alias("y")).collect()]
    assert got == [2.35, 0.12, 2.68]


def test_labels(spark):
    # 3.25 -> '+3.2%'; 25539.316 -> '$25,539.32'; 1500 -> '1,500'
    df = spark.createDataFrame([(3.25, 25539.316, 1500, 15.6086)], "g double, m double, n long, s double")
    r = df.select(labels.signed_pct("g").alias("g"), labels.money("m").alias("m"),
                  labels.thousands("n").alias("n"), labels.fixed("s", 1, " days").alias("s"),
                  labels.count_label("n").alias("c"), labels.rate_label(F.lit(0.007)).alias("r")).first()
    assert (r.g, r.m, r.n, r.s, r.c, r.r) == ("+3.2%", "$25,539.32", "1,500", "15.6 days", "1500 patients", "0.7%/yr")


def test_stay_days(spark):
    # Whole days, truncated toward zero; may be negative
    df = spark.createDataFrame([(dt.date(2024, 1, 31), dt.date(2024, 2, 2))], "a date, d date")
    assert df.select(dates.stay_days("d", "a").alias("s")).first().s == 2
    ts = spark.createDataFrame([
        (dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 2, 0)),
        (dt.datetime(2024, 1, 3, 12), dt.datetime(2024, 1, 2, 0)),
    ], "a timestamp, d timestamp")
    got = [r.s for r in ts.select(dates.stay_days("d", "a", timestamps=True).alias("s")).collect()]
    assert got == [0, -1]


def test_pct_change_zero_base(spark):
    df = spark.createDataFrame([(110.0, 100.0), (1.0, 0.0)], "p double, c double")
    got = [r.g for r in df.select(numeric.pct_change("p", "c").alias("g")).collect()]
    assert got == [(110.0 - 100.0) / 100.0 * 100.0, None]


def test_labels_round_the_exact_value(spark):
    values = [0.35, 15.65, 1.05, -0.04, 0.0, 2.5, -3.25, 1234.5678]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    for r in df.select("i", "v", labels.fixed("v", 1).alias("f"), labels.signed_pct("v").alias("p")).collect():
        assert r.f == f"{r.v:.1f}" and r.p == f"{r.v:+.1f}%", r


def test_title_case_of_mixed_scripts(spark):
    words = ["日abc DEF", "שabc", "o'BRIEN", "ǅX ß-a", "3rd"]
    from staylens.functions.text import title_case
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(title_case("w")).collect()]
    assert got[0] == "日Abc Def" and got[1] == "שAbc" and got[2] == "O'Brien" and got[4] == "3Rd"


def test_dates_without_leading_zeros(spark):
    from staylens.functions.dates import parse_date
    df = spark.createDataFrame([("2024-1-5",), ("2024-01-31",), ("2024-02-30",), ("2024-01-05 10:00",), ("x",)], "t string")
    assert [str(r[0]) for r in df.select(parse_date("t")).collect()] == ["2024-01-05", "2024-01-31", "None", "None", "None"]
