"""Date functions: parsing, length of stay, month calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens.schemas import DATE_FORMAT, TIMESTAMP_FORMAT


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c: Column | str, fmt: str | tuple[str, ...] = DATE_FORMAT) -> Column:
    """Text -> date; values that do not match the format(s) become NULL.

    With several formats the first that parses wins.
    """
    formats = (fmt,) if isinstance(fmt, str) else tuple(fmt)
    parsed = [F.try_to_date(_col(c), f) for f in formats]
    return parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)


#: Formats tried by `detect_format`, in this order.
KNOWN_FORMATS = ("yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d.M.yyyy", "yyyyMMdd")


def format_number(value: Column, formats: tuple[str, ...] = KNOWN_FORMATS) -> Column:
    """Place (from 1) of the first format that parses the value; NULL if none does."""
    return F.coalesce(*[F.when(F.try_to_date(value, f).isNotNull(), F.lit(i)) for i, f in enumerate(formats, 1)])


def parse_date_as(c: Column | str, number: Column, formats: tuple[str, ...] = KNOWN_FORMATS) -> Column:
    """Text -> date by the format of that place; anything else is NULL."""
    out = F.lit(None).cast("date")
    for i, f in reversed(list(enumerate(formats, 1))):
        out = F.when(number == i, F.try_to_date(_col(c), f)).otherwise(out)
    return out


def parse_timestamp(c: Column | str, fmt: str = TIMESTAMP_FORMAT) -> Column:
    """Text -> timestamp; values that do not match the format become NULL."""
    return F.try_to_timestamp(_col(c), F.lit(fmt))


def stay_days(discharge: Column | str, admission: Column | str, timestamps: bool = False) -> Column:
    """Whole days from admission to discharge, truncated toward zero.

    Dates: a plain day difference. Timestamps: elapsed time in days,
    truncated, so twelve hours is 0 and minus a day and a half is -1
    (`datediff` would count calendar days instead). May be negative; there
    is no check that discharge follows admission.
    """
    d, a = _col(discharge), _col(admission)
    if not timestamps:
        return F.datediff(d, a)
    micros = F.unix_micros(d.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return (micros / F.lit(86_400_000_000.0)).cast("int")


def month_end(c: Column | str) -> Column:
    """Calendar month end of a date (the bucket of a monthly series)."""
    return F.last_day(_col(c))


def month_index(c: Column | str) -> Column:
    """Months since year 0: consecutive months differ by exactly 1."""
    col = _col(c)
    return F.year(col) * 12 + F.month(col) - 1
