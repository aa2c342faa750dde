"""Calendar expressions per granularity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted date formats, day first.
DATE_FORMATS = ("dd-MM-yyyy", "dd.MM.yyyy", "dd/MM/yyyy", "yyyy-MM-dd")
REPORT_FORMAT = "dd-MM-yyyy"


def parse_day_first(text: Column) -> Column:
    return F.coalesce(*[F.try_to_date(F.trim(text), fmt) for fmt in DATE_FORMATS])


def report_date(ds: Column) -> Column:
    return F.date_format(ds, REPORT_FORMAT)


def add_periods(ds: Column, n: Column, gran: str) -> Column:
    """``ds`` moved by ``n`` periods on the Gregorian calendar."""
    n = n.cast("int")
    if gran == "month":
        return F.add_months(ds, n)
    return F.date_add(ds, n * 7 if gran == "week" else n)


def step(gran: str) -> Column:
    return F.expr({"month": "interval 1 month", "week": "interval 7 day", "day": "interval 1 day"}[gran])


def period_sequence(first: Column, last: Column, gran: str) -> Column:
    return F.sequence(first, last, step(gran))
