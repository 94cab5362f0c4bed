"""Pay ranges in board payloads."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Interval labels of one board and their plain names. Fixed values.
PAY_PERIODS = {
    "per-year-salary": "year",
    "per-month-salary": "month",
    "per-hour-wage": "hour",
}


def pay_period(interval: Column) -> Column:
    """Plain name of a pay interval; an unknown one stays as it is."""
    named = interval
    for label, plain in PAY_PERIODS.items():
        named = F.when(interval == label, plain).otherwise(named)
    return named


def salary(ranges: Column) -> Column:
    """First range with an amount, in whole currency; zeros where there is none."""
    paid = F.filter(ranges, lambda r: (r["min_cents"] > 0) | (r["max_cents"] > 0))
    first = F.try_element_at(paid, F.lit(1))
    return F.struct(
        F.coalesce(first["min_cents"] / 100, F.lit(0.0)).alias("min_salary"),
        F.coalesce(first["max_cents"] / 100, F.lit(0.0)).alias("max_salary"),
        F.coalesce(first["currency_type"], F.lit("")).alias("currency"),
        F.coalesce(first["interval"], F.lit("")).alias("period"),
    )
