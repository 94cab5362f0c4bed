"""Batch size of the day."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Sizes under test. Fixed values.
SWEEP_SIZES = (1, 2, 3, 5, 10)


def day_index(start: Column, now: Column) -> Column:
    """Calendar days between two UTC moments."""
    return F.datediff(F.to_date(now), F.to_date(start))


def batch_size_of_day(day: Column) -> Column:
    """Every size once per five days, alternating small and large.

    Each five-day cycle starts one size further on, so over thirty days each
    size falls on six days.
    """
    n = len(SWEEP_SIZES)
    day = F.greatest(F.coalesce(day, F.lit(0)), F.lit(0))
    cycle = F.floor(day / n) % n
    place = day % n
    half = F.floor(place / 2)
    from_ends = F.when(place % 2 == 0, half).otherwise(n - 1 - half)
    slot = ((from_ends + cycle) % n + 1).cast("int")
    return F.element_at(F.array(*[F.lit(size) for size in SWEEP_SIZES]), slot)


def batch_size(day: Column, override: Column) -> Column:
    """An explicit size wins over the sweep."""
    return F.coalesce(override.cast("int"), batch_size_of_day(day))
