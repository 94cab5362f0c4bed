"""Dates and epochs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Epoch seconds of 0001-01-01T00:00:00Z, which stands for "no usable date".
NO_DATE_EPOCH = -62135596800

# Full date, 'T', full time, optional fraction, and an offset that must be there.
_RFC3339 = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:[.,]\d+)?(?:Z|([+-])(\d{2}):(\d{2}))$"


def rfc3339_epoch(text: Column) -> Column:
    """Epoch seconds, or ``NO_DATE_EPOCH`` where the text is not RFC 3339."""

    def part(group: int) -> Column:
        return F.regexp_extract(text, _RFC3339, group)

    def number(group: int) -> Column:
        return F.coalesce(part(group).try_cast("int"), F.lit(0))

    local = F.unix_seconds(F.try_to_timestamp(F.concat(part(1), F.lit("Z"))))
    offset = (number(3) * 3600 + number(4) * 60) * F.when(part(2) == "-", -1).otherwise(1)
    return F.coalesce(
        F.when(text.rlike(_RFC3339), local - offset), F.lit(NO_DATE_EPOCH)
    ).cast("bigint")


def millis_to_epoch(millis: Column) -> Column:
    """Rounds towards the past, also before 1970; exact on the whole bigint range."""
    return F.call_function("div", millis - F.pmod(millis, F.lit(1000)), F.lit(1000))


def epoch_date(seconds: Column) -> Column:
    """UTC calendar day as ``yyyy-MM-dd``, whatever the session's time zone."""
    days = F.floor(seconds / 86400).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")


def epoch_micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))
