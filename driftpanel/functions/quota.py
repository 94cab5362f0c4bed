"""Token and request quotas, call outcomes and error classes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the rate model.
DERATE = 0.75
BASE_TOKENS = 3000.0
BYTES_PER_TOKEN = 1.75
RETRYABLE_STATUS = (500, 502, 503, 504)


def token_budget(tpm: Column) -> Column:
    return F.floor(tpm * F.lit(DERATE)).cast("bigint")


def request_interval(rpm: Column) -> Column:
    """Seconds between requests, rounded up; null without a request quota."""
    return F.when(rpm > 0, F.ceil(F.lit(60.0) / (rpm * F.lit(DERATE))).cast("bigint"))


def token_estimate(description_bytes: Column) -> Column:
    return F.lit(BASE_TOKENS) + description_bytes / F.lit(BYTES_PER_TOKEN)


def estimate_ratio(estimate: Column, actual: Column) -> Column:
    return F.when(actual > 0, estimate / actual)


def batch_outcome(failed: Column, parsed: Column, sent: Column) -> Column:
    return F.when(failed, "failed").when(parsed < sent, "partial").otherwise("ok")


def error_class(status: Column, kind: Column) -> Column:
    """Short name of a failure; an HTTP status wins over the kind of error."""
    return (
        F.when(status.isNull() & kind.isNull(), "")
        .when(status >= 500, "http_5xx")
        .when(status >= 400, "http_4xx")
        .when(status.isNotNull(), "http_other")
        .when(kind.isin("timeout", "canceled"), kind)
        .otherwise("unknown")
    )


def is_retryable(status: Column) -> Column:
    """Only some server errors; a 429 is final."""
    return F.coalesce(status.isin(*RETRYABLE_STATUS), F.lit(False))
