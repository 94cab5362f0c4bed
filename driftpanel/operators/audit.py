"""Checks of a finished call log against the models' quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from driftpanel.functions.quota import request_interval, token_budget
from driftpanel.operators.ordering import previous_value, trailing_sum

MINUTE_MICROS = 60_000_000


def token_audit(calls: DataFrame, span_micros: int = MINUTE_MICROS) -> DataFrame:
    """Tokens of the last minute at each call, against the derated quota.

    A single call above the whole budget was let through on purpose when nothing
    else was in the window; it has a class of its own.
    """
    summed = trailing_sum(calls, ["model"], "micros", "tokens", "window_tokens", span_micros)
    budget = token_budget(F.col("tpm"))
    verdict = (
        F.when(F.col("window_tokens") <= F.col("budget"), "ok")
        .when(F.col("window_tokens") == F.col("tokens"), "oversized")
        .otherwise("over")
    )
    return summed.withColumn("budget", budget).withColumn("verdict", verdict)


def spacing_audit(calls: DataFrame, order: Sequence[str]) -> DataFrame:
    """Gap to the model's previous call, against its request interval."""
    spaced = previous_value(calls, ["model"], "micros", order, "previous_micros")
    gap = F.col("micros") - F.col("previous_micros")
    return (
        spaced.withColumn("gap_micros", gap)
        .withColumn("interval_seconds", request_interval(F.col("rpm")))
        .withColumn("too_close", F.coalesce(gap < F.col("interval_seconds") * 1_000_000, F.lit(False)))
    )


def attempted(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Marks the batches up to and including the first failure per model.

    The first failure is one aggregate per model; no running window is needed.
    """
    stop = (
        batches.filter("failed").groupBy(*keys).agg(F.min("batch_index").alias("_stop"))
    )
    return (
        batches.join(stop, list(keys), "left")
        .withColumn("attempted", F.col("_stop").isNull() | (F.col("batch_index") <= F.col("_stop")))
        .drop("_stop")
    )
