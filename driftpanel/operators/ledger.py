"""The append-only ledger of calls and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

RUN_KIND = "main"
CALL_FACTS = (
    "deployment", "temperature_sent", "input_uncached", "cached_read", "cache_write",
    "output_tokens", "reasoning_tokens", "usage_raw",
)
IDENTITY = ("contributor_id", "resume_id", "config_id", "instructions_version")


def call_id(*key: str) -> Column:
    """The same call gets the same id on every attempt."""
    return F.md5(F.concat_ws("|", *[F.col(name).cast("string") for name in key]))


def rebuild_calls(events: DataFrame, key: Sequence[str], position: str,
                  facts: Sequence[str] = CALL_FACTS) -> DataFrame:
    """One row per call; its facts are those of its first event.

    ``batch_size`` counts the events kept, not the postings sent.
    """
    first = F.min_by(F.struct(*facts), F.col(position)).alias("first")
    return (
        events.groupBy(*key)
        .agg(F.count("*").alias("batch_size"), first)
        .select(*key, call_id(*key).alias("call_id"), "batch_size", "first.*",
                F.lit(RUN_KIND).alias("run_kind"))
    )


def event_rows(events: DataFrame, key: Sequence[str], position: str) -> DataFrame:
    """Ledger events; an empty text means there is none."""
    identified = events.withColumn("call_id", call_id(*key))
    return identified.select(
        F.md5(F.concat_ws("|", "call_id", F.col(position).cast("string"))).alias("event_id"),
        "call_id", "composite_key", "emitted_score", "ev_score",
        F.nullif(F.col("reasoning"), F.lit("")).alias("reasoning"),
        "raw", F.nullif(F.col("logprobs"), F.lit("")).alias("logprobs"),
    )


def append_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Writes one run's partition; a repeated attempt replaces only that run."""
    (
        rows.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id").parquet(path)
    )


def rows_per_model(events: DataFrame, persisted: Column) -> DataFrame:
    """Events expected and actually stored, per model."""
    return events.groupBy("model").agg(
        F.count("*").alias("expected"), F.count_if(persisted).alias("actual")
    )


def failed_calls(calls: DataFrame, failed: Column) -> DataFrame:
    return calls.agg(
        F.count_if(failed).alias("failed_calls"), F.count("*").alias("total_calls")
    )


def sentinel_counts(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count("*").alias("events"),
        F.count_if(F.col("emitted_score") < 0).alias("sentinels"),
    )


def reconcile(scored: DataFrame, persisted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Calls whose scored and persisted rows differ, missing sides included."""
    both = scored.join(persisted, list(keys), "full_outer").fillna(0, ["scored_rows", "persisted_rows"])
    return both.filter(F.col("scored_rows") != F.col("persisted_rows"))
