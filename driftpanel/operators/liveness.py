"""Which postings are new, still live, or aged out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from driftpanel.operators.filters import filter_postings

TTL_HOURS = 48
WRITE_ONCE = (
    "stablekey", "posted_at", "source", "title", "company", "url", "payload",
    "description_chars", "payload_chars",
)


def seen_postings(jobs: DataFrame) -> DataFrame:
    """What liveness needs of the jobs table; a ledger does not track applications."""
    applied = F.col("has_applied") if "has_applied" in jobs.columns else F.lit(False).alias("has_applied")
    return jobs.select("composite_key", "stablekey", "posted_at", "last_seen", applied)


def live_keys(postings: DataFrame) -> DataFrame:
    return postings.select("composite_key").distinct()


def fresh_postings(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Postings not seen before; repeats within the input stay."""
    return postings.join(seen.select("composite_key"), "composite_key", "left_anti")


def liveness_split(seen: DataFrame, postings: DataFrame, now: Column) -> DataFrame:
    """Labels every seen posting ``bump``, ``age`` or ``keep``."""
    live = live_keys(postings).withColumn("live", F.lit(True))
    cutoff = now - F.expr(f"INTERVAL {TTL_HOURS} HOURS")
    label = (
        F.when(F.col("live"), "bump")
        .when((F.col("last_seen") < cutoff) & ~F.col("has_applied"), "age")
        .otherwise("keep")
    )
    return seen.join(live, "composite_key", "left").withColumn("action", label).drop("live")


def bump_last_seen(split: DataFrame, now: Column) -> DataFrame:
    return split.withColumn(
        "last_seen", F.when(F.col("action") == "bump", now).otherwise(F.col("last_seen"))
    )


def delete_aged(split: DataFrame, delete: bool) -> DataFrame:
    """The next snapshot of seen postings. A ledger never deletes."""
    return split.filter(F.col("action") != "age") if delete else split


def maintain(seen: DataFrame, postings: DataFrame, now: Column, delete: bool) -> DataFrame:
    split = liveness_split(seen, postings, now)
    return delete_aged(bump_last_seen(split, now), delete).drop("action")


def first_per_posting(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per composite key, the one with the least url.

    A posting scored by many models folds on the map side.
    """
    first = F.min_by(F.struct(*columns), F.struct("url", "title")).alias("first")
    return rows.groupBy("composite_key").agg(first).select("composite_key", "first.*")


def candidates(postings: DataFrame, seen: DataFrame, rescore_all: bool,
               include: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """Postings to score: all live ones or only the fresh ones, then filtered."""
    pool = postings if rescore_all else fresh_postings(postings, seen)
    return filter_postings(pool, include, exclude)
