"""Latest score per posting."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftpanel.functions.moments import epoch_date
from driftpanel.functions.payload import display_score, location_of


def latest_by(rows: DataFrame, keys, order, columns) -> DataFrame:
    """The row with the greatest ``order`` per key.

    ``max_by`` folds on the map side, so a key with very many rows sends one row
    per task over the wire.
    """
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, "best.*")


def latest_scores(events: DataFrame, keys=("composite_key",),
                  columns=("model", "scored_at", "event_id", "score")) -> DataFrame:
    """Newest event per key; the event id settles ties."""
    scored = events.withColumn("score", display_score(F.col("ev_score"), F.col("emitted_score")))
    return latest_by(scored, keys, ("scored_at", "event_id"), columns)


def export_rows(jobs: DataFrame, events: DataFrame, calls: DataFrame) -> DataFrame:
    """The export sheet: newest score per stable key, ten columns in order.

    Scores are first folded per composite key, before the join with the postings,
    and then per stable key, which may span several composite keys.
    """
    scored = events.join(calls.select("call_id", "scored_at"), "call_id")
    newest = latest_scores(
        scored, ("composite_key",), ("scored_at", "event_id", "score", "reasoning")
    )
    joined = jobs.join(newest, "composite_key")
    picked = latest_by(
        joined, ("stablekey",), ("scored_at", "event_id"),
        ("posted_at", "title", "company", "score", "reasoning", "payload", "url"),
    )
    return sheet(picked.withColumn("has_applied", F.lit(False)))


def export_items(items: DataFrame) -> DataFrame:
    """The export sheet of a one-row-per-posting table; no folding needed."""
    return sheet(items)


def sheet(rows: DataFrame) -> DataFrame:
    location = F.col("location") if "location" in rows.columns else location_of(F.col("payload"))
    return rows.select(
        "stablekey", "posted_at", epoch_date(F.col("posted_at")).alias("posted"), "title", "company",
        "score", "has_applied", F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        location.alias("location"), "url",
    )


def overwrite_latest(stored: DataFrame, events: DataFrame, now) -> DataFrame:
    """Next snapshot of the one-row-per-posting table.

    A scored posting replaces its row as a whole, which clears ``has_applied``.
    """
    keys = ("stablekey", "posted_at")
    content = ("score", "title", "company", "location", "url", "source", "reasoning")
    put = latest_scores(events, keys, content).withColumn("has_applied", F.lit(False)).withColumn("last_seen", now)
    untouched = stored.join(put.select(*keys), list(keys), "left_anti")
    return untouched.unionByName(put)
