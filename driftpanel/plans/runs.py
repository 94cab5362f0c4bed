"""A whole run: collect, keep liveness, pick the panel, grade, record, export."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from driftpanel.config import RunConfig
from driftpanel.functions.keys import composite_key
from driftpanel.functions.payload import html_safe_bytes, job_payload
from driftpanel.operators.jobs_table import JobsTable
from driftpanel.operators.ledger import append_run, call_id, event_rows, rebuild_calls
from driftpanel.operators.liveness import candidates, first_per_posting
from driftpanel.operators.latest import export_rows
from driftpanel.operators.scoring import grade, refused
from driftpanel.operators.waves import ANSWER_TYPE, Landing, Registry
from driftpanel.plans.panels import POSTING_COLUMNS, load_or_build
from driftpanel.session import configure, cut_lineage, written_once

CALL_KEY = ("run_id", "model", "batch_index")
PANEL_OFF = -1


def job_rows(postings: DataFrame) -> DataFrame:
    """Postings as rows of the jobs table, without the liveness columns.

    Repeats of a posting fold first, so its payload is built once.
    """
    distinct = first_per_posting(postings, (*POSTING_COLUMNS, "stablekey"))
    payload = distinct.withColumn("payload", job_payload())
    return payload.select(
        "composite_key", "stablekey", F.timestamp_seconds("posted_at").alias("posted_at"),
        "source", "title", "company", "url", "payload",
        F.octet_length("description").alias("description_chars"),
        html_safe_bytes(F.col("payload")).alias("payload_chars"),
    )


def ledger_events(events: DataFrame, run_id: str) -> DataFrame:
    """Graded events with their call's facts flattened out."""
    return events.drop("call_id").select(
        F.lit(run_id).alias("run_id"), "*",
        *[F.col(f"usage.{name}").alias(name)
          for name in ("input_uncached", "cached_read", "cache_write", "output_tokens", "reasoning_tokens")],
        F.col("usage.raw").alias("usage_raw"),
    ).withColumn("call_id", call_id(*CALL_KEY))


def ledger_calls(events: DataFrame, config: RunConfig, scored_at: datetime) -> DataFrame:
    """Call rows with the identity every row of a run shares."""
    calls = rebuild_calls(events, CALL_KEY, "job_pos")
    return (
        calls.withColumn("scored_at", F.lit(scored_at).cast("timestamp"))
        .withColumn("contributor_id", F.lit(config.contributor_id))
        .withColumn("resume_id", F.lit(config.instructions_version))
        .withColumn("config_id", F.lit(config.config_id))
        .withColumn("instructions_version", F.lit(config.instructions_version))
        .drop("run_id")
    )


def run_summary(spark: SparkSession, run_id: str, config: RunConfig, batch_size: int, panel_size: int) -> DataFrame:
    """Conditions of a run; a panel size of -1 says the panel was off."""
    return spark.createDataFrame(
        [(run_id, panel_size, batch_size, len(config.graders()), config.run_mode)],
        "run_id string, panel_size int, batch_size int, model_count int, run_kind string",
    )


class CallsFailed(RuntimeError):
    """Some calls of a run failed; its tables are written all the same."""


class EventsLost(RuntimeError):
    """Some graded events are not in the ledger."""


def run_totals(outcomes: DataFrame, graded: DataFrame, stored: DataFrame) -> DataFrame:
    """Per model: events graded and events stored, calls made and failed.

    ``expected`` counts events, not answers: an answer may serve several postings or none.
    """
    calls = outcomes.filter("attempted").groupBy("model").agg(
        F.count_if(F.col("outcome") == "failed").alias("failed_calls"), F.count("*").alias("total_calls"),
    )
    expected = graded.groupBy("model").agg(F.count("*").alias("expected"))
    actual = stored.groupBy("model").agg(F.count("*").alias("actual"))
    return calls.join(expected, "model", "full_outer").join(actual, "model", "full_outer").fillna(0).select(
        "model", "expected", "actual", "failed_calls", "total_calls")


def counted(df: DataFrame, step: str) -> tuple[DataFrame, Observation]:
    """The same rows, counted by whatever job passes over them first."""
    seen = Observation(step)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


class Funnel:
    """How many rows each step of a run let through, gathered while the steps run."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}
        self._waiting: dict[str, Observation] = {}

    def watch(self, step: str, df: DataFrame) -> DataFrame:
        watched, self._waiting[step] = counted(df, step)
        return watched

    def seen(self, step: str) -> int:
        """Of a step that some job has passed over."""
        self.counts[step] = self._waiting.pop(step).get["rows"]
        return self.counts[step]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.counts.items()), "step string, rows bigint")


def grade_run(spark: SparkSession, config: RunConfig, collected, registry: Registry, now: datetime, root: str,
              run_id: str, stop_on_failed_calls: bool = False) -> dict[str, DataFrame]:
    """Runs the whole flow and writes its tables under ``root``.

    ``collected`` is a function returning the postings of all boards; it is not
    called when a stored panel makes collecting pointless. When it is, the stored jobs
    that are still live are touched, and aged ones go if the settings say so. Every table is written
    per run, so a repeated attempt replaces its own rows and nothing else; answers that have landed are
    not asked for again. The models that can't be asked are recorded first. At the end the totals, the
    funnel and the export sheet are written. A model whose calls fail stops, which is no error unless
    ``stop_on_failed_calls`` is set; events that did not reach the ledger are one.
    """
    configure(spark)
    config.validate()
    append_run(refused(spark, config.graders(), list(registry)), f"{root}/refused_models", run_id)

    moment = F.lit(now).cast("timestamp")
    table = JobsTable(spark, f"{root}/jobs")
    funnel, current = Funnel(), None

    def matched() -> DataFrame:
        nonlocal current
        # Decoded once; who needs only keys reads only keys.
        current = written_once(funnel.watch("collected", collected()), "collected")
        funnel.seen("collected")
        if hasattr(collected, "counts"):
            funnel.counts.update(collected.counts())
        # Batching passes over the postings several times; choosing and counting happen in one pass before.
        chosen = written_once(funnel.watch("matched", candidates(
            current, table.seen(), config.rescore_every_run, config.include, config.exclude)), "matched")
        funnel.seen("matched")
        return chosen

    panel_size = PANEL_OFF
    if config.panel_enabled:
        screening = Landing(f"{root}/answers", f"{run_id}-screening")
        postings = load_or_build(
            spark, config, matched, registry, now, f"{root}/panel_jobs", screening, funnel.counts)
        postings = postings.drop("panel_id", "score_band", "screening_score").withColumn(
            "composite_key", composite_key(F.col("stablekey"), F.col("posted_at"))
        )
        panel_size = funnel.counts["panel"] = postings.count()
    else:
        postings = matched()
    batch_size = config.batch_size(now)
    outcomes, graded = grade(
        postings, config.graders(), registry, config.instructions, config.temperature, batch_size,
        landing=Landing(f"{root}/answers", run_id),
    )
    events = cut_lineage(ledger_events(graded, run_id))
    append_run(ledger_calls(events, config, now), f"{root}/scoring_calls", run_id)
    append_run(event_rows(events, CALL_KEY, "job_pos"), f"{root}/scoring_events", run_id)
    append_run(outcomes, f"{root}/batch_outcomes", run_id)
    append_run(
        run_summary(spark, run_id, config, batch_size, panel_size).drop("run_id"), f"{root}/runs", run_id
    )
    # The postings come from where they are; the events only say which got a score.
    scored = postings.join(events.select("composite_key").distinct(), "composite_key", "left_semi")
    table.advance(run_id, moment, written_once(job_rows(scored), "scored"), current, config.delete_aged)
    mine = lambda name: spark.read.parquet(f"{root}/{name}").filter(F.col("run_id") == run_id)
    persisted = mine("scoring_events").join(mine("scoring_calls").select("call_id", "model"), "call_id")
    append_run(run_totals(mine("batch_outcomes"), events, persisted), f"{root}/run_totals", run_id)
    append_run(funnel.rows(spark), f"{root}/funnel", run_id)
    tables = run_tables(spark, root)
    exported = tables["jobs"].withColumn("posted_at", F.unix_seconds("posted_at"))
    write_sheet(export_rows(exported, tables["events"], tables["calls"]), f"{root}/export")

    totals = mine("run_totals").agg(*[F.sum(c).alias(c) for c in ("expected", "actual", "failed_calls", "total_calls")]).first()
    if totals["expected"] != totals["actual"]:
        raise EventsLost(f"{totals['actual']} of {totals['expected']} events are stored")
    if stop_on_failed_calls and totals["failed_calls"]:
        raise CallsFailed(f"{totals['failed_calls']} of {totals['total_calls']} calls failed")
    return tables


def run_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """What runs under this root have written."""
    return {
        "jobs": JobsTable(spark, f"{root}/jobs").read(),
        "calls": spark.read.parquet(f"{root}/scoring_calls"),
        "events": spark.read.parquet(f"{root}/scoring_events"),
        "outcomes": spark.read.parquet(f"{root}/batch_outcomes"),
        "runs": spark.read.parquet(f"{root}/runs"),
        "totals": spark.read.parquet(f"{root}/run_totals"),
        "funnel": spark.read.parquet(f"{root}/funnel"),
        "answers": spark.read.schema(ANSWER_TYPE + ", run_id string, wave int").parquet(f"{root}/answers"),
        # Often empty, so its columns are named.
        "refused": spark.read.schema("model string, deployment string, reason string, run_id string").parquet(f"{root}/refused_models"),
    }


def write_sheet(rows: DataFrame, path: str) -> None:
    """The export as CSV, replacing the last one; ordered by stable key."""
    rows.orderBy("stablekey").write.mode("overwrite").option("header", "true").option(
        "escape", '"'
    ).csv(path)
