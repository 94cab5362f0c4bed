"""The landing zone as a stream: new payload files flow into the jobs table.

Each micro-batch is the same pass as the daily run and one load of the jobs table. A
replayed micro-batch is a load that is there already, so it changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from driftpanel.operators.jobs_table import JobsTable
from driftpanel.plans.runs import job_rows
from driftpanel.sources.boards import parse_payloads, postings_of

LANDING_SCHEMA = "provider string, company string, payload string"


def stream_landing(spark: SparkSession, path: str) -> DataFrame:
    """Payload rows as they land, as JSON lines."""
    return spark.readStream.schema(LANDING_SCHEMA).json(path)


def upsert_stream(landing: DataFrame, root: str, checkpoint: str, now=F.current_timestamp) -> StreamingQuery:
    """Keeps the jobs table current until the stream is stopped; drains what is there."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        incoming = job_rows(postings_of(parse_payloads(batch)))
        JobsTable(batch.sparkSession, root).advance(f"batch-{batch_id}", now(), incoming)

    return (
        landing.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
