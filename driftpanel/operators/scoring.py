"""Running models over batches.

A scorer answers requests: it takes a DataFrame with one row per call and adds
``response`` (the raw body), ``status`` (null when fine) and ``error_kind``.
``from_batches`` turns a plain function on pandas frames into one; it runs inside
the tasks, a few calls at a time. Requests arrive with their body in ``request`` and the
call's facts, without the texts it was built from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from driftpanel.config import ModelConfig, SCREENING_BATCH_SIZE
from driftpanel.functions.payload import candidate_request
from driftpanel.functions.quota import batch_outcome, error_class, estimate_ratio
from driftpanel.operators.audit import attempted
from driftpanel.operators.batching import assign_batches, batch_requests
from driftpanel.operators.correlate import correlate_calls
from driftpanel.operators.ledger import call_id
from driftpanel.operators.waves import Landing, Registry, Route, Scorer, ask_in_waves, for_models, stored_requests
from driftpanel.sources.responses import candidate_answers, chat_items

RESPONSE_FIELDS = (
    T.StructField("response", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("error_kind", T.StringType()),
)

def candidate_body(instructions: str, temperature: float) -> Column:
    return candidate_request(F.lit(instructions), F.col("message"))


def candidates_route(scorer: Scorer) -> Route:
    return Route(scorer, candidate_body, candidate_answers)


def from_batches(score: Callable[[pd.DataFrame], pd.DataFrame]) -> Scorer:
    """Wraps ``score(requests) -> response, status, error_kind`` row by row aligned."""

    def scorer(requests: DataFrame) -> DataFrame:
        schema = T.StructType([*requests.schema.fields, *RESPONSE_FIELDS])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.concat([frame, score(frame).set_index(frame.index)], axis=1)[schema.names]

        return requests.mapInPandas(run, schema)

    return scorer


def refusal(model: Column, protocols: Sequence[str]) -> Column:
    """Why a model is not scored, or null."""
    return (
        F.when((model["tpm"] <= 0) | (model["rpm"] <= 0), "missing tpm/rpm")
        .when(~model["protocol"].isin(*protocols), "no scorer for protocol")
        .when(model["base_url"] == "", "missing base url")
    )


def eligible(model: ModelConfig, protocols: Sequence[str]) -> bool:
    """The same rule for one model on the driver."""
    return (
        model.tpm > 0 and model.rpm > 0 and model.protocol in protocols and model.base_url != ""
    )


def screen(postings: DataFrame, model: ModelConfig, registry: Registry,
           instructions: str, temperature: float, landing: Landing | None = None) -> DataFrame:
    """Provisional scores by job key: ``key, batch_index, pos, score``.

    A lost call fails the job: bands must not rest on part of the postings.
    Results count as they come, without tying them to the batch.
    """
    if not eligible(model, list(registry)):
        raise ValueError(f"screening model {model.name!r} cannot be called")
    requests = stored_requests(batch_requests(assign_batches(postings, SCREENING_BATCH_SIZE)))
    calls = ask_in_waves(requests, [model], registry, instructions, temperature, landing)
    message = F.concat(F.lit("screening batch failed: "), F.col("batch_index").cast("string"))
    whole = calls.withColumn("items", F.when(F.col("failed"), F.raise_error(message)).otherwise(F.col("items")))
    return chat_items(whole).select(
        F.col("job_key").alias("key"), "batch_index", "pos", F.col("emitted_score").alias("score")
    )


def refused(spark: SparkSession, models: Sequence[ModelConfig], protocols: Sequence[str]) -> DataFrame:
    """Models that are not asked, ``model, deployment, reason``."""
    rows = [(m.name, m.deployment, m.tpm, m.rpm, m.protocol, m.base_url) for m in models]
    listed = spark.createDataFrame(rows, "model string, deployment string, tpm int, rpm int, protocol string, base_url string")
    reason = refusal(F.struct("tpm", "rpm", "protocol", "base_url"), protocols)
    return listed.select("model", "deployment", reason.alias("reason")).filter(F.col("reason").isNotNull())


def grade(postings: DataFrame, models: Sequence[ModelConfig], registry: Registry,
          instructions: str, temperature: float, batch_size: int,
          carry: Sequence[str] = ("stablekey", "composite_key"),
          landing: Landing | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores the postings with every model: batch outcomes and events.

    Batches after a model's first failure give no events; their outcomes say so with
    ``attempted`` false, and ``asked`` says whether a call was spent on them all the same.
    Events carry the ``carry`` columns of their posting, keys rather than texts, as there
    is an event for each posting and model.
    """
    usable = [model for model in models if eligible(model, list(registry))]
    if not usable:
        raise ValueError("no model can be called")
    carried = [c for c in carry if c in postings.columns]
    requests = stored_requests(batch_requests(assign_batches(postings, batch_size), carried))
    calls = ask_in_waves(requests, usable, registry, instructions, temperature, landing)
    marked = attempted(calls, ["model"])
    kind = F.when(F.col("failure").isNotNull() & F.col("error_kind").isNull(), "decode").otherwise(F.col("error_kind"))
    outcomes = marked.select(
        "model", "deployment", "batch_index", "attempted", F.lit(True).alias("asked"), "jobs_sent",
        F.when(F.col("failed"), 0).otherwise(F.size("items")).alias("scores_parsed"),
        batch_outcome(F.col("failed"), F.size("items"), F.col("jobs_sent")).alias("outcome"),
        error_class(F.col("status"), kind).alias("error_class"),
        "token_estimate", F.col("usage.total").alias("actual_tokens"),
        estimate_ratio(F.col("token_estimate"), F.col("usage.total")).alias("est_ratio"),
    )
    never = for_models(requests.select("batch_index", "jobs_sent", "token_estimate"), usable).join(
        calls.select("model", "batch_index"), ["model", "batch_index"], "left_anti")
    outcomes = outcomes.unionByName(
        never.select("model", "deployment", "batch_index", F.lit(False).alias("attempted"), F.lit(False).alias("asked"),
                     "jobs_sent", F.lit(0).alias("scores_parsed"), "token_estimate"),
        allowMissingColumns=True)
    answered = marked.filter("attempted and not failed").join(requests.select("batch_index", "jobs"), "batch_index")
    call = ["model", "batch_index"]
    facts = [*call, "deployment", "temperature_sent", "usage", "logprobs"]
    events = correlate_calls(answered, facts, [c for c in carried if c != "key"], ["reasoning", "raw"])
    return outcomes, events.withColumn("call_id", call_id(*call))
