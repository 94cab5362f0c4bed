"""Asking models in waves, over answers that have landed.

A model that fails stops, so its later batches should not be paid for. Batches are asked
in waves that grow by a factor: the wave in which a model fails is its last, and the calls
spent beyond the failure are at most ``GROWTH`` times those before it, or a first wave.

Every raw answer lands in the shared folder as its task ends, under its run and wave, and
stays there. Requests that have an answer are not sent again: a job that was lost, or a run
that is repeated under its id, asks only for what is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftpanel.config import ModelConfig
from driftpanel.functions.payload import chat_request
from driftpanel.session import cut_lineage, scratch_path
from driftpanel.sources.responses import chat_calls

FIRST, GROWTH = 8, 8
# Batch at which each wave begins; further ones than any run has.
STARTS = tuple(FIRST * (GROWTH**k - 1) // (GROWTH - 1) for k in range(20))

ANSWER_TYPE = (
    "model string, deployment string, want_logprobs boolean, protocol string, batch_index bigint, jobs_sent bigint, "
    "token_estimate double, temperature_sent double, response string, status int, error_kind string, asked_at timestamp"
)
MODEL_TYPE = (
    "model string, deployment string, want_logprobs boolean, protocol string, tpm int, rpm int"
)

Scorer = Callable[[DataFrame], DataFrame]


def chat_body(instructions: str, temperature: float) -> Column:
    return chat_request(
        F.col("model"), F.lit(instructions), F.col("message"), F.lit(float(temperature)), F.col("want_logprobs")
    )


@dataclass(frozen=True)
class Route:
    """How a protocol is spoken: who answers, how requests are written, how answers are read.

    A plain scorer speaks the chat shape.
    """

    scorer: Scorer
    body: Callable[[str, float], Column] = chat_body
    decode: Callable[[DataFrame], DataFrame] = chat_calls


Registry = Mapping[str, "Scorer | Route"]


def route_of(entry: Scorer | Route) -> Route:
    return entry if isinstance(entry, Route) else Route(entry)


@dataclass(frozen=True)
class Landing:
    """Where the raw answers of a run are kept."""

    path: str
    run_id: str

    def wave(self, number: int) -> str:
        return f"{self.path}/run_id={self.run_id}/wave={number}"


def wave_of(batch_index: Column) -> Column:
    starts = F.array(*[F.lit(start).cast("bigint") for start in STARTS])
    return (F.size(F.filter(starts, lambda start: start <= batch_index)) - 1).cast("int")


def stored_requests(requests: DataFrame) -> DataFrame:
    """Requests written once, a folder per wave."""
    path = scratch_path(requests.sparkSession, "requests")
    rows = requests.withColumn("wave", wave_of(F.col("batch_index")))
    rows.write.partitionBy("wave").parquet(path)
    return requests.sparkSession.read.schema(rows.schema).parquet(path)


def landed(spark: SparkSession, path: str) -> DataFrame | None:
    """Answers in a folder, one per call: where two attempts met, the earlier."""
    try:
        rows = spark.read.schema(ANSWER_TYPE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    call = ["model", "batch_index"]
    rest = [c for c in rows.columns if c not in call]
    first = F.min_by(F.struct(*rest), F.struct("asked_at", "response"))
    return rows.groupBy(*call).agg(first.alias("a")).select(*call, "a.*")


def lost() -> Column:
    """Why a call gives no events: it failed, or its answer can't be read."""
    return F.col("status").isNotNull() | F.col("error_kind").isNotNull() | F.col("failure").isNotNull()


def ask_in_waves(requests: DataFrame, models: Sequence[ModelConfig], registry: Registry, instructions: str,
                 temperature: float, landing: Landing | None = None) -> DataFrame:
    """Every call that was made, decoded, with ``failed``.

    ``requests`` come from ``stored_requests``. The driver learns per wave which models
    failed, nothing else.
    """
    spark = requests.sparkSession
    landing = landing or Landing(scratch_path(spark, "answers"), "once")
    waves = sorted(row["wave"] for row in requests.select("wave").distinct().collect())
    standing, calls = list(models), None
    for wave in waves:
        here = requests.filter(F.col("wave") == wave)
        land(here, standing, registry, instructions, temperature, landing.wave(wave))
        answers = landed(spark, landing.wave(wave)).filter(F.col("model").isin([m.name for m in standing]))
        decoded = cut_lineage(decode(answers, standing, registry).withColumn("failed", lost()))
        calls = decoded if calls is None else calls.unionByName(decoded)
        failed = {row["model"] for row in decoded.filter("failed").select("model").distinct().collect()}
        standing = [model for model in standing if model.name not in failed]
        if not standing:
            break
    return calls if calls is not None else decode(
        spark.createDataFrame([], ANSWER_TYPE), models, registry).withColumn("failed", F.lit(False))


def for_models(requests: DataFrame, models: Sequence[ModelConfig]) -> DataFrame:
    """One row per model and batch: every model is asked every batch."""
    rows = [(m.name, m.deployment, m.want_logprobs, m.protocol, m.tpm, m.rpm) for m in models]
    return requests.crossJoin(requests.sparkSession.createDataFrame(rows, MODEL_TYPE))


def land(requests: DataFrame, models: Sequence[ModelConfig], registry: Registry, instructions: str,
         temperature: float, path: str) -> None:
    """Asks what has no answer in the folder yet, and appends the answers task by task."""
    spark = requests.sparkSession
    asked = for_models(requests.select("batch_index", "jobs_sent", "token_estimate", "message"), models)
    known = landed(spark, path)
    if known is not None:
        asked = asked.join(known.select("model", "batch_index"), ["model", "batch_index"], "left_anti")
    # Answers are slow to come: spread the calls, however few bytes they are.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = asked.repartition(tasks, "model", "batch_index").withColumn("temperature_sent", F.lit(float(temperature)))
    answers = None
    for protocol in sorted({model.protocol for model in models}):
        route = route_of(registry[protocol])
        own = sent.filter(F.col("protocol") == protocol).withColumn("request", route.body(instructions, temperature))
        some = route.scorer(own.drop("message")).withColumn("asked_at", F.current_timestamp())
        some = some.select(*[F.col(name).cast(kind) for name, kind in (f.split() for f in ANSWER_TYPE.split(","))])
        answers = some if answers is None else answers.unionByName(some)
    # Version 2 keeps what finished tasks have written when the job is lost.
    answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


def decode(answers: DataFrame, models: Sequence[ModelConfig], registry: Registry) -> DataFrame:
    whole = None
    for protocol in sorted({model.protocol for model in models}):
        some = route_of(registry[protocol]).decode(answers.filter(F.col("protocol") == protocol))
        whole = some if whole is None else whole.unionByName(some)
    return whole
