"""Settings that arrive as JSON: sources, keywords, models, bands, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftpanel.sources.boards import PROVIDERS

SOURCES_TYPE = "map<string, array<string>>"
KEYWORDS_TYPE = "include array<string>, exclude array<string>"
MODELS_TYPE = (
    "array<struct<name: string, deployment: string, wantLogprobs: boolean, tpm: int, rpm: int, "
    "protocol: string, baseURL: string, authScope: string>>"
)
BANDS_TYPE = "array<struct<name: string, min: double, max: double>>"
TARGETS_TYPE = "array<struct<band: string, target: int, floor: int>>"

# Base addresses of the built-in providers. Fixed values.
PROVIDER_ADDRESSES = {
    "gemini": "https://generativelanguage.googleapis.com/v1beta/openai/",
    "mistral": "https://api.mistral.ai/v1",
    "cohere": "https://api.cohere.ai/compatibility/v1",
    "nvidia": "https://integrate.api.nvidia.com/v1",
}

# Built-in models: name (also the deployment), protocol, tokens and requests per
# minute. Fixed values.
BUILT_IN_MODELS = (
    ("poolside/laguna-xs-2.1", "nvidia", 1000000, 40),
    ("minimaxai/minimax-m3", "nvidia", 1000000, 40),
    ("nvidia/nemotron-3-nano-30b-a3b", "nvidia", 1000000, 40),
    ("stepfun-ai/step-3.7-flash", "nvidia", 1000000, 40),
    ("z-ai/glm-5.2", "nvidia", 1000000, 40),
    ("google/gemma-4-31b-it", "nvidia", 1000000, 40),
    ("nvidia/nemotron-3-super-120b-a12b", "nvidia", 1000000, 40),
    ("deepseek-ai/deepseek-v4-flash", "nvidia", 1000000, 40),
    ("moonshotai/kimi-k2.6", "nvidia", 1000000, 40),
    ("nvidia/nemotron-3-nano-omni-30b-a3b-reasoning", "nvidia", 1000000, 40),
    ("nvidia/nemotron-3-ultra-550b-a55b", "nvidia", 1000000, 40),
    ("command-a-plus-05-2026", "cohere", 128000, 20),
    ("mistral-medium-3-5", "mistral", 30000, 20),
    ("gemini-3.5-flash-lite", "gemini", 250000, 15),
    ("gemini-3.1-flash-lite", "gemini", 250000, 15),
)

MODEL_COLUMNS = (
    "name", "deployment", "want_logprobs", "tpm", "rpm", "protocol", "base_url", "auth_scope",
)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A settings file as one row, ``document``; local or object store alike."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "document")


def decoded(document: Column, schema: str) -> Column:
    """Fails the job on a document that is not what it should be."""
    return F.from_json(document, schema, {"mode": "FAILFAST"})


def _labels(documents: DataFrame) -> list[str]:
    """Columns that say where a document comes from; they stay with its rows."""
    return [c for c in documents.columns if c != "document"]


def source_companies(documents: DataFrame) -> DataFrame:
    """Provider and company pairs of the sources documents."""
    labels = _labels(documents)
    by_provider = F.explode(decoded(F.col("document"), SOURCES_TYPE)).alias("provider", "companies")
    return documents.select(*labels, by_provider).select(
        *labels, "provider", F.explode("companies").alias("company")
    )


def known_sources(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("provider").isin(*PROVIDERS))


def unknown_providers(sources: DataFrame) -> DataFrame:
    """Providers without a decoder: skipped and reported, not fatal."""
    return (
        sources.filter(~F.col("provider").isin(*PROVIDERS))
        .groupBy("provider")
        .agg(F.count("*").alias("companies"))
    )


def keyword_lists(documents: DataFrame) -> DataFrame:
    rules = decoded(F.col("document"), KEYWORDS_TYPE)
    empty = F.array().cast("array<string>")
    return documents.select(
        *_labels(documents),
        F.coalesce(rules["include"], empty).alias("include"),
        F.coalesce(rules["exclude"], empty).alias("exclude"),
    )


def configured_models(documents: DataFrame) -> DataFrame:
    """Model rows of JSON arrays; a missing field becomes its empty value."""
    model = F.explode(decoded(F.col("document"), MODELS_TYPE)).alias("m")

    def or_empty(field: str, empty) -> Column:
        return F.coalesce(F.col(f"m.{field}"), F.lit(empty))

    return documents.select(model).select(
        or_empty("name", "").alias("name"),
        or_empty("deployment", "").alias("deployment"),
        or_empty("wantLogprobs", False).alias("want_logprobs"),
        or_empty("tpm", 0).alias("tpm"),
        or_empty("rpm", 0).alias("rpm"),
        or_empty("protocol", "").alias("protocol"),
        or_empty("baseURL", "").alias("base_url"),
        or_empty("authScope", "").alias("auth_scope"),
    )


def built_in_models(spark: SparkSession) -> DataFrame:
    rows = [
        (name, name, False, tpm, rpm, protocol, PROVIDER_ADDRESSES[protocol], "")
        for name, protocol, tpm, rpm in BUILT_IN_MODELS
    ]
    types = ("string", "string", "boolean", "int", "int", "string", "string", "string")
    return spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(MODEL_COLUMNS, types)))


def model_catalogue(documents: DataFrame) -> DataFrame:
    """Configured models and the built-in ones; names may repeat."""
    return configured_models(documents).unionByName(built_in_models(documents.sparkSession))


def score_bands(documents: DataFrame) -> DataFrame:
    return documents.select(*_labels(documents), F.inline(decoded(F.col("document"), BANDS_TYPE)))


def band_targets(documents: DataFrame) -> DataFrame:
    return documents.select(*_labels(documents), F.inline(decoded(F.col("document"), TARGETS_TYPE)))
