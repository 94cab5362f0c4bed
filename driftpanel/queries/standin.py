"""Stand-ins for models: they answer requests without a network, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftpanel.functions.payload import PROMPT_PREFIX

PROMPTED = "array<struct<key: string, title: string>>"


def offline_score(key: Column, salt: Column) -> Column:
    """A repeatable stand-in score from 0 to 100."""
    digits = F.substring(F.md5(F.concat_ws(":", salt, key)), 1, 6)
    return (F.conv(digits, 16, 10).cast("bigint") % 101).cast("double")


def prompted(path: str) -> Column:
    """The postings a request lists, read from its body."""
    message = F.get_json_object("request", path)
    return F.from_json(F.substring(message, len(PROMPT_PREFIX) + 1, 2**31 - 1), PROMPTED)


def _answered(requests: DataFrame, body: Column) -> DataFrame:
    return (
        requests.withColumn("response", body)
        .withColumn("status", F.lit(None).cast("int"))
        .withColumn("error_kind", F.lit(None).cast("string"))
    )


def _results(path: str, kind: str) -> Column:
    return F.transform(
        prompted(path),
        lambda job: F.struct(
            job["key"].alias("key"),
            offline_score(job["key"], F.col("model")).cast(kind).alias("score"),
            F.concat(F.lit("offline "), job["title"]).alias("reasoning"),
        ),
    )


def offline_scorer(requests: DataFrame) -> DataFrame:
    """Answers in the chat shape."""
    total = F.floor(F.col("token_estimate")).cast("bigint")
    content = F.to_json(F.struct(_results("$.messages[1].content", "double").alias("results")))
    return _answered(requests, F.to_json(F.struct(
        F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"),
        F.struct(
            total.alias("prompt_tokens"), F.lit(0).alias("completion_tokens"), total.alias("total_tokens"),
        ).alias("usage"),
    )))


def offline_candidates(requests: DataFrame) -> DataFrame:
    """Answers in the candidates/parts shape; scores are whole there."""
    text = F.to_json(_results("$.contents[0].parts[1].text", "bigint"))
    return _answered(requests, F.to_json(F.struct(
        F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates"),
        F.struct(F.floor("token_estimate").cast("bigint").alias("totalTokenCount")).alias("usageMetadata"),
    )))


def failing_from(scorer, batch_index: int, model: str):
    """The same scorer, but one model's calls fail from a batch on."""

    def answered(requests: DataFrame) -> DataFrame:
        bad = (F.col("model") == model) & (F.col("batch_index") >= batch_index)
        return scorer(requests).withColumn("status", F.when(bad, 503)).withColumn(
            "response", F.when(~bad, F.col("response")))

    return answered
