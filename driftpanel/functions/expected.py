"""Probability-weighted score read from token logprobs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from driftpanel.functions.binding import bind, bind_all

LOGPROBS_SCHEMA = (
    "content ARRAY<STRUCT<token: STRING, logprob: DOUBLE, "
    "top_logprobs: ARRAY<STRUCT<token: STRING, logprob: DOUBLE>>>>"
)
_TOKEN_TYPE = (
    "struct<token: string, logprob: double, "
    "top_logprobs: array<struct<token: string, logprob: double>>>"
)
_NUMERAL = (
    r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
    r"|^(?i:[+-]?inf(?:inity)?|nan)$"
)
_SCORE_LABEL = '"score"'


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def _is_number(text: Column) -> Column:
    return _trimmed(text).rlike(_NUMERAL)


def _score_offset(content: Column, key: Column) -> Column:
    """Byte offset just after the score label that follows the quoted key."""
    def from_key(at_key: Column) -> Column:
        at_label = F.instr(F.substr(content, at_key), F.lit(_SCORE_LABEL))
        return F.when(at_key > 0, bind(at_label, lambda label: from_label(at_key, label)))

    def from_label(at_key: Column, at_label: Column) -> Column:
        before = F.substr(content, F.lit(1), at_key + at_label - 2)
        return F.when(at_label > 0, F.octet_length(before) + F.lit(len(_SCORE_LABEL) + 1))

    return bind(F.instr(content, F.concat(F.lit('"'), key, F.lit('"'))), from_key)


def _token_at(tokens: Column, offset: Column) -> Column:
    """First token that is not blank and starts at or after ``offset`` bytes."""
    start = F.struct(
        F.lit(0).alias("used"), F.lit(None).cast(_TOKEN_TYPE).alias("hit")
    )

    def step(state: Column, token: Column) -> Column:
        reached = (
            state["hit"].isNull() & (state["used"] >= offset) & (_trimmed(token["token"]) != "")
        )
        return F.struct(
            (state["used"] + F.coalesce(F.octet_length(token["token"]), F.lit(0))).alias("used"),
            F.when(reached, token).otherwise(state["hit"]).alias("hit"),
        )

    return F.aggregate(tokens, start, step, lambda state: state["hit"])


def _weighted_mean(candidates: Column) -> Column:
    """Null when empty or when any candidate is not a number."""
    start = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("weight"))

    def step(state: Column, candidate: Column) -> Column:
        text = _trimmed(candidate["token"])
        value = F.when(text.rlike(_NUMERAL), text.try_cast("double"))
        weight = F.exp(F.coalesce(candidate["logprob"], F.lit(0.0)))
        return F.struct(
            (state["top"] + weight * value).alias("top"), (state["weight"] + weight).alias("weight")
        )

    return F.aggregate(
        F.coalesce(candidates, F.array().cast("array<struct<token: string, logprob: double>>")),
        start, step, lambda state: F.try_divide(state["top"], state["weight"]),
    )


def parsed_tokens(logprobs: Column) -> Column:
    return F.from_json(logprobs, LOGPROBS_SCHEMA)["content"]


def expected_score_of(content: Column, tokens: Column, key: Column) -> Column:
    """Mean of the candidate scores weighted by probability, or null.

    Null means the score token was not found, is not one clean number, or has a
    candidate that is not a number. ``content`` and ``tokens`` should be bound:
    one call holds many items.
    """
    def from_hit(hit: Column) -> Column:
        return F.when(_is_number(hit["token"]), _weighted_mean(hit["top_logprobs"]))

    return bind(
        _score_offset(content, key), lambda offset: bind(_token_at(tokens, offset), from_hit)
    )


def expected_score(content: Column, logprobs: Column, key: Column) -> Column:
    return bind_all(
        lambda call: expected_score_of(call["content"], call["tokens"], key),
        content=content, tokens=parsed_tokens(logprobs),
    )
