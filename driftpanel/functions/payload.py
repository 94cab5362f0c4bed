"""Posting payloads, their byte sizes, and the request sent to a model."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F

# Field order of a stored posting. Fixed values.
PAYLOAD_FIELDS = ("key", "title", "company", "location", "description", "url", "source", "posted_at")
PROMPT_FIELDS = ("key", "title", "company", "location", "description")

PROMPT_PREFIX = "Jobs to score:\n"
TOP_LOGPROBS = 5

# Shape every chat response must follow. Fixed value.
SCORE_SCHEMA = {
    "type": "object",
    "properties": {
        "results": {
            "type": "array",
            "items": {
                "type": "object",
                "properties": {
                    "key": {"type": "string"},
                    "score": {"type": "number"},
                    "reasoning": {"type": "string"},
                },
                "required": ["key", "score", "reasoning"],
                "additionalProperties": False,
            },
        }
    },
    "required": ["results"],
    "additionalProperties": False,
}


def job_payload(prefix: str = "") -> Column:
    """The posting as JSON; ``is_remote`` appears only when true."""
    fields = [F.col(prefix + name).alias(name) for name in PAYLOAD_FIELDS]
    remote = F.when(F.col(prefix + "is_remote"), True).alias("is_remote")
    return F.to_json(F.struct(*fields, remote))


def html_safe_json(document: Column) -> Column:
    """Writes ``< > &`` and the two Unicode line separators as escapes."""
    for char in ("<", ">", "&", "\u2028", "\u2029"):
        document = F.replace(document, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return document


def html_safe_bytes(document: Column) -> Column:
    """Byte length of ``html_safe_json(document)`` without building the text."""

    def bytes_of(char: str) -> Column:
        """Bytes the character takes up in the document."""
        return F.octet_length(document) - F.octet_length(F.replace(document, F.lit(char), F.lit("")))

    # Each becomes six bytes; the first three are one byte long, the others three.
    grown = 5 * sum((bytes_of(char) for char in "<>&"), F.lit(0))
    return F.octet_length(document) + grown + bytes_of("\u2028") + bytes_of("\u2029")


def location_of(payload: Column) -> Column:
    return F.coalesce(F.get_json_object(payload, "$.location"), F.lit(""))


def display_score(ev: Column, emitted: Column) -> Column:
    return F.coalesce(ev, emitted)


def user_message(items: Column) -> Column:
    return F.concat(F.lit(PROMPT_PREFIX), html_safe_json(F.to_json(items)))


def chat_request(model: Column, instructions: Column, message: Column, temperature: Column,
                 want_logprobs: Column) -> Column:
    """Request body for a chat-completions endpoint."""

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    spec = F.struct(
        F.lit("job_scores").alias("name"),
        F.lit(True).alias("strict"),
        F.parse_json(F.lit(json.dumps(SCORE_SCHEMA))).alias("schema"),
    )
    return F.to_json(
        F.struct(
            model.alias("model"),
            F.array(turn("system", instructions), turn("user", message)).alias("messages"),
            temperature.alias("temperature"),
            F.struct(F.lit("json_schema").alias("type"), spec.alias("json_schema")).alias("response_format"),
            F.when(want_logprobs, True).alias("logprobs"),
            F.when(want_logprobs, TOP_LOGPROBS).alias("top_logprobs"),
        )
    )


# Fixed value: the answer asked of a candidates/parts endpoint.
CANDIDATE_SCHEMA = {
    "type": "array",
    "items": {
        "type": "object",
        "properties": {"key": {"type": "string"}, "score": {"type": "integer"}, "reasoning": {"type": "string"}},
        "required": ["key", "score", "reasoning"],
        "propertyOrdering": ["key", "score", "reasoning"],
    },
}


def candidate_request(instructions: Column, message: Column) -> Column:
    """Request body for a candidates/parts endpoint; it takes no temperature."""
    parts = F.array(*[F.struct(text.alias("text")) for text in (instructions, message)])
    return F.to_json(F.struct(
        F.array(F.struct(parts.alias("parts"))).alias("contents"),
        F.struct(
            F.lit("application/json").alias("responseMimeType"),
            F.parse_json(F.lit(json.dumps(CANDIDATE_SCHEMA))).alias("responseSchema"),
        ).alias("generationConfig"),
    ))
