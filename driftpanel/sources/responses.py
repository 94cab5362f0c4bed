"""Model responses: envelopes, items, usage and expected scores.

A response row holds the raw body of one call in ``response`` next to whatever
identifies the call. Decoding a row adds ``failure`` (why the whole call is lost,
or null) and ``items`` (empty when it is lost); nothing is shuffled. Envelopes are
read with a schema in one streaming pass; only items become VARIANTs, because only
their types need a second look.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from driftpanel.functions import variants as V
from driftpanel.functions.binding import bind, bind_all
from driftpanel.functions.expected import expected_score_of, parsed_tokens
from driftpanel.functions.items import named_fields, strict_items, well_typed
from driftpanel.functions.usage import itemised_usage

# Reasons a whole call is lost.
BAD_ENVELOPE = "envelope"
EMPTY_RESPONSE = "empty"
BAD_CONTENT = "content"

BROKEN = "_corrupt_record"
CHAT_ENVELOPE = (
    "choices array<struct<message: struct<content: string>, logprobs: string>>, usage string, "
    f"{BROKEN} string"
)
CHAT_CONTENT = f"results array<variant>, {BROKEN} string"
CANDIDATES_ENVELOPE = (
    "candidates array<struct<content: struct<parts: array<struct<text: string>>>>>, "
    f"usageMetadata string, {BROKEN} string"
)


def _no_items() -> Column:
    return F.array().cast("array<variant>")


def _is_null_text(text: Column) -> Column:
    return F.trim(text) == "null"


def _broken(parsed: Column) -> Column:
    return parsed.isNull() | parsed[BROKEN].isNotNull()


@cache
def _chat_columns() -> dict[str, Column]:
    """The decoder's expressions; they are large, and many small sets of answers are decoded."""
    body, choice, inner = F.col("body"), F.col("choice"), F.col("inner")
    failure = (
        F.when(_broken(body), BAD_ENVELOPE)
        .when(F.coalesce(F.size(body["choices"]), F.lit(0)) <= 0, EMPTY_RESPONSE)
        .when(_broken(inner) & ~_is_null_text(F.col("content")), BAD_CONTENT)
    )
    found = F.when(F.col("failure").isNull(), F.coalesce(inner["results"], _no_items())).otherwise(_no_items())

    def expected_in(call: Column) -> Column:
        def with_expected(item: Column) -> Column:
            ev = F.when(item["well_formed"], expected_score_of(call["content"], call["tokens"], item["job_key"]))
            return item.withField("ev_score", ev)

        return F.transform(call["items"], with_expected)

    no_ev = F.transform("items", lambda item: item.withField("ev_score", F.lit(None).cast("double")))
    with_ev = bind_all(
        expected_in, content=F.col("content"), tokens=parsed_tokens(F.col("logprobs")), items=F.col("items")
    )
    return {
        "body": F.from_json("response", CHAT_ENVELOPE),
        "choice": F.get(body["choices"], 0),
        "content": F.coalesce(choice["message"]["content"], F.lit("")),
        "inner": F.from_json("content", CHAT_CONTENT),
        "failure": failure,
        "usage": itemised_usage(body["usage"]).alias("usage"),
        "logprobs": F.when(F.coalesce(F.col("want_logprobs"), F.lit(False)), choice["logprobs"]).alias("logprobs"),
        "strict": strict_items(found).alias("items"),
        "items": F.when(F.col("logprobs").isNull(), no_ev).otherwise(with_ev),
    }


def chat_calls(responses: DataFrame) -> DataFrame:
    """One row per chat-completions call: usage, failure, logprobs, decoded items."""
    kept = [c for c in responses.columns if c not in ("response", "items")]
    decoder = _chat_columns()
    opened = responses
    for step in ("body", "choice", "content", "inner", "failure"):
        opened = opened.withColumn(step, decoder[step])
    checked = opened.select(*kept, "content", "failure", decoder["usage"], decoder["logprobs"], decoder["strict"])
    return checked.withColumn("items", decoder["items"]).drop("content")


def exploded(calls: DataFrame, kept: list[str]) -> DataFrame:
    """One row per item with its position.

    An inner explode lets the optimizer filter on the array's size below the
    decoding, which would decode everything twice; the outer one does not.
    """
    rows = calls.select(*kept, F.posexplode_outer("items").alias("pos", "item"))
    return rows.filter(F.col("pos").isNotNull())


def chat_items(calls: DataFrame) -> DataFrame:
    """One row per item of the calls that decoded, malformed items included."""
    kept = [c for c in calls.columns if c not in ("items", "failure")]
    return exploded(calls, kept).select(
        *kept, "pos",
        *[F.col(f"item.{name}").alias(name)
          for name in ("well_formed", "job_key", "emitted_score", "ev_score", "reasoning", "raw")],
    )


@cache
def _candidate_columns() -> dict[str, Column]:
    body, part = F.col("body"), F.col("part")
    unreadable = F.col("found").isNull() & ~F.coalesce(_is_null_text(part["text"]), F.lit(False))
    failure = (
        F.when(_broken(body), BAD_ENVELOPE)
        .when(part.isNull(), EMPTY_RESPONSE)
        .when(unreadable, BAD_CONTENT)
        .when(~F.forall("found", lambda item: well_typed(item, V.WHOLE)), BAD_CONTENT)
    )
    total = F.coalesce(F.get_json_object(body["usageMetadata"], "$.totalTokenCount").try_cast("int"), F.lit(0))
    return {
        "body": F.from_json("response", CANDIDATES_ENVELOPE),
        "part": F.get(F.get(body["candidates"], 0)["content"]["parts"], 0),
        "found": F.from_json(part["text"], "array<variant>"),
        "failure": failure,
        "total_tokens": total.cast("double").alias("total_tokens"),
        "usage_raw": body["usageMetadata"].alias("usage_raw"),
        "items": F.when(F.col("failure").isNull(), F.coalesce("found", _no_items())).otherwise(_no_items()).alias("items"),
    }


def candidate_calls(responses: DataFrame) -> DataFrame:
    """Calls in the candidates/parts shape; one bad item loses the whole call."""
    kept = [c for c in responses.columns if c not in ("response", "items")]
    decoder = _candidate_columns()
    opened = responses
    for step in ("body", "part", "found", "failure"):
        opened = opened.withColumn(step, decoder[step])
    return opened.select(*kept, "failure", decoder["total_tokens"], decoder["usage_raw"], decoder["items"])


def candidate_items(calls: DataFrame) -> DataFrame:
    keep = [c for c in calls.columns if c not in ("items", "failure", "response")]
    found = exploded(calls, keep).withColumn("found", named_fields(F.col("item")))
    return found.select(
        *keep, "pos",
        V.text_at(F.col("found.key"), "$").alias("job_key"),
        V.whole_at(F.col("found.score"), "$").cast("double").alias("emitted_score"),
        V.text_at(F.col("found.reasoning"), "$").alias("reasoning"),
    )


@cache
def _candidate_answer_columns() -> list[Column]:
    unknown = F.lit(None).cast("bigint")
    counts = [unknown.alias(name) for name in (
        "input_uncached", "cached_read", "cache_write", "output_tokens", "reasoning_tokens")]
    items = F.transform("items", lambda item: bind(named_fields(item), lambda found: F.struct(
        F.lit(True).alias("well_formed"), V.text_at(found["key"], "$").alias("job_key"),
        V.whole_at(found["score"], "$").cast("double").alias("emitted_score"),
        V.text_at(found["reasoning"], "$").alias("reasoning"), F.to_json(item).alias("raw"),
        F.lit(None).cast("double").alias("ev_score"),
    )))
    return [
        F.struct(*counts, F.col("total_tokens").alias("total"), F.col("usage_raw").alias("raw")).alias("usage"),
        F.lit(None).cast("string").alias("logprobs"), items.alias("items"),
    ]


def candidate_answers(responses: DataFrame) -> DataFrame:
    """Like ``chat_calls``, for the candidates/parts shape: no itemised usage, no logprobs."""
    calls = candidate_calls(responses)
    kept = [c for c in calls.columns if c not in ("items", "failure", "total_tokens", "usage_raw")]
    return calls.select(*kept, "failure", *_candidate_answer_columns())
