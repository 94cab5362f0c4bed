"""Itemised token usage of one call."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from driftpanel.functions import variants as V
from driftpanel.functions.binding import bind, bind_all


# Wire names. Fixed values.
TOTALS = ("prompt_tokens", "completion_tokens", "total_tokens")
PROMPT, COMPLETION = "prompt_tokens_details", "completion_tokens_details"
CACHED, REASONING = "cached_tokens", "reasoning_tokens"


def itemised_usage(raw: Column) -> Column:
    """Struct of token counts from a provider's usage blob, whatever the case of its names.

    A null count says "the provider did not itemise this" and is never a zero.
    Each pair hangs on its own details object. A blob that cannot be read keeps
    only its raw text.
    """
    def of_fields(blob: Column, top: Column, f: Column) -> Column:
        return bind_all(
            lambda inner: _counts(blob["raw"], blob["v"], top, f, inner["prompt"], inner["completion"],
                                  V.lowered(inner["prompt"], CACHED)[CACHED], V.lowered(inner["completion"], REASONING)[REASONING]),
            prompt=V.opened(f[PROMPT]), completion=V.opened(f[COMPLETION]),
        )

    return bind_all(
        lambda blob: bind(V.opened(blob["v"]), lambda top: bind(
            V.lowered(top, *TOTALS, PROMPT, COMPLETION), lambda f: of_fields(blob, top, f))),
        raw=raw, v=F.try_parse_json(F.nullif(raw, F.lit(""))),
    )


def _counts(raw: Column, v: Column, top: Column, f: Column, prompt: Column, completion: Column,
            cached: Column, reasoning: Column) -> Column:
    readable = v.isNotNull() & V.all_of(
        [top.isNotNull() | V.nothing(v)]
        + [V.has_type(f[name], V.WHOLE) for name in TOTALS]
        + [prompt.isNotNull() | V.nothing(f[PROMPT]), completion.isNotNull() | V.nothing(f[COMPLETION])]
        + [V.has_type(cached, V.WHOLE), V.has_type(reasoning, V.WHOLE)]
    )

    def counts(r: Column) -> Column:
        return F.struct(
            F.when(r["prompt"], V.whole_at(f["prompt_tokens"], "$") - r["cached"]).alias("input_uncached"),
            F.when(r["prompt"], r["cached"]).alias("cached_read"),
            F.lit(None).cast("bigint").alias("cache_write"),
            F.when(r["completion"], V.whole_at(f["completion_tokens"], "$") - r["reasoning"]).alias("output_tokens"),
            F.when(r["completion"], r["reasoning"]).alias("reasoning_tokens"),
            F.when(r["readable"], V.whole_at(f["total_tokens"], "$")).otherwise(0).cast("double").alias("total"),
            F.nullif(raw, F.lit("")).alias("raw"),
        )

    return bind(readable, lambda ok: bind_all(
        counts, readable=ok, prompt=ok & prompt.isNotNull(), completion=ok & completion.isNotNull(),
        cached=V.whole_at(cached, "$"), reasoning=V.whole_at(reasoning, "$"),
    ))
