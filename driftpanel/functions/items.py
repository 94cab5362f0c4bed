"""Score items inside a model response."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from driftpanel.functions import variants as V
from driftpanel.functions.binding import bind

# Emitted score of a result that could not be tied to a posting. Fixed value.
SENTINEL_SCORE = -2.0


def named_fields(item: Column) -> Column:
    """Key, score and reasoning of an item, whatever the case of their names."""
    return V.fields(item, "key", "score", "reasoning")


def well_typed(item: Column, *score_types: str) -> Column:
    """Key and reasoning are text, the score a number; each may be missing."""
    return bind(named_fields(item), lambda found: typed(item, found, *score_types))


def typed(item: Column, found: Column, *score_types: str) -> Column:
    return V.all_of([
        V.has_type(item, V.OBJECT),
        V.has_type(found["key"], V.TEXT),
        V.has_type(found["score"], *score_types),
        V.has_type(found["reasoning"], V.TEXT),
    ])


def salvaged_reasoning(found: Column) -> Column:
    """The reasoning if it is text, whatever else is wrong with the item."""
    reasoning = found["reasoning"]
    return F.when(V.json_type(reasoning) == V.TEXT, V.text_at(reasoning, "$")).otherwise("")


def strict_items(items: Column) -> Column:
    """Decodes an array of items; a malformed one gets an empty key and the sentinel."""

    def tested(item: Column) -> Column:
        return bind(named_fields(item), lambda found: F.struct(
            (item.isNotNull() & typed(item, found, *V.NUMBERS)).alias("good"), item.alias("item"), found.alias("found")))

    def decoded(pair: Column) -> Column:
        good, item, found = pair["good"], pair["item"], pair["found"]
        return F.struct(
            good.alias("well_formed"),
            F.when(good, V.text_at(found["key"], "$")).otherwise("").alias("job_key"),
            F.when(good, V.number_at(found["score"], "$")).otherwise(SENTINEL_SCORE).alias("emitted_score"),
            salvaged_reasoning(found).alias("reasoning"),
            F.to_json(item).alias("raw"),
        )

    return F.transform(F.transform(items, tested), decoded)
