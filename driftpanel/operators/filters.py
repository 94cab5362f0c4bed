"""Predicates on postings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _contains_any(lowered: Column, words: Sequence[str]) -> Column:
    """Literal substrings, never patterns; an empty word is in every text."""
    return reduce(
        lambda left, right: left | right,
        [F.contains(lowered, F.lower(F.lit(word))) for word in words],
        F.lit(False),
    )


def keyword_match(text: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """At least one included word, unless none are given, and no excluded one."""
    lowered = F.lower(text)
    wanted = _contains_any(lowered, include) if include else F.lit(True)
    return ~_contains_any(lowered, exclude) & wanted


def filter_postings(postings: DataFrame, include: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """Remote postings whose title and location pass the keywords."""
    text = F.concat(F.col("title"), F.lit(" "), F.col("location"))
    return postings.filter(F.col("is_remote") & keyword_match(text, include, exclude))


def valid_scores(events: DataFrame) -> DataFrame:
    """Events with a real score; the sentinel is negative."""
    return events.filter(F.col("emitted_score") >= 0)
