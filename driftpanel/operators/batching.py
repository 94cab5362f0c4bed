"""Cutting postings into batches and building the requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftpanel.functions.payload import PROMPT_FIELDS, user_message
from driftpanel.functions.quota import token_estimate
from driftpanel.operators.ordering import position_overall
from driftpanel.session import written_once

# Arrival order means nothing, so postings are batched in key order; the other
# columns only settle ties.
BATCH_ORDER = ("stablekey", "posted_at", "url")


def row_key(columns: Sequence[str]) -> list[Column]:
    """128 bits that stand for a whole row; equal rows share them."""
    return [
        F.xxhash64(*columns).alias("_row"), F.xxhash64(F.lit("again"), *columns).alias("_row2"),
    ]


def numbered_keys(keyed: DataFrame, order: Sequence[str]) -> DataFrame:
    """Position of the first of equal rows, by row key; texts take no part in the sorting."""
    keys = position_overall(keyed.select(*order, "_row", "_row2"), (*order, "_row", "_row2"), "_place")
    return keys.groupBy("_row", "_row2").agg(F.min("_place").alias("_first"))


def assign_batches(postings: DataFrame, batch_size: int, order: Sequence[str] = BATCH_ORDER) -> DataFrame:
    """Adds ``batch_index`` and ``pos``; the last batch may be short.

    The postings are worked out once and written with their row keys: sampling and sorting
    read the keys alone, and only these are sorted. The postings themselves move once, to
    meet their positions; equal rows stand side by side and are counted there.
    """
    if batch_size <= 0:
        raise ValueError(f"batch size must be positive, not {batch_size}")
    copy = F.row_number().over(Window.partitionBy("_row", "_row2").orderBy(F.lit(1))) - 1
    keyed = written_once(postings.select("*", *row_key(postings.columns)), "keyed")
    placed = (
        keyed.join(numbered_keys(keyed, order), ["_row", "_row2"])
        .withColumn("_place", F.col("_first") + copy)
        .drop("_row", "_row2", "_first")
    )
    return (
        placed.withColumn("batch_index", F.call_function("div", F.col("_place"), F.lit(batch_size)))
        .withColumn("pos", F.pmod("_place", F.lit(batch_size)).cast("int"))
        .drop("_place")
    )


def batch_sizes(batched: DataFrame) -> DataFrame:
    """Per batch: postings sent, description bytes, estimated tokens."""
    return (
        batched.groupBy("batch_index")
        .agg(
            F.count("*").alias("jobs_sent"),
            F.sum(F.octet_length("description")).cast("bigint").alias("description_bytes"),
        )
        .withColumn("token_estimate", token_estimate(F.col("description_bytes")))
    )


def spread_batches(batched: DataFrame) -> DataFrame:
    """Brings each batch together, in as many tasks as the cluster is set up for.

    Requests are small but slow to answer, so tasks must not be merged by size, as
    adaptive execution would. The aggregate that follows needs no other shuffle.
    """
    tasks = int(batched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return batched.repartition(tasks, "batch_index")


def batch_requests(batched: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per batch with the user message. A batch holds at most its size.

    ``jobs`` lists the keys and the ``carry`` columns of its postings, in order, so that
    answers can be tied back without their texts.
    """
    carried = [name for name in carry if name not in PROMPT_FIELDS]
    placed = F.array_sort(F.collect_list(F.struct("pos", *PROMPT_FIELDS, *carried)))
    gathered = (
        spread_batches(batched).groupBy("batch_index")
        .agg(
            placed.alias("placed"),
            F.count("*").alias("jobs_sent"),
            F.sum(F.octet_length("description")).cast("bigint").alias("description_bytes"),
        )
    )

    def of_each(names: Sequence[str]) -> Column:
        return F.transform("placed", lambda job: F.struct(*[job[name].alias(name) for name in names]))

    return gathered.select(
        "batch_index", "jobs_sent", "description_bytes",
        token_estimate(F.col("description_bytes")).alias("token_estimate"),
        user_message(of_each(PROMPT_FIELDS)).alias("message"),
        of_each(dict.fromkeys(("pos", "key", *carry))).alias("jobs"),
    )
