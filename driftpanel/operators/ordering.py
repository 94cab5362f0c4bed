"""Positions and neighbours that stay spread out when one group is huge.

A plain window puts a whole group into one task. The functions here number or
look back within slices of a group and add the slices' totals, so the largest
task is one slice, however many rows a group holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from driftpanel.session import cut_lineage

POSITION_SLICE = 4096


def position_in_group(rows: DataFrame, group: Sequence[str], order: str, out: str,
                      slice_rows: int = POSITION_SLICE) -> DataFrame:
    """1-based row number per group by ``order``, a whole-number position.

    Slices are ranges of ``order``; their counts, not their rows, are summed up
    per group.
    """
    sliced = rows.withColumn("_slice", F.floor(F.col(order) / slice_rows))
    keys = [*group, "_slice"]
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*keys).agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return (
        sliced.withColumn("_within", within)
        .join(starts, keys)
        .withColumn(out, F.col("_before") + F.col("_within"))
        .drop("_slice", "_within", "_before")
    )


def position_overall(rows: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """0-based position in a total order, without a one-task window.

    Spark's range sort spreads the rows; each partition numbers its own and adds
    the sizes of the partitions before it. The sorted rows are materialised once,
    so that every consumer sees the same partition borders.
    """
    local = F.monotonically_increasing_id()
    numbered = cut_lineage(
        rows.orderBy(*order).withColumn("_id", local)
        .withColumn("_part", F.shiftright("_id", 33))
        .withColumn("_local", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_id")
    )
    # One row per partition of the sort.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        numbered.groupBy("_part").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        numbered.join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_before") + F.col("_local"))
        .drop("_part", "_local", "_before")
    )


def sorted_slices(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows with the number of their slice in the order of group and ``order``.

    Slices hold about equally many rows, however these crowd together in time or in
    one group; rows equal in group and order share one. They are materialised once, so
    that the borders are the same for every consumer.
    """
    ranged = rows.repartitionByRange(*group, *order)
    return cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))


def carried_over(totals: DataFrame, group: Sequence[str], value: str, carry: Column) -> DataFrame:
    """``carry``, over the group's earlier slices, for the slices that go on with a group.

    In sorted slices only the first group of a slice has earlier ones: at most one row a
    slice is left, which may be broadcast.
    """
    before = totals.select("_part", *group, carry.alias(value))
    return F.broadcast(before.filter(F.col(value).isNotNull()))


def same_group(left: DataFrame, right: DataFrame, group: Sequence[str]) -> Column:
    match = left["_part"] == right["_part"]
    for name in group:
        match = match & left[name].eqNullSafe(right[name])
    return match


def trailing_sum(rows: DataFrame, group: Sequence[str], micros: str, value: str, out: str,
                 span_micros: int) -> DataFrame:
    """Sum of ``value`` over the half-open span ``(t - span, t]`` per group.

    Each row adds its value at its moment and takes it away one span later, so the sum is
    one running total: linear in the rows, however many of them share a span.
    """
    leaves = rows.select(
        *group, (F.col(micros) + span_micros).alias(micros), (-F.col(value)).alias("_delta"), F.lit(False).alias("_asks"))
    marks = rows.withColumn("_delta", F.col(value)).withColumn("_asks", F.lit(True)).unionByName(
        leaves, allowMissingColumns=True)
    sliced = sorted_slices(marks, group, [micros])
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy("_part", *group).agg(F.sum("_delta").alias("_total"))
    carry = carried_over(totals, group, "_before", F.sum("_total").over(earlier))
    # Rows of the same moment count for each other.
    running = Window.partitionBy("_part", *group).orderBy(micros).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sliced.withColumn("_inside", F.sum("_delta").over(running)).filter("_asks")
    total = F.col("_inside") + F.coalesce(F.col("_before"), F.lit(0))
    return summed.join(carry, same_group(summed, carry, group), "left").select(
        *[summed[c] for c in rows.columns], total.alias(out))


def previous_value(rows: DataFrame, group: Sequence[str], micros: str, order: Sequence[str], out: str) -> DataFrame:
    """``micros`` of the row before, per group.

    Within a slice it is a lag; the first row of a slice takes the latest moment of the
    slice before it that has rows of the group.
    """
    sliced = sorted_slices(rows, group, [micros, *order])
    lasts = sliced.groupBy("_part", *group).agg(F.max(micros).alias("_last"))
    latest = F.lag("_last").over(Window.partitionBy(*group).orderBy("_part"))
    carry = carried_over(lasts, group, "_carry", latest)
    inside = F.lag(micros).over(Window.partitionBy("_part", *group).orderBy(micros, *order))
    lagged = sliced.withColumn("_inside", inside)
    return lagged.join(carry, same_group(lagged, carry, group), "left").select(
        *[lagged[c] for c in rows.columns], F.coalesce("_inside", "_carry").alias(out))
