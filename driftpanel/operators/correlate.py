"""Tying the results of a batch back to its postings.

``correlate`` works on stored postings and results as tables; batches of ordinary size
pair inside a row, larger ones as joins. ``correlate_calls`` serves a grading run,
where the batch size bounds both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from driftpanel.functions.binding import bind, bind_all
from driftpanel.functions.items import SENTINEL_SCORE
from driftpanel.operators.ordering import position_in_group
from driftpanel.session import cut_lineage

IN_ROW = 256  # positions that are gathered in one row


def batch_chunks(jobs: DataFrame, results: DataFrame, batch: Sequence[str],
                 job_columns: Sequence[str], carried: Sequence[str], in_row: int) -> DataFrame:
    """Both sides of every batch, gathered by one shuffle of their union.

    Rows are gathered by ranges of ``in_row`` positions, so a row here is bounded however
    large a batch is. ``more`` says that the batch goes on beyond its first range.
    """
    job = F.struct(F.col("pos"), "key", *job_columns)
    item = F.struct(F.col("pos"), "job_key", "emitted_score", "ev_score", *carried)

    def side(rows: DataFrame, name: str, entry: Column) -> DataFrame:
        chunk = F.floor(F.col("pos") / in_row)
        # A row beyond the first range tells that range so.
        places = F.when(chunk == 0, F.array(F.struct(chunk.alias("chunk"), F.lit(False).alias("more")))).otherwise(
            F.array(F.struct(chunk.alias("chunk"), F.lit(False).alias("more")),
                    F.struct(F.lit(0).cast("bigint").alias("chunk"), F.lit(True).alias("more"))))
        placed = rows.select(*batch, entry.alias(name), F.explode(places).alias("at"))
        return placed.select(*batch, "at.chunk", "at.more", F.when(~F.col("at.more"), F.col(name)).alias(name))

    union = side(jobs, "job", job).unionByName(side(results, "item", item), allowMissingColumns=True)
    return union.groupBy(*batch, "chunk").agg(
        F.array_sort(F.collect_list("job")).alias("jobs"), F.array_sort(F.collect_list("item")).alias("items"),
        F.max("more").alias("more"),
    )


def correlate(jobs: DataFrame, results: DataFrame, batch: Sequence[str],
              job_columns: Sequence[str], result_columns: Sequence[str], in_row: int = IN_ROW) -> DataFrame:
    """Events of every batch, by key first and then by position.

    ``jobs`` has ``key`` and ``pos``; ``results`` has ``job_key``, ``pos``,
    ``emitted_score`` and ``ev_score``. Positions count from 0 and are unique per batch and
    side. The first result of a key serves every job with that key. Jobs and results left
    over pair up in order and carry the sentinel score; what then remains on either side is
    dropped.

    Each input is read once and shuffled once. Batches within ``in_row`` positions pair
    inside their row; only larger ones are numbered in slices.
    """
    batch, job_columns = list(batch), list(job_columns)
    carried = [c for c in result_columns if c not in ("emitted_score", "ev_score")]
    chunks = cut_lineage(batch_chunks(jobs, results, batch, job_columns, carried, in_row))
    small = correlate_calls(chunks.filter("chunk = 0 and not more"), batch, job_columns, carried, "pos")
    large = chunks.filter("chunk > 0").select(*batch).distinct()
    if large.isEmpty():
        return small
    rest = chunks.join(large, batch, "left_semi")

    def flat(column: str) -> DataFrame:
        return rest.select(*batch, F.explode(column).alias("r")).select(*batch, "r.*")

    return small.unionByName(correlate_large(flat("jobs"), flat("items"), batch, job_columns, carried))


def correlate_large(jobs: DataFrame, results: DataFrame, batch: Sequence[str],
                    job_columns: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """The same for batches of any size, as joins; no task holds a batch."""
    answer = F.struct("pos", "emitted_score", "ev_score", *carried)
    first = (
        results.filter(F.col("job_key") != "")
        .groupBy(*batch, F.col("job_key").alias("key"))
        .agg(F.min_by(answer, F.col("pos")).alias("answer"))
    )
    looked_up = jobs.select(*batch, F.col("pos").alias("job_pos"), "key", *job_columns).join(
        first, [*batch, "key"], "left"
    )

    def event(paired: bool):
        picked = [F.col(f"answer.{name}").alias(name) for name in carried]
        emitted = F.lit(SENTINEL_SCORE) if paired else F.col("answer.emitted_score")
        ev = F.lit(None).cast("double") if paired else F.col("answer.ev_score")
        return [
            *batch, "job_pos", "key", *job_columns, F.col("answer.pos").alias("result_pos"),
            emitted.alias("emitted_score"), ev.alias("ev_score"), *picked,
            F.lit(not paired).alias("by_key"),
        ]

    matched = looked_up.filter(F.col("answer").isNotNull()).select(*event(paired=False))
    claimed = matched.select(*batch, F.col("result_pos").alias("pos")).distinct()
    leftover = results.join(claimed, [*batch, "pos"], "left_anti").select(*batch, "pos", answer.alias("answer"))
    unmatched = looked_up.filter(F.col("answer").isNull()).drop("answer")
    paired = position_in_group(unmatched, batch, "job_pos", "place").join(
        position_in_group(leftover, batch, "pos", "place").drop("pos"), [*batch, "place"]
    )
    return matched.unionByName(paired.select(*event(paired=True)))


def pair_in_call(jobs: Column, items: Column) -> Column:
    """The same pairing for one call, whose postings and items are arrays in one row.

    A call holds at most a batch, so no shuffle is needed. ``jobs`` are structs with
    ``key``, ``items`` structs with ``job_key``. Gives structs of ``job``,
    ``result_pos`` (counted from zero), ``item`` and ``by_key``.
    """

    def claim_of(keys: Column, job: Column) -> Column:
        hit = F.when(job["key"] != "", F.array_position(keys, job["key"]))
        return F.coalesce(hit, F.lit(0)).cast("int")

    def pairs(call: Column) -> Column:
        claims = call["claims"]
        slots = F.transform(call["items"], lambda _, at: at + 1)
        return bind(
            F.filter(slots, lambda slot: ~F.array_contains(claims, slot)),
            lambda free: F.filter(F.transform(call["jobs"], one_pair(call, free)), lambda p: p["item"].isNotNull()),
        )

    def one_pair(call: Column, free: Column):
        def pair(job: Column, at: Column) -> Column:
            claim = F.get(call["claims"], at)
            unmatched_before = F.size(F.filter(F.slice(call["claims"], F.lit(1), at), lambda c: c == 0))
            slot = F.when(claim > 0, claim).otherwise(F.get(free, unmatched_before))
            return F.struct(
                job.alias("job"), (slot - 1).alias("result_pos"),
                F.get(call["items"], slot - 1).alias("item"), (claim > 0).alias("by_key"),
            )

        return pair

    keys = F.transform(items, lambda item: item["job_key"])
    claims = bind(keys, lambda bound: F.transform(jobs, lambda job: claim_of(bound, job)))
    return bind_all(pairs, jobs=jobs, items=items, claims=claims)


def correlate_calls(calls: DataFrame, call_columns: Sequence[str], job_columns: Sequence[str],
                    item_columns: Sequence[str], result_pos: str | None = None) -> DataFrame:
    """Events of calls that carry their postings (``jobs``) and their items (``items``).

    ``result_pos`` names the items' own position, if it is not their place in the array.
    """
    paired = calls.select(*call_columns, F.explode_outer(pair_in_call(F.col("jobs"), F.col("items"))).alias("p"))
    by_key = F.col("p.by_key")
    return paired.filter(F.col("p").isNotNull()).select(
        *call_columns, F.col("p.job.pos").alias("job_pos"), F.col("p.job.key").alias("key"),
        *[F.col(f"p.job.{name}").alias(name) for name in job_columns],
        (F.col(f"p.item.{result_pos}") if result_pos else F.col("p.result_pos")).alias("result_pos"),
        F.when(by_key, F.col("p.item.emitted_score")).otherwise(SENTINEL_SCORE).alias("emitted_score"),
        F.when(by_key, F.col("p.item.ev_score")).alias("ev_score"),
        *[F.col(f"p.item.{name}").alias(name) for name in item_columns],
        "p.by_key",
    )
