"""Drawing a score-stratified panel.

The draw itself touches few rows: a panel has tens of slots. What is large is
the pool. One pass dedupes the pool, bands it and keeps, per phase and band,
only the postings that the draw could ever reach; the bound depends on the panel
size alone (see ``reachable``). The phases then run on that small table.

Order within a draw comes from ``md5(seed:phase:band:name)``, so the same pool
and seed always give the same panel, and another seed another one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from driftpanel.config import BandTarget, ScoreBand
from driftpanel.session import cut_lineage

FLOORS, TARGETS, BACKFILL = 1, 2, 3
POOL_COLUMNS = ("score_band", "company", "stablekey", "screening_score")


def dedupe_newest(postings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per stable key: the newest posting; ties go to the greatest url."""
    best = F.max_by(F.struct(*columns), F.struct("posted_at", "url")).alias("best")
    return postings.groupBy("stablekey").agg(best).select("stablekey", "best.*")


def last_scores(screened: DataFrame, order: Sequence[str]) -> DataFrame:
    """Screening score per job key; the last one written counts."""
    return screened.groupBy("key").agg(
        F.max_by("score", F.struct(*order)).alias("screening_score")
    )


def ascending(bands: Sequence[ScoreBand]) -> list[ScoreBand]:
    return sorted(bands, key=lambda band: band.min)


def band_of(score: Column, bands: Sequence[ScoreBand]) -> Column:
    """Name of the first band holding the score; only the top one includes its end."""
    ordered = ascending(bands)
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for band in ordered:
        upper = score <= band.max if band is ordered[-1] else score < band.max
        chain = chain.when((score >= band.min) & upper, band.name)
    return chain


def strict_band(score: Column, bands: Sequence[ScoreBand]) -> Column:
    """Like ``band_of``, but a score outside all bands fails the job."""
    message = F.concat(F.lit("no score band holds "), score.cast("string"))
    return F.coalesce(band_of(score, bands), F.raise_error(message).cast("string"))


def banded_pool(postings: DataFrame, scores: DataFrame, bands: Sequence[ScoreBand]) -> DataFrame:
    """Newest posting per stable key with its score and band.

    A posting without a score is left out; it does not count as zero.
    """
    newest = dedupe_newest(postings, ("key", "company", "posted_at", "url"))
    return newest.join(scores, "key").withColumn(
        "score_band", strict_band(F.col("screening_score"), bands)
    )


def unscored(postings: DataFrame, scores: DataFrame) -> DataFrame:
    """Postings that the screening returned nothing for."""
    return postings.join(scores, "key", "left_anti")


def _shuffled(seed: int, name: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("phase").cast("string"), "score_band", name))


def reachable(pool: DataFrame, seed: int, depth: int) -> DataFrame:
    """The part of the pool a draw can reach.

    A step takes at most ``n`` postings while at most ``s`` are already selected.
    At most ``s`` companies can be used up or capped, so it reaches no further
    than the first ``n + s`` companies of its shuffle; and within a company no
    further than the first ``n + s`` postings. ``depth`` is that sum.
    """
    phased = pool.select(
        *POOL_COLUMNS,
        F.explode(F.array(*[F.lit(p) for p in (FLOORS, TARGETS, BACKFILL)])).alias("phase"),
    )
    step = ("phase", "score_band")
    companies = (
        phased.select(*step, "company").distinct()
        .withColumn("company_hash", _shuffled(seed, "company"))
        .withColumn("_rank", F.row_number().over(
            Window.partitionBy(*step).orderBy("company_hash", "company")))
        .filter(F.col("_rank") <= depth).drop("_rank")
    )
    # Three phases, a few bands, ``depth`` companies each; Spark broadcasts them while
    # they are few.
    return (
        phased.join(companies, [*step, "company"])
        .withColumn("job_hash", _shuffled(seed, "stablekey"))
        .withColumn("_rank", F.row_number().over(
            Window.partitionBy(*step, "company").orderBy("job_hash", "stablekey")))
        .filter(F.col("_rank") <= depth).drop("_rank")
    )


def round_robin(candidates: DataFrame, wanted: Mapping[str, int], picked: DataFrame,
                max_per_company: int) -> DataFrame:
    """Up to ``wanted`` postings per band, one per company and round.

    ``picked`` has the ``company`` of each posting selected so far.
    """
    rounds = Window.partitionBy("score_band", "company").orderBy("job_hash", "stablekey")
    ranked = candidates.withColumn("round", F.row_number().over(rounds))
    if max_per_company > 0:
        taken = picked.groupBy("company").agg(F.count("*").alias("taken"))
        ranked = ranked.join(taken, "company", "left").filter(
            F.col("round") <= max_per_company - F.coalesce("taken", F.lit(0))
        ).drop("taken")
    turn = Window.partitionBy("score_band").orderBy("round", "company_hash", "company")
    limit = F.lit(0)
    for band, count in wanted.items():
        limit = F.when(F.col("score_band") == band, count).otherwise(limit)
    return ranked.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= limit)


class _Draw:
    """Slots filled so far; never more than the panel's floors, targets and size."""

    def __init__(self, candidates: DataFrame, max_per_company: int):
        self.candidates = candidates
        self.max_per_company = max_per_company
        self.picks: list[Row] = []

    def _picked(self) -> DataFrame:
        rows = [(pick.stablekey, pick.company) for pick in self.picks]
        return self.candidates.sparkSession.createDataFrame(rows, "stablekey string, company string")

    def in_band(self, band: str) -> int:
        return sum(pick.score_band == band for pick in self.picks)

    def take(self, phase: int, wanted: Mapping[str, int], top_first: Sequence[str]) -> None:
        wanted = {band: n for band, n in wanted.items() if n > 0}
        if not wanted:
            return
        pool = self.candidates.filter(
            (F.col("phase") == phase) & F.col("score_band").isin(*wanted)
        )
        picked = self._picked()
        if self.picks:
            pool = pool.join(picked.select("stablekey"), "stablekey", "left_anti")
        taken = round_robin(pool, wanted, picked, self.max_per_company).select(
            "stablekey", "company", "score_band", "screening_score", "phase", "turn"
        ).collect()  # at most sum(wanted) rows, a panel's worth
        self.picks += sorted(taken, key=lambda pick: (top_first.index(pick.score_band), pick.turn))


def draw_panel(pool: DataFrame, bands: Sequence[ScoreBand], targets: Sequence[BandTarget], size: int,
               max_per_company: int, seed: int) -> DataFrame:
    """Picks of the panel in selection order, ``seq``, with their band, score and phase.

    Floors first, then what is missing to the targets, then any band until the
    panel is full; the top band always comes first. With a company cap a band
    depends on the ones before it and the bands take turns; without one, all bands
    of a phase are drawn at once.
    """
    spark = pool.sparkSession
    top_first = [band.name for band in reversed(ascending(bands))]
    goal = {t.band: t for t in targets}
    depth = size + sum(max(t.target, 0) + max(t.floor, 0) for t in targets)
    # The pool is read for its companies and for its postings; deduplicating it twice
    # would cost more than writing its four narrow columns.
    narrow = cut_lineage(pool.select(*POOL_COLUMNS))
    draw = _Draw(cut_lineage(reachable(narrow, seed, depth)), max_per_company)

    def groups(names: Sequence[str]) -> list[list[str]]:
        return [[name] for name in names] if max_per_company > 0 else [list(names)]

    targeted = [name for name in top_first if name in goal]
    for names in groups(targeted):
        draw.take(FLOORS, {name: goal[name].floor for name in names}, top_first)
    for names in groups(targeted):
        draw.take(TARGETS, {name: goal[name].target - draw.in_band(name) for name in names}, top_first)
    for name in top_first:
        draw.take(BACKFILL, {name: size - len(draw.picks)}, top_first)
    rows = [
        (seq, pick.stablekey, pick.company, pick.score_band, pick.screening_score, pick.phase)
        for seq, pick in enumerate(draw.picks[:size], start=1)
    ]
    return spark.createDataFrame(
        rows,
        "seq int, stablekey string, company string, score_band string, screening_score double, phase int",
    )


def remaining_pool(pool: DataFrame, selected: DataFrame) -> DataFrame:
    return pool.join(selected.select("stablekey"), "stablekey", "left_anti")


def company_counts(selected: DataFrame) -> DataFrame:
    return selected.groupBy("company").agg(F.count("*").alias("selected"))


def band_fill(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """Postings per band next to its target and floor; bands without one keep nulls."""
    counts = pool.groupBy("score_band").agg(F.count("*").alias("available"))
    return counts.join(targets.withColumnRenamed("band", "score_band"), "score_band", "left")
