"""Building, storing and choosing panels."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftpanel.config import RunConfig, SCREENING_TEMPERATURE
from driftpanel.functions.keys import panel_id
from driftpanel.functions.payload import job_payload
from driftpanel.operators.panel import banded_pool, dedupe_newest, draw_panel, last_scores, unscored
from driftpanel.operators.scoring import screen
from driftpanel.operators.waves import Landing, Scorer
from driftpanel.session import cut_lineage

SNAPSHOT_TYPE = (
    "key string, title string, company string, location string, description string, url string, "
    "source string, posted_at bigint, is_remote boolean"
)
POSTING_COLUMNS = (
    "key", "title", "company", "location", "description", "url", "source", "posted_at", "is_remote",
)


def draw_from(postings: DataFrame, scores: DataFrame, config: RunConfig, seed: int) -> DataFrame:
    """The drawn panel with full postings: ``seq``, band, score and posting columns.

    Picks are few, so the full rows come from a second, filtered pass instead of
    dragging descriptions through the shuffles of the draw.
    """
    pool = banded_pool(postings, scores, config.bands)
    picks = draw_panel(
        pool, config.bands, config.targets, config.panel_size, config.max_per_company, seed
    ).drop("company", "phase")
    few = F.broadcast(picks.select("stablekey"))  # at most a panel's worth of rows
    chosen = dedupe_newest(postings.join(few, "stablekey", "left_semi"), POSTING_COLUMNS)
    return chosen.join(F.broadcast(picks), "stablekey")


def panel_rows(drawn: DataFrame, seed: int, built_at: Column) -> DataFrame:
    """Rows of the panel table; all share one id and moment."""
    return drawn.select(
        panel_id(F.lit(seed), built_at).alias("panel_id"),
        "stablekey", "company",
        F.timestamp_seconds("posted_at").alias("posted_at"),
        "score_band", "screening_score",
        job_payload().alias("job_snapshot"),
        F.lit(seed).cast("bigint").alias("seed"),
        built_at.alias("built_at"),
    )


def store_panel(rows: DataFrame, path: str) -> None:
    """One write job for the whole panel, into its own partition.

    ``repartition`` rather than ``coalesce``: only the panel's few rows, not the work
    that finds them, belong in one task.
    """
    (
        rows.repartition(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("panel_id").parquet(path)
    )


def active_panel_id(panels: DataFrame) -> DataFrame:
    """Id of the newest panel; no row when there is none."""
    return panels.orderBy(F.desc("built_at"), F.desc("panel_id")).select("panel_id").limit(1)


def active_panel(panels: DataFrame, pinned: str = "") -> DataFrame:
    """Frozen postings of the pinned panel, or of the newest one."""
    if pinned:
        rows = panels.filter(F.col("panel_id") == pinned)
    else:
        rows = panels.join(F.broadcast(active_panel_id(panels)), "panel_id", "left_semi")
    snapshot = F.from_json("job_snapshot", SNAPSHOT_TYPE, {"mode": "FAILFAST"}).alias("j")
    restored = rows.select("panel_id", "stablekey", "score_band", "screening_score", snapshot)
    return restored.select(
        "panel_id", "stablekey", "score_band", "screening_score",
        *[F.col(f"j.{name}").alias(name) for name in POSTING_COLUMNS if name != "is_remote"],
        F.coalesce("j.is_remote", F.lit(False)).alias("is_remote"),
    )


def build_panel(postings: DataFrame, config: RunConfig, registry: Mapping[str, Scorer],
                now: datetime, path: str, landing: Landing | None = None, counts: dict | None = None) -> DataFrame:
    """Screens, draws and stores a panel, and gives its rows; a short one is kept.

    ``counts`` receives how many postings had no screening score and so were left out.
    """
    seed = config.seed(now)
    screened = screen(
        postings, config.screener(), registry, config.instructions, SCREENING_TEMPERATURE, landing
    )
    scores = cut_lineage(last_scores(screened, ("batch_index", "pos")))
    if counts is not None:
        counts["unscored"] = unscored(dedupe_newest(postings, ("key",)), scores).count()
    drawn = draw_from(postings, scores, config, seed)
    store_panel(panel_rows(drawn, seed, F.lit(now).cast("timestamp")), path)
    spark = postings.sparkSession
    return read_panels(spark, path).filter(F.col("panel_id") == _id_of(spark, seed, now))


def _id_of(spark: SparkSession, seed: int, now: datetime) -> str:
    return spark.range(1).select(panel_id(F.lit(seed), F.lit(now).cast("timestamp"))).first()[0]


def read_panels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_panel(spark: SparkSession, config: RunConfig, path: str) -> DataFrame | None:
    """The panel to grade, or null when one must be built.

    Pinning a panel that does not exist is an error.
    """
    if config.rebuild_panel:
        return None
    try:
        found = active_panel(read_panels(spark, path), config.active_panel_id)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # anything but "nothing stored yet"
            raise
        found = None
    if found is not None and found.isEmpty():
        found = None
    if found is None and config.active_panel_id:
        raise ValueError(f"panel {config.active_panel_id!r} does not exist")
    return found


def load_or_build(spark: SparkSession, config: RunConfig, postings, registry: Mapping[str, Scorer],
                  now: datetime, path: str, landing: Landing | None = None, counts: dict | None = None) -> DataFrame:
    """``postings`` is called only if a panel must be built, which skips collecting."""
    loaded = load_panel(spark, config, path)
    if loaded is None:
        loaded = active_panel(build_panel(postings(), config, registry, now, path, landing, counts))
    return loaded
