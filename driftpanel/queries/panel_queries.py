"""Queries over bands, batches and panels."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import functions as F

from driftpanel.config import (
    BandTarget, DEFAULT_BANDS, DEFAULT_PANEL_SIZE, DEFAULT_TARGETS, ModelConfig, RunConfig,
)
from driftpanel.operators import panel
from driftpanel.operators.batching import assign_batches, batch_requests, batch_sizes
from driftpanel.operators.scoring import candidates_route, grade, screen
from driftpanel.operators.waves import STARTS
from driftpanel.plans.panels import (
    active_panel, build_panel, draw_from, panel_rows, read_panels, store_panel,
)
from driftpanel.plans.runs import grade_run
from driftpanel.queries.registry import registered
from driftpanel.queries.standin import failing_from, offline_candidates, offline_scorer
from driftpanel.queries.views import postings, sql_over, text_postings
from driftpanel.session import scratch_path, written_once

SEED = 20260729143005
OTHER_SEED = 7
POOL_COLUMNS = ("key", "company", "posted_at", "url")
# Bands and targets with few fitting postings, so that the backfill has work.
SHORT_TARGETS = (
    BandTarget("reject", 4, 0), BandTarget("borderline_low", 3, 5), BandTarget("viable", 8, 8),
)


def _scores(rows):
    """Last screening score per job key: the one with the greatest url."""
    return panel.last_scores(rows, ("url",))


BAND_SQL = """CASE WHEN {s} >= 0 AND {s} < 40 THEN 'reject' WHEN {s} >= 40 AND {s} < 60 THEN 'borderline_low'
    WHEN {s} >= 60 AND {s} < 80 THEN 'borderline_high' WHEN {s} >= 80 AND {s} <= 100 THEN 'viable' END"""

POOL_SQL = f"""
    , scores AS (SELECT key, arg_max(score, url) AS screening_score FROM postings GROUP BY key),
    newest AS (
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY stablekey ORDER BY posted_at DESC, url DESC) AS rn FROM postings)
        WHERE rn = 1),
    pool AS MATERIALIZED (
        SELECT newest.*, screening_score, {BAND_SQL.format(s='screening_score')} AS score_band
        FROM newest JOIN scores USING (key))"""


def draw_sql(seed: int, targets, size: int, cap: int) -> str:
    """The draw, band after band, as chained CTEs: picks(seq, stablekey, score_band, phase)."""
    top_first = [b.name for b in sorted(DEFAULT_BANDS, key=lambda b: -b.min)]
    goal = {t.band: t for t in targets}
    steps, parts = [], []

    def selected(columns: str) -> str:
        if not steps:
            return f"SELECT {columns} FROM pool WHERE false"
        return " UNION ALL ".join(f"SELECT {columns} FROM {name}" for name in steps)

    def add(phase: int, band: str, n: str) -> None:
        name = f"s{len(steps)}"
        room = f"rr <= {cap} - coalesce(t.taken, 0)" if cap > 0 else "true"
        parts.append(f"""
        {name} AS MATERIALIZED (
            SELECT * FROM (
                SELECT stablekey, company, score_band, screening_score, {phase} AS phase, {len(steps)} AS step,
                       row_number() OVER (ORDER BY rr, md5('{seed}:{phase}:{band}:' || company), company) AS turn
                FROM (
                    SELECT p.*, row_number() OVER (PARTITION BY p.company
                               ORDER BY md5('{seed}:{phase}:{band}:' || p.stablekey), p.stablekey) AS rr
                    FROM pool p WHERE score_band = '{band}'
                      AND p.stablekey NOT IN ({selected('stablekey')})) q
                LEFT JOIN (SELECT company AS c, count(*) AS taken FROM ({selected('company')}) GROUP BY 1) t
                       ON t.c = q.company
                WHERE {room})
            WHERE turn <= {n})""")
        steps.append(name)

    for band in top_first:
        if band in goal and goal[band].floor > 0:
            add(1, band, str(goal[band].floor))
    for band in top_first:
        if band in goal:
            add(2, band, f"{goal[band].target} - (SELECT count(*) FROM ({selected('score_band')}) WHERE score_band = '{band}')")
    for band in top_first:
        add(3, band, f"{size} - (SELECT count(*) FROM ({selected('stablekey')}))")
    return ", ".join(["", *parts]) + f""",
        picks AS MATERIALIZED (
            SELECT * FROM (
                SELECT stablekey, company, score_band, screening_score, phase, row_number() OVER (ORDER BY step, turn) AS seq
                FROM ({selected('stablekey, company, score_band, screening_score, phase, step, turn')}))
            WHERE seq <= {size})"""


def _panel_sql(seed: int, targets, size: int, cap: int, columns: str) -> str:
    return sql_over("postings", body=POOL_SQL + draw_sql(seed, targets, size, cap) + f" SELECT {columns} FROM picks")


PICKS = "seq, stablekey, company, score_band, screening_score, phase"


def _draw(spark, sf_dir, targets, size, cap, seed):
    rows = postings(spark, sf_dir)
    pool = panel.banded_pool(rows, _scores(rows), DEFAULT_BANDS)
    return panel.draw_panel(pool, DEFAULT_BANDS, targets, size, cap, seed)


@registered(_panel_sql(SEED, DEFAULT_TARGETS, DEFAULT_PANEL_SIZE, 0, PICKS))
def panel_draw(spark, sf_dir):
    return _draw(spark, sf_dir, DEFAULT_TARGETS, DEFAULT_PANEL_SIZE, 0, SEED)


@registered(_panel_sql(SEED, SHORT_TARGETS, DEFAULT_PANEL_SIZE, 2, PICKS))
def panel_draw_capped(spark, sf_dir):
    return _draw(spark, sf_dir, SHORT_TARGETS, DEFAULT_PANEL_SIZE, 2, SEED)


@registered(_panel_sql(OTHER_SEED, SHORT_TARGETS, 12, 0, PICKS))
def panel_draw_truncated(spark, sf_dir):
    """Floors and targets beyond the size: the first slots in selection order stay."""
    return _draw(spark, sf_dir, SHORT_TARGETS, 12, 0, OTHER_SEED)


@registered(sql_over("postings", body=POOL_SQL + draw_sql(OTHER_SEED, DEFAULT_TARGETS, DEFAULT_PANEL_SIZE, 0) + f"""
    SELECT 'panel-{OTHER_SEED}-20260730T080000Z' AS panel_id, stablekey, picks.score_band, picks.screening_score, key, title,
           url, posted_at, is_remote
    FROM picks JOIN pool USING (stablekey)"""))
def active_panel_stored(spark, sf_dir):
    """Two panels stored; the newer one is the active one."""
    path = scratch_path(spark, "panels")
    rows = postings(spark, sf_dir)
    scores = _scores(rows)
    for seed, built in ((SEED, "2026-07-29 08:00:00"), (OTHER_SEED, "2026-07-30 08:00:00")):
        drawn = draw_from(rows, scores, RunConfig(), seed)
        store_panel(panel_rows(drawn, seed, F.lit(built).cast("timestamp")), path)
    return active_panel(read_panels(spark, path)).select(
        "panel_id", "stablekey", "score_band", "screening_score", "key", "title", "url", "posted_at", "is_remote"
    )


@registered(sql_over("postings", body=POOL_SQL + """
    SELECT stablekey, key, company, posted_at, url FROM newest"""))
def dedupe_newest(spark, sf_dir):
    return panel.dedupe_newest(postings(spark, sf_dir), POOL_COLUMNS)


@registered(sql_over("postings", body=f"""
    SELECT order_id, score, {BAND_SQL.format(s='score')} AS score_band FROM postings"""))
def band_assign(spark, sf_dir):
    return postings(spark, sf_dir).select(
        "order_id", "score", panel.strict_band(F.col("score"), DEFAULT_BANDS).alias("score_band")
    )


@registered(sql_over("postings", body=POOL_SQL + """
    , t(score_band, target, floor) AS (VALUES ('reject', 4, 0), ('borderline_low', 8, 0), ('viable', 8, 8))
    SELECT score_band, available, target, floor
    FROM (SELECT score_band, count(*) AS available FROM pool GROUP BY 1) LEFT JOIN t USING (score_band)"""))
def band_counts(spark, sf_dir):
    rows = postings(spark, sf_dir)
    targets = spark.createDataFrame(
        [(t.band, t.target, t.floor) for t in DEFAULT_TARGETS if t.band != "borderline_high"],
        "band string, target int, floor int",
    )
    return panel.band_fill(panel.banded_pool(rows, _scores(rows), DEFAULT_BANDS), targets)


SCREENED_SQL = """
    , scores AS (
        SELECT key, arg_max(score, order_id) AS screening_score FROM postings WHERE order_id % 9 <> 0 GROUP BY key),
    newest AS (
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY stablekey ORDER BY posted_at DESC, url DESC) AS rn FROM postings)
        WHERE rn = 1)"""


@registered(sql_over("postings", body=SCREENED_SQL + """
    SELECT stablekey, key, screening_score FROM newest LEFT JOIN scores USING (key)"""))
def screening_scores(spark, sf_dir):
    """Postings with their last screening score, and those that got none."""
    rows = postings(spark, sf_dir)
    screened = rows.filter(F.col("order_id") % 9 != 0).select(
        "key", "score", F.floor(F.col("order_id") / 2).alias("batch_index"), (F.col("order_id") % 2).alias("pos")
    )
    scores = panel.last_scores(screened, ("batch_index", "pos"))
    newest = panel.dedupe_newest(rows, POOL_COLUMNS)
    scored = newest.join(scores, "key").select("stablekey", "key", "screening_score")
    missing = panel.unscored(newest, scores).select("stablekey", "key", F.lit(None).cast("double").alias("screening_score"))
    return scored.unionByName(missing)


@registered(sql_over("postings", body="""
    , n AS (SELECT order_id, row_number() OVER (ORDER BY stablekey, posted_at, url) - 1 AS place FROM postings)
    SELECT order_id, place // 10 AS batch_index, CAST(place % 10 AS INT) AS pos FROM n"""))
def batch_assignment(spark, sf_dir):
    return assign_batches(postings(spark, sf_dir), 10).select("order_id", "batch_index", "pos")


TEXT_BATCH_SQL = """
    , n AS (SELECT *, (row_number() OVER (ORDER BY stablekey, posted_at, url) - 1) AS place FROM text_postings)"""


@registered(sql_over("text_postings", body=TEXT_BATCH_SQL + """
    , b AS (
        SELECT place // 5 AS batch_index, count(*) AS jobs_sent, CAST(sum(strlen(description)) AS BIGINT) AS description_bytes,
               'Jobs to score:' || chr(10) || '[' || string_agg(CAST(json_object('key', key, 'title', title, 'company', company,
                    'location', location, 'description', description) AS VARCHAR), ',' ORDER BY place) || ']' AS message
        FROM n GROUP BY 1)
    SELECT batch_index, jobs_sent, description_bytes, 3000 + description_bytes / 1.75::DOUBLE AS token_estimate,
           md5(replace(replace(replace(message, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')) AS message_md5
    FROM b"""))
def batch_prompt_payload(spark, sf_dir):
    requests = batch_requests(assign_batches(text_postings(spark, sf_dir), 5))
    return requests.select(
        "batch_index", "jobs_sent", "description_bytes", "token_estimate", F.md5("message").alias("message_md5")
    )


@registered(sql_over("text_postings", body=TEXT_BATCH_SQL + """
    SELECT place // 3 AS batch_index, count(*) AS jobs_sent, CAST(sum(strlen(description)) AS BIGINT) AS description_bytes,
           3000 + sum(strlen(description)) / 1.75::DOUBLE AS token_estimate
    FROM n GROUP BY 1"""))
def batch_token_estimate(spark, sf_dir):
    return batch_sizes(assign_batches(text_postings(spark, sf_dir), 3))


@registered(sql_over("postings", body=POOL_SQL + draw_sql(SEED, DEFAULT_TARGETS, DEFAULT_PANEL_SIZE, 0) + """
    SELECT company, count(*) FILTER (stablekey IN (SELECT stablekey FROM picks)) AS selected,
           count(*) FILTER (stablekey NOT IN (SELECT stablekey FROM picks)) AS remaining
    FROM pool GROUP BY company"""))
def company_counts_and_remaining(spark, sf_dir):
    rows = postings(spark, sf_dir)
    pool = panel.banded_pool(rows, _scores(rows), DEFAULT_BANDS)
    picks = panel.draw_panel(pool, DEFAULT_BANDS, DEFAULT_TARGETS, DEFAULT_PANEL_SIZE, 0, SEED)
    left = panel.remaining_pool(pool, picks).groupBy("company").agg(F.count("*").alias("remaining"))
    both = panel.company_counts(picks).join(left, "company", "full_outer")
    return both.fillna(0, ["selected", "remaining"])


SCREENER = ModelConfig("screener", "screener-a", False, 200000, 60, "offline", "offline:")
GRADERS = (
    ModelConfig("grader-a", "host-1", False, 200000, 60, "offline", "offline:"),
    ModelConfig("grader-b", "host-2", False, 200000, 60, "offline", "offline:"),
    ModelConfig("grader-idle", "host-3", False, 0, 60, "offline", "offline:"),
    ModelConfig("grader-nowhere", "host-4", False, 200000, 60, "offline", ""),
    ModelConfig("grader-other", "host-5", False, 200000, 60, "unheard-of", "offline:"),
)
REGISTRY = {"offline": offline_scorer}


def _offline_sql(model: str, key: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({model} || ':' || {key}), 1, 6) AS BIGINT) % 101 AS DOUBLE)"


@registered(sql_over("postings", body=f"""
    SELECT key, count(*) AS results, {_offline_sql("'screener'", 'key')} AS screening_score
    FROM postings GROUP BY key"""))
def screening_pass(spark, sf_dir):
    screened = screen(postings(spark, sf_dir), SCREENER, REGISTRY, "score these", 0.0)
    counts = screened.groupBy("key").agg(F.count("*").alias("results"))
    return counts.join(panel.last_scores(screened, ("batch_index", "pos")), "key")


BUILT_AT = datetime(2026, 7, 29, 14, 30, 5, tzinfo=timezone.utc)
BUILT_SQL = f"""
    , newest AS (
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY stablekey ORDER BY posted_at DESC, url DESC) AS rn FROM postings)
        WHERE rn = 1),
    pool AS MATERIALIZED (
        SELECT *, {BAND_SQL.format(s='screening_score')} AS score_band
        FROM (SELECT *, {_offline_sql("'screener'", 'key')} AS screening_score FROM newest))"""


def _built(spark, sf_dir):
    config = RunConfig(models=(SCREENER, *GRADERS), screening_model="screener", max_per_company=3)
    # Screening and drawing pass over the postings several times; a run writes them first, too.
    collected = written_once(postings(spark, sf_dir), "collected")
    return active_panel(
        build_panel(collected, config, REGISTRY, BUILT_AT, scratch_path(spark, "panels"))
    )


@registered(sql_over("postings", body=BUILT_SQL + draw_sql(SEED, DEFAULT_TARGETS, DEFAULT_PANEL_SIZE, 3) + f"""
    SELECT 'panel-{SEED}-20260729T143005Z' AS panel_id, stablekey, picks.score_band, picks.screening_score, url
    FROM picks JOIN pool USING (stablekey)"""))
def panel_build(spark, sf_dir):
    """Screen, draw, store and read back; the seed comes from the moment of the build."""
    return _built(spark, sf_dir).select("panel_id", "stablekey", "score_band", "screening_score", "url")


@registered(sql_over("postings", body=f"""
    , n AS (SELECT *, row_number() OVER (ORDER BY stablekey, posted_at, url) - 1 AS place FROM postings)
    SELECT m.model, n.place // 5 AS batch_index, n.order_id, {_offline_sql('m.model', 'n.key')} AS emitted_score,
           'offline ' || n.title AS reasoning
    FROM n, (VALUES ('grader-a'), ('grader-b')) m(model)"""))
def grade_run_events(spark, sf_dir):
    """Every posting graded by every model that can be called, in batches of five."""
    _, events = grade(postings(spark, sf_dir), GRADERS, REGISTRY, "score these", 1.0, 5, carry=("order_id",))
    return events.select("model", "batch_index", "order_id", "emitted_score", "reasoning")


FAILS_FROM = 20
PROTOCOLS = (
    ModelConfig("grader-a", "host-1", False, 200000, 60, "offline", "offline:"),
    ModelConfig("grader-b", "host-2", False, 200000, 60, "candidates", "offline:"),
)
BOTH = {"offline": failing_from(offline_scorer, FAILS_FROM, "grader-a"), "candidates": candidates_route(offline_candidates)}


@registered(sql_over("postings", body=f"""
    , b AS (SELECT place // 4 AS batch_index, count(*) AS jobs_sent
            FROM (SELECT row_number() OVER (ORDER BY stablekey, posted_at, url) - 1 AS place FROM postings) GROUP BY 1),
    w AS (SELECT min(start) AS stop FROM (VALUES {', '.join(f'({start})' for start in STARTS[1:8])}) s(start) WHERE start > {FAILS_FROM})
    SELECT m.model, b.batch_index, b.jobs_sent, m.model = 'grader-b' OR b.batch_index < stop AS asked,
           m.model = 'grader-b' OR b.batch_index <= {FAILS_FROM} AS attempted,
           CASE WHEN m.model = 'grader-b' OR b.batch_index < {FAILS_FROM} THEN 'ok' WHEN b.batch_index < stop THEN 'failed' END AS outcome
    FROM b, w, (VALUES ('grader-a'), ('grader-b')) m(model)"""))
def waves_of_calls(spark, sf_dir):
    """Two protocols; one model fails, and nothing is asked of it after the wave it failed in."""
    outcomes, _ = grade(postings(spark, sf_dir), PROTOCOLS, BOTH, "score these", 1.0, 4)
    return outcomes.select("model", "batch_index", F.col("jobs_sent").cast("bigint").alias("jobs_sent"), "asked", "attempted", "outcome")


RUN_BATCH = 20


@registered(sql_over("postings", body=f"""
    , m AS (SELECT * FROM postings WHERE is_remote AND contains(lower(title || ' ' || location), 'high')),
    n AS (SELECT (SELECT count(*) FROM postings) AS collected, count(*) AS matched, count(DISTINCT composite_key) AS jobs,
                 CAST(ceil(count(*) / {RUN_BATCH}) AS BIGINT) AS calls FROM m),
    g AS (SELECT unnest(['grader-a', 'grader-b']) AS model)
    SELECT 'funnel' AS stored, 'collected' AS name, collected AS n FROM n
    UNION ALL SELECT 'funnel', 'matched', matched FROM n
    UNION ALL SELECT 'jobs', '', jobs FROM n
    UNION ALL SELECT unnest(['answers', 'calls', 'outcomes']), model, calls FROM n, g
    UNION ALL SELECT unnest(['events', 'expected', 'actual']), model, matched FROM n, g
    UNION ALL SELECT 'refused', unnest(['grader-idle', 'grader-nowhere', 'grader-other']), 1
    UNION ALL SELECT 'runs', 'main', {RUN_BATCH}"""))
def run_repeated(spark, sf_dir):
    """A whole run, repeated under its id: all its tables, as one attempt leaves them."""
    root = scratch_path(spark, "run")
    config = RunConfig(
        models=(SCREENER, *GRADERS), screening_model="screener", panel_enabled=False, include=("HIGH",),
        contributor_id="me", batch_size_override=RUN_BATCH)
    for _ in range(2):
        t = grade_run(spark, config, lambda: postings(spark, sf_dir), REGISTRY, BUILT_AT, root, "r1")
    events = t["events"].join(t["calls"].select("call_id", "model"), "call_id")

    def per_model(stored: str, rows, n=None):
        return rows.groupBy(F.col("model").alias("name")).agg((n if n is not None else F.count("*")).alias("n")).select(
            F.lit(stored).alias("stored"), "name", F.col("n").cast("bigint").alias("n"))

    parts = [
        t["funnel"].select(F.lit("funnel").alias("stored"), F.col("step").alias("name"), F.col("rows").alias("n")),
        t["jobs"].agg(F.count("*").alias("n")).select(F.lit("jobs").alias("stored"), F.lit("").alias("name"), "n"),
        *[per_model(name, t[name]) for name in ("answers", "calls", "outcomes", "refused")],
        per_model("events", events),
        *[per_model(name, t["totals"], F.sum(name)) for name in ("expected", "actual")],
        t["runs"].select(F.lit("runs").alias("stored"), F.col("run_kind").alias("name"), F.col("batch_size").cast("bigint").alias("n")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
