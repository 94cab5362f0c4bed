"""Queries for the analyses the ledger exists for."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftpanel.functions.quota import error_class
from driftpanel.plans import drift
from driftpanel.queries.registry import registered
from driftpanel.queries.views import exact_mean, ledger, postings, sql_over, text_postings, valid_ledger


def _rounded(df, *columns):
    for name in columns:
        df = df.withColumn(name, F.round(name, 6))
    return df


PRICES_SQL = f"""
    , prices AS (
        SELECT model, epoch_us(CAST(week AS TIMESTAMP)) AS effective_micros, round({exact_mean('value')}, 4) AS price
        FROM (SELECT event_type AS model, date_trunc('week', ts + INTERVAL 5 DAY) AS week, value FROM events) GROUP BY ALL)"""


def _prices(spark, sf_dir):
    """Weekly prices per model; the first days have none."""
    week = F.date_trunc("week", F.col("ts") + F.expr("interval 5 days"))
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .groupBy(F.col("event_type").alias("model"), F.unix_micros(week.cast("timestamp")).alias("effective_micros"))
        .agg(F.round(drift.mean_of("value"), 4).alias("price"))
    )


@registered(sql_over("ledger", body=PRICES_SQL + """
    SELECT l.event_id, l.model, p.price, round(l.tokens * p.price, 4) AS cost
    FROM ledger l ASOF LEFT JOIN prices p ON l.model = p.model AND l.micros >= p.effective_micros"""))
def cost_asof(spark, sf_dir):
    """Cost per call at the price in force; prices change weekly, and the first days have none."""
    rows = ledger(spark, sf_dir).select("event_id", "model", "micros", "tokens")
    return drift.cost_as_of(rows, _prices(spark, sf_dir)).select(
        "event_id", "model", "price", F.round("cost", 4).alias("cost")
    )


# Share of the model's price that a kind of token costs; writing to the cache has none.
KIND_SHARES = {"input_uncached": 1.0, "cached_read": 0.5, "output_tokens": 2.0, "reasoning_tokens": 2.0}
KIND_TOKENS_SQL = """
    , kinds AS (
        SELECT event_id, model, micros, unnest([
            {'kind': 'input_uncached', 'tokens': CASE WHEN event_id % 3 <> 0 THEN tokens END},
            {'kind': 'cached_read', 'tokens': CASE WHEN event_id % 3 <> 0 THEN tokens // 2 END},
            {'kind': 'cache_write', 'tokens': CASE WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 5 = 1 THEN 0 END},
            {'kind': 'output_tokens', 'tokens': tokens + 1},
            {'kind': 'reasoning_tokens', 'tokens': CASE WHEN event_id % 2 = 0 THEN tokens // 4 ELSE 0 END}], recursive := true)
        FROM ledger),
    shares(kind, share) AS (VALUES ('input_uncached', 1.0::DOUBLE), ('cached_read', 0.5::DOUBLE), ('output_tokens', 2.0::DOUBLE),
                                   ('reasoning_tokens', 2.0::DOUBLE)),
    kind_prices AS (SELECT model, kind, effective_micros, price * share AS price FROM prices, shares),
    lines AS (
        SELECT k.*, p.price, CASE WHEN tokens = 0 THEN 0.0::DOUBLE ELSE tokens * p.price END AS cost
        FROM kinds k ASOF LEFT JOIN kind_prices p ON k.model = p.model AND k.kind = p.kind AND k.micros >= p.effective_micros)"""


def _cost_lines(spark, sf_dir):
    event, tokens = F.col("event_id"), F.col("tokens")
    calls = ledger(spark, sf_dir).select(
        "event_id", "model", "micros",
        F.when(event % 3 != 0, tokens).alias("input_uncached"),
        F.when(event % 3 != 0, F.floor(tokens / 2)).alias("cached_read"),
        F.when(event % 5 == 0, 1).when(event % 5 == 1, 0).cast("bigint").alias("cache_write"),
        (tokens + 1).alias("output_tokens"),
        F.when(event % 2 == 0, F.floor(tokens / 4)).otherwise(0).cast("bigint").alias("reasoning_tokens"),
    )
    shares = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("share")) for k, v in KIND_SHARES.items()]))
    prices = _prices(spark, sf_dir).select("*", shares.alias("s")).select(
        "model", "s.kind", "effective_micros", (F.col("price") * F.col("s.share")).alias("price"))
    return drift.cost_by_kind(calls, prices, ["event_id"])


@registered(sql_over("ledger", body=PRICES_SQL + KIND_TOKENS_SQL + """
    SELECT event_id, kind, tokens, round(price, 6) AS price, round(cost, 6) AS cost FROM lines"""))
def cost_by_token_kind(spark, sf_dir):
    """Each kind of token at its own price; what was not itemised has no cost."""
    return _cost_lines(spark, sf_dir).select(
        "event_id", "kind", "tokens", F.round("price", 6).alias("price"), F.round("cost", 6).alias("cost"))


@registered(sql_over("ledger", body=PRICES_SQL + KIND_TOKENS_SQL + """
    , sums AS (
        SELECT event_id, coalesce(CAST(sum(CAST(cost AS DECIMAL(18,6))) AS DOUBLE), 0) AS known_cost,
               count(*) FILTER (WHERE tokens IS NULL) AS unknown_kinds,
               count(*) FILTER (WHERE tokens IS NOT NULL AND cost IS NULL) AS unpriced_kinds
        FROM lines GROUP BY event_id)
    SELECT event_id, known_cost, unknown_kinds, unpriced_kinds,
           CASE WHEN unknown_kinds = 0 AND unpriced_kinds = 0 THEN known_cost END AS cost
    FROM sums"""))
def cost_per_call(spark, sf_dir):
    """A call's cost, where all of it is known."""
    return drift.call_costs(_cost_lines(spark, sf_dir), ["event_id"])


@registered(sql_over("valid_ledger", body=f"""
    , d AS (SELECT model, day, count(score) AS n, {exact_mean('score')} AS mean_score, stddev_samp(score) AS sd_score
            FROM valid_ledger GROUP BY ALL)
    SELECT model, day, n, round(mean_score, 6) AS mean_score, round(sd_score, 6) AS sd_score,
           round(mean_score - lag(mean_score) OVER w, 6) AS vs_previous,
           round(mean_score - first_value(mean_score) OVER w, 6) AS vs_first
    FROM d WINDOW w AS (PARTITION BY model ORDER BY day)"""))
def drift_by_day(spark, sf_dir):
    return _rounded(
        drift.drift_by_day(valid_ledger(spark, sf_dir)), "mean_score", "sd_score", "vs_previous", "vs_first"
    )


PANELS_SQL = """
    , span AS (SELECT min(micros) + (max(micros) - min(micros)) // 2 AS middle FROM valid_ledger),
    under AS (SELECT l.*, composite_key AS stablekey, CASE WHEN micros < middle THEN 'panel-1' ELSE 'panel-2' END AS panel_id
              FROM valid_ledger l, span),
    panel_jobs AS (
        SELECT 'panel-1' AS panel_id, stablekey FROM under WHERE panel_id = 'panel-1' GROUP BY stablekey HAVING max(score) >= 50
        UNION ALL SELECT 'panel-2', stablekey FROM under WHERE panel_id = 'panel-1' GROUP BY stablekey HAVING max(score) < 75)"""


def _under_panels(spark, sf_dir):
    """The ledger under a panel that changes midway, and both panels: postings picked by the first half's scores."""
    rows = valid_ledger(spark, sf_dir)
    low, high = rows.agg(F.min("micros"), F.max("micros")).first()
    middle = 0 if low is None else low + (high - low) // 2
    under = rows.withColumn("stablekey", F.col("composite_key")).withColumn(
        "panel_id", F.when(F.col("micros") < middle, "panel-1").otherwise("panel-2"))
    best = under.filter("panel_id = 'panel-1'").groupBy("stablekey").agg(F.max("score").alias("best"))
    picks = F.array_compact(F.array(F.when(F.col("best") >= 50, "panel-1"), F.when(F.col("best") < 75, "panel-2")))
    return under, best.select("stablekey", F.explode(picks).alias("panel_id"))


@registered(sql_over("valid_ledger", body=PANELS_SQL + f"""
    , daily AS (SELECT panel_id, stablekey, model, day, {exact_mean('score')} AS mean
                FROM under SEMI JOIN panel_jobs USING (panel_id, stablekey) WHERE score IS NOT NULL GROUP BY ALL),
    first_days AS (SELECT panel_id, stablekey, model, min(day) AS day FROM daily GROUP BY ALL),
    pairs AS (
        SELECT d.panel_id, d.model, d.day, d.day = f.day AS is_first,
               CASE WHEN d.day > f.day THEN CAST(CAST(d.mean AS DECIMAL(18,6)) - CAST(r.mean AS DECIMAL(18,6)) AS DOUBLE) END AS diff
        FROM daily d JOIN first_days f USING (panel_id, stablekey, model)
        JOIN daily r ON r.panel_id = f.panel_id AND r.stablekey = f.stablekey AND r.model = f.model AND r.day = f.day),
    sizes AS (SELECT panel_id, count(*) AS panel_size FROM panel_jobs GROUP BY ALL)
    SELECT panel_id, model, day, panel_size, count(*) AS scored, count(*) FILTER (WHERE is_first) AS first_seen, count(diff) AS pairs,
           round({exact_mean('diff')}, 5) AS mean_diff, round(stddev_samp(diff), 5) AS sd_diff,
           round(stddev_samp(diff) / sqrt(count(diff)), 5) AS se_diff
    FROM pairs JOIN sizes USING (panel_id) GROUP BY ALL"""))
def panel_drift(spark, sf_dir):
    """Paired drift of each model on panels of which the second replaces the first midway."""
    found = drift.panel_drift(*_under_panels(spark, sf_dir))
    for name in ("mean_diff", "sd_diff", "se_diff"):
        found = found.withColumn(name, F.round(name, 5))
    return found


@registered(sql_over("valid_ledger", body=f"""
    , m AS (SELECT day, composite_key, model, {exact_mean('score')} AS score FROM valid_ledger GROUP BY ALL)
    SELECT day, composite_key, count(*) AS models, round(stddev_samp(score), 6) AS sd_between,
           round(max(score) - min(score), 6) AS score_range
    FROM m GROUP BY ALL HAVING count(*) > 1"""))
def model_variance(spark, sf_dir):
    return _rounded(drift.model_variance(valid_ledger(spark, sf_dir)), "sd_between", "score_range")


def _regional(rows):
    """Ledger rows by nation-sized groups of postings, each model on three hosts."""
    return rows.withColumn("composite_key", (F.col("user_id") % 10).cast("string"))


@registered(sql_over("valid_ledger", body=f"""
    , h AS (SELECT model, day, (user_id % 10)::VARCHAR AS composite_key, deployment, {exact_mean('score')} AS score
            FROM valid_ledger GROUP BY ALL)
    SELECT model, day, composite_key, count(*) AS hosts, round(max(score) - min(score), 6) AS gap
    FROM h GROUP BY ALL HAVING count(*) > 1"""))
def host_gap(spark, sf_dir):
    return _rounded(drift.host_gap(_regional(valid_ledger(spark, sf_dir))), "gap")


@registered(sql_over("ledger", "valid_ledger", body=f"""
    , s AS (SELECT batch_size, count(score) AS events, {exact_mean('score')} AS mean_score FROM valid_ledger GROUP BY 1),
    l AS (SELECT batch_size, tokens FROM ledger UNION ALL SELECT 20, tokens FROM ledger WHERE event_id % 11 = 0),
    c AS (SELECT batch_size, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM l GROUP BY 1)
    SELECT batch_size, coalesce(events, 0) AS events, round(mean_score, 6) AS mean_score, calls, tokens,
           round(tokens::DOUBLE / (calls * batch_size), 6) AS derived_tokens_per_job
    FROM s FULL JOIN c USING (batch_size)"""))
def batch_size_effect(spark, sf_dir):
    """Some calls are of a batch size that never got a score."""
    calls = ledger(spark, sf_dir).select("batch_size", "tokens", "event_id")
    lost = calls.filter("event_id % 11 = 0").withColumn("batch_size", F.lit(20))
    effect = drift.batch_size_effect(valid_ledger(spark, sf_dir), calls.union(lost))
    return _rounded(effect, "mean_score", "derived_tokens_per_job")


@registered(sql_over("valid_ledger", body="""
    SELECT model, count(*) AS events, count(ev_score) AS with_ev, round(count(ev_score) / count(*), 6) AS coverage,
           round(CAST(sum(CAST(ev_score AS DECIMAL(18,6)) - CAST(emitted_score AS DECIMAL(18,6))) AS DOUBLE)
                 / count(ev_score), 6) AS mean_gap
    FROM valid_ledger GROUP BY model"""))
def ev_coverage(spark, sf_dir):
    return _rounded(drift.ev_coverage(valid_ledger(spark, sf_dir)), "coverage", "mean_gap")


@registered(sql_over("ledger", body="""
    SELECT model, batch_size, count(*) AS events, count(*) FILTER (WHERE emitted_score = -2) AS sentinels,
           CAST(sum(event_id % 13 = 0) AS BIGINT) AS dropped,
           round(count(*) FILTER (WHERE emitted_score = -2) / count(*), 6) AS sentinel_rate
    FROM ledger GROUP BY ALL
    UNION ALL
    SELECT 'mute-' || model, batch_size, 0, 0, count(*), NULL FROM ledger WHERE user_id % 10 = 3 GROUP BY ALL"""))
def loss_rates(spark, sf_dir):
    """Some models sent postings and got nothing back."""
    rows = ledger(spark, sf_dir)
    sent = rows.select(
        "model", "batch_size", F.lit(1).alias("jobs_sent"), F.when(F.col("event_id") % 13 == 0, 0).otherwise(1).alias("scores_parsed")
    )
    mute = rows.filter("user_id % 10 = 3").select(
        F.concat(F.lit("mute-"), "model").alias("model"), "batch_size", F.lit(1).alias("jobs_sent"), F.lit(0).alias("scores_parsed")
    )
    return _rounded(drift.loss_rates(rows, sent.union(mute)), "sentinel_rate")


@registered("""
    SELECT lang AS model, count(*) AS n, round(corr(strlen(text), n_chars), 6) AS correlation,
           round(regr_slope(n_chars, strlen(text)), 6) AS tokens_per_byte
    FROM documents GROUP BY lang""")
def length_covariate(spark, sf_dir):
    calls = text_postings(spark, sf_dir).select(
        F.col("location").alias("model"), F.octet_length("description").alias("description_bytes"),
        F.length("description").alias("tokens"),
    )
    return _rounded(drift.length_covariate(calls), "correlation", "tokens_per_byte")


@registered(sql_over("ledger", body="""
    , e AS (
        SELECT model, CASE WHEN user_id % 10 = 0 THEN 'timeout' WHEN user_id % 10 = 1 THEN 'canceled' WHEN value >= 60 THEN 'http_5xx'
                           WHEN value >= 40 THEN 'http_4xx' ELSE '' END AS error_class
        FROM (SELECT user_id, event_type AS model, value FROM events))
    SELECT model, error_class, count(*) AS failures FROM e WHERE error_class <> '' GROUP BY ALL"""))
def failures_by_class(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    user, value = F.col("user_id") % 10, F.col("value")
    kind = F.when(user == 0, "timeout").when(user == 1, "canceled")
    status = F.when(user > 1, F.when(value >= 60, 503).when(value >= 40, 429))
    calls = events.select(F.col("event_type").alias("model"), error_class(status, kind).alias("error_class"))
    return drift.failures_by_class(calls)


SPAN_NOW = 1041379200  # 2003-01-01


@registered(sql_over("postings", body=f"""
    SELECT stablekey AS composite_key, min(posted_at) AS first_epoch, max(posted_at) AS last_epoch,
           round((max(posted_at) - min(posted_at)) / 86400, 6) AS live_days,
           max(posted_at) < {SPAN_NOW} - 172800 AS vanished
    FROM postings GROUP BY stablekey"""))
def live_span(spark, sf_dir):
    jobs = postings(spark, sf_dir).groupBy(F.col("stablekey").alias("composite_key")).agg(
        F.min("posted_at").alias("first_epoch"), F.max("posted_at").alias("last_epoch")
    )
    return _rounded(drift.live_span(jobs, F.lit(SPAN_NOW)), "live_days")


@registered(sql_over("valid_ledger", body=f"""
    , c AS (SELECT contributor_id, model, {exact_mean('score')} AS m, count(score) AS n FROM valid_ledger GROUP BY ALL),
    p AS (SELECT contributor_id, {exact_mean('score')} AS m FROM valid_ledger GROUP BY ALL),
    q AS (SELECT model, {exact_mean('score')} AS m FROM valid_ledger GROUP BY ALL),
    g AS (SELECT {exact_mean('score')} AS m FROM valid_ledger)
    SELECT c.contributor_id, c.model, c.n, round(c.m, 6) AS cell_mean, round(p.m, 6) AS contributor_mean,
           round(q.m, 6) AS model_mean, round(c.m - p.m - q.m + g.m, 6) AS interaction
    FROM c JOIN p USING (contributor_id) JOIN q USING (model), g"""))
def contributor_effect(spark, sf_dir):
    return _rounded(
        drift.contributor_effect(valid_ledger(spark, sf_dir)), "cell_mean", "contributor_mean", "model_mean", "interaction"
    )


@registered(sql_over("valid_ledger", body="""
    , r AS (SELECT model, (user_id % 10)::VARCHAR AS k, day, count(score) AS n, stddev_samp(score) AS sd
            FROM valid_ledger GROUP BY ALL HAVING count(score) > 1)
    SELECT model, count(*) AS groups, round(avg(sd), 6) AS mean_sd, round(max(sd), 6) AS max_sd FROM r GROUP BY model"""))
def noise_floor(spark, sf_dir):
    return _rounded(drift.noise_floor(_regional(valid_ledger(spark, sf_dir))), "mean_sd", "max_sd")


@registered(sql_over("valid_ledger", body=f"""
    SELECT config_id, instructions_version, temperature_sent, count(DISTINCT day) AS runs, count(*) AS events,
           round({exact_mean('score')}, 6) AS mean_score
    FROM valid_ledger GROUP BY ALL"""))
def comparable_runs(spark, sf_dir):
    rows = valid_ledger(spark, sf_dir).withColumn("run_id", F.col("day"))
    return _rounded(drift.comparable_runs(rows), "mean_score")
