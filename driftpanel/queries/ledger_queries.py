"""Queries over the ledger: latest scores, calls, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftpanel.functions.quota import (
    batch_outcome, error_class, estimate_ratio, is_retryable, token_estimate,
)
from driftpanel.operators import audit, latest
from driftpanel.operators.ledger import (
    append_run, event_rows, failed_calls, rebuild_calls, reconcile, rows_per_model, sentinel_counts,
)
from driftpanel.plans.runs import write_sheet
from driftpanel.queries.registry import registered
from driftpanel.queries.views import ledger, postings, sql_over
from driftpanel.session import scratch_path


@registered(sql_over("ledger", body="""
    SELECT composite_key, model, event_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY composite_key ORDER BY scored_at DESC, event_id DESC) AS rn
        FROM ledger) WHERE rn = 1"""))
def latest_score_per_posting(spark, sf_dir):
    newest = latest.latest_scores(ledger(spark, sf_dir))
    return newest.select("composite_key", "model", "event_id", "score")


def _posting_ledger(spark, sf_dir):
    """Jobs, events and calls in their own tables; a call is a model's hour."""
    rows = ledger(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "scored_at"))
    posted = postings(spark, sf_dir)
    call = F.concat_ws("|", "model", F.date_format("hour", "yyyyMMddHH"))
    events = rows.drop("composite_key").join(
        posted.select(F.col("order_id").alias("event_id"), "composite_key"), "event_id"
    ).select(
        "event_id", call.alias("call_id"), "composite_key", "emitted_score", "ev_score",
        F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("reasoning"),
    )
    calls = rows.select(call.alias("call_id"), F.col("hour").alias("scored_at")).distinct()
    content = ("stablekey", "posted_at", "title", "company", "url", "payload")
    jobs = (
        posted.withColumn("payload", F.to_json(F.struct("location", "is_remote")))
        .groupBy("composite_key")
        .agg(F.min_by(F.struct(*content), F.col("url")).alias("j")).select("composite_key", "j.*")
    )
    return jobs, events, calls


EXPORT_SQL = sql_over("ledger", "postings", body="""
    , e AS (
        SELECT l.event_id, p.composite_key, l.score, date_trunc('hour', l.scored_at) AS hour
        FROM ledger l JOIN postings p ON p.order_id = l.event_id),
    j AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY composite_key ORDER BY url) AS n FROM postings)
        WHERE n = 1),
    r AS (
        SELECT j.*, e.score AS event_score, e.event_id,
               row_number() OVER (PARTITION BY j.stablekey ORDER BY e.hour DESC, e.event_id DESC) AS rn
        FROM j JOIN e USING (composite_key))
    SELECT stablekey, posted_at, strftime(make_timestamp(posted_at * 1000000), '%Y-%m-%d') AS posted,
           title, company, event_score AS score, false AS has_applied,
           CASE WHEN event_id % 5 <> 0 THEN 'r' || event_id ELSE '' END AS reasoning, location, url
    FROM r WHERE rn = 1""")


@registered(EXPORT_SQL)
def export_rows(spark, sf_dir):
    return latest.export_rows(*_posting_ledger(spark, sf_dir))


@registered(EXPORT_SQL)
def export_csv(spark, sf_dir):
    path = scratch_path(spark, "sheet")
    rows = latest.export_rows(*_posting_ledger(spark, sf_dir))
    write_sheet(rows, path)
    read = spark.read.option("header", "true").option("escape", '"').schema(rows.schema).csv(path)
    return read.fillna("", ["reasoning"])


HALF = 1706486400000000  # 2024-01-29 in microseconds; not every user has later events


@registered(sql_over("ledger", body=f"""
    , w AS (
        SELECT *, row_number() OVER (PARTITION BY user_id, micros < {HALF} ORDER BY micros DESC, event_id DESC) AS rn
        FROM ledger),
    old AS (SELECT * FROM w WHERE rn = 1 AND micros < {HALF}),
    new AS (SELECT * FROM w WHERE rn = 1 AND micros >= {HALF})
    SELECT composite_key AS stablekey, user_id AS posted_at, score, model AS title, false AS has_applied FROM new
    UNION ALL
    SELECT composite_key, user_id, score, model, user_id % 4 = 0
    FROM old WHERE user_id NOT IN (SELECT user_id FROM new)"""))
def latest_score_upsert(spark, sf_dir):
    rows = ledger(spark, sf_dir).select(
        "*", F.col("composite_key").alias("stablekey"), F.col("user_id").alias("posted_at"),
        F.col("model").alias("title"), F.col("model").alias("company"), F.lit("").alias("location"),
        F.lit("").alias("url"), F.lit("").alias("source"), F.lit("").alias("reasoning"),
    )
    keys = ("stablekey", "posted_at")
    content = ("score", "title", "company", "location", "url", "source", "reasoning")
    now = F.lit("2024-02-01").cast("timestamp")
    stored = (
        latest.latest_scores(rows.filter(F.col("micros") < HALF), keys, content)
        .withColumn("has_applied", F.col("posted_at") % 4 == 0).withColumn("last_seen", now)
    )
    fresh = rows.filter(F.col("micros") >= HALF)
    return latest.overwrite_latest(stored, fresh, now).select(
        "stablekey", "posted_at", "score", "title", "has_applied"
    )


def _called(spark, sf_dir):
    """Ledger events with the call facts every event of a call repeats."""
    return ledger(spark, sf_dir).select(
        "*", F.floor(F.col("micros") / 60_000_000).alias("minute"),
        F.col("tokens").alias("input_uncached"), F.lit(None).cast("bigint").alias("cached_read"),
        F.lit(None).cast("bigint").alias("cache_write"), F.col("tokens").alias("output_tokens"),
        F.lit(None).cast("bigint").alias("reasoning_tokens"), F.lit(None).cast("string").alias("usage_raw"),
        F.when(F.col("event_id") % 5 != 0, "kept").otherwise("").alias("reasoning"),
        F.lit("{}").alias("raw"), F.lit("").alias("logprobs"),
    )


@registered(sql_over("ledger", body="""
    SELECT model, epoch_us(date_trunc('minute', scored_at)) // 60000000 AS minute,
           md5(model || '|' || (epoch_us(date_trunc('minute', scored_at)) // 60000000)) AS call_id,
           count(*) AS batch_size, arg_min(deployment, event_id) AS deployment,
           arg_min(temperature_sent, event_id) AS temperature_sent,
           arg_min(tokens, event_id) AS input_uncached, 'main' AS run_kind
    FROM ledger GROUP BY ALL"""))
def rebuild_calls_from_events(spark, sf_dir):
    calls = rebuild_calls(_called(spark, sf_dir), ("model", "minute"), "event_id")
    return calls.select(
        "model", "minute", "call_id", "batch_size", "deployment", "temperature_sent", "input_uncached", "run_kind"
    )


@registered(sql_over("ledger", body="""
    SELECT c.model, c.batch_size, count(*) AS calls, CAST(sum(e.n) AS BIGINT) AS events,
           CAST(sum(e.silent) AS BIGINT) AS without_reasoning, CAST(sum(e.ev) AS BIGINT) AS with_ev
    FROM (SELECT model, epoch_us(date_trunc('minute', scored_at)) AS minute, count(*) AS batch_size
          FROM ledger GROUP BY ALL) c
    JOIN (SELECT model, epoch_us(date_trunc('minute', scored_at)) AS minute, count(*) AS n,
                 count(*) FILTER (WHERE event_id % 5 = 0) AS silent, count(ev_score) AS ev
          FROM ledger GROUP BY ALL) e USING (model, minute)
    GROUP BY c.model, c.batch_size"""))
def ledger_written(spark, sf_dir):
    """Calls and events appended to their tables, read back and joined."""
    root = scratch_path(spark, "ledger")
    rows, key = _called(spark, sf_dir), ("model", "minute")
    append_run(rebuild_calls(rows, key, "event_id"), f"{root}/scoring_calls", "r1")
    append_run(event_rows(rows, key, "event_id"), f"{root}/scoring_events", "r1")
    calls = spark.read.parquet(f"{root}/scoring_calls")
    per_call = spark.read.parquet(f"{root}/scoring_events").groupBy("call_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("reasoning").isNull()).alias("silent"),
        F.count("ev_score").alias("ev"),
    )
    return calls.join(per_call, "call_id").groupBy("model", "batch_size").agg(
        F.count("*").alias("calls"), F.sum("n").alias("events"),
        F.sum("silent").alias("without_reasoning"), F.sum("ev").alias("with_ev"),
    )


@registered(sql_over("ledger", body="""
    SELECT model, count(*) AS expected, count(*) FILTER (WHERE event_id % 41 <> 0) AS actual
    FROM ledger GROUP BY model"""))
def rows_expected_and_actual(spark, sf_dir):
    return rows_per_model(ledger(spark, sf_dir), F.col("event_id") % 41 != 0)


@registered(sql_over("ledger", body="""
    , s AS (SELECT model, day, count(*) AS scored_rows FROM ledger GROUP BY ALL),
    p AS (SELECT model, day, count(*) AS persisted_rows FROM ledger
          WHERE event_id % 41 <> 0 AND NOT (model = 'click' AND day = '2024-01-03') GROUP BY ALL)
    SELECT model, day, coalesce(scored_rows, 0) AS scored_rows, coalesce(persisted_rows, 0) AS persisted_rows
    FROM s FULL OUTER JOIN p USING (model, day)
    WHERE coalesce(scored_rows, 0) <> coalesce(persisted_rows, 0)"""))
def reconcile_run(spark, sf_dir):
    rows, keys = ledger(spark, sf_dir), ("model", "day")
    lost = (F.col("event_id") % 41 == 0) | ((F.col("model") == "click") & (F.col("day") == "2024-01-03"))
    return reconcile(
        rows.groupBy(*keys).agg(F.count("*").alias("scored_rows")),
        rows.filter(~lost).groupBy(*keys).agg(F.count("*").alias("persisted_rows")), keys,
    )


@registered(sql_over("ledger", body="""
    SELECT count(*) FILTER (WHERE bad) AS failed_calls, count(*) AS total_calls
    FROM (SELECT model, micros // 60000000 AS minute, max(event_id % 41 = 0) AS bad FROM ledger GROUP BY ALL)"""))
def failed_of_total_calls(spark, sf_dir):
    calls = _called(spark, sf_dir).groupBy("model", "minute").agg(
        F.bool_or(F.col("event_id") % 41 == 0).alias("bad")
    )
    return failed_calls(calls, F.col("bad"))


@registered(sql_over("ledger", body="""
    SELECT model, count(*) AS events, count(*) FILTER (WHERE emitted_score < 0) AS sentinels
    FROM ledger GROUP BY model"""))
def sentinel_rate(spark, sf_dir):
    return sentinel_counts(ledger(spark, sf_dir), "model")


def _audited(spark, sf_dir, tpm):
    return ledger(spark, sf_dir).select(
        "event_id", "model", "micros", "tokens",
        (F.length("model") * tpm).alias("tpm"), (F.length("model") * 2).alias("rpm"),
    )


def _audit_sql(span: int, tpm: int) -> str:
    return sql_over("ledger", body=f"""
        , s AS (
            SELECT event_id, model, micros, tokens, CAST(floor(length(model) * {tpm} * 0.75) AS BIGINT) AS budget,
                   CAST(sum(tokens) OVER (PARTITION BY model ORDER BY micros
                        RANGE BETWEEN {span - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS window_tokens
            FROM ledger)
        SELECT event_id, model, window_tokens, budget,
               CASE WHEN window_tokens <= budget THEN 'ok' WHEN window_tokens = tokens THEN 'oversized'
                    ELSE 'over' END AS verdict
        FROM s""")


AUDIT_COLUMNS = ("event_id", "model", "window_tokens", "budget", "verdict")


@registered(_audit_sql(60_000_000, 15))
def rolling_token_audit(spark, sf_dir):
    return audit.token_audit(_audited(spark, sf_dir, 15)).select(*AUDIT_COLUMNS)


@registered(_audit_sql(3_600_000_000, 40))
def rolling_token_audit_hour(spark, sf_dir):
    return audit.token_audit(_audited(spark, sf_dir, 40), 3_600_000_000).select(*AUDIT_COLUMNS)


@registered(sql_over("ledger", body="""
    , s AS (
        SELECT event_id, model, micros,
               micros - lag(micros) OVER (PARTITION BY model ORDER BY micros, event_id) AS gap_micros,
               CAST(ceil(60.0 / (length(model) * 2 * 0.75)) AS BIGINT) AS interval_seconds
        FROM ledger)
    SELECT event_id, model, gap_micros, interval_seconds,
           coalesce(gap_micros < interval_seconds * 1000000, false) AS too_close FROM s"""))
def spacing_audit(spark, sf_dir):
    return audit.spacing_audit(_audited(spark, sf_dir, 15), ["event_id"]).select(
        "event_id", "model", "gap_micros", "interval_seconds", "too_close"
    )


@registered("""
    WITH b AS (SELECT 'm' || (user_id % 60) AS model, event_id AS batch_index, event_type = 'error' AS failed FROM events),
    s AS (SELECT model, min(batch_index) AS stop FROM b WHERE failed GROUP BY model)
    SELECT b.model, b.batch_index, (stop IS NULL OR batch_index <= stop) AS attempted
    FROM b LEFT JOIN s USING (model)""")
def stop_after_failure(spark, sf_dir):
    batches = ledger(spark, sf_dir).select(
        F.concat(F.lit("m"), (F.col("user_id") % 60).cast("string")).alias("model"),
        F.col("event_id").alias("batch_index"), (F.col("model") == "error").alias("failed"),
    )
    return audit.attempted(batches, ["model"]).select("model", "batch_index", "attempted")


@registered(sql_over("ledger", body="""
    , s AS (
        SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE 200 + CAST(floor(emitted_score / 10) AS INT) * 50 END
                   AS status,
               CASE event_id % 12 WHEN 0 THEN 'timeout' WHEN 6 THEN 'reset' END AS kind,
               batch_size AS sent, batch_size - event_id % 2 AS parsed, tokens FROM ledger)
    SELECT event_id,
           CASE WHEN kind IS NOT NULL OR status >= 400 THEN 'failed' WHEN parsed < sent THEN 'partial' ELSE 'ok' END
               AS outcome,
           CASE WHEN status >= 500 THEN 'http_5xx' WHEN status >= 400 THEN 'http_4xx' WHEN status IS NOT NULL THEN 'http_other'
                WHEN kind = 'timeout' THEN 'timeout' ELSE 'unknown' END AS error_class,
           coalesce(status IN (500, 502, 503, 504), false) AS retryable,
           round(CASE WHEN tokens > 0 THEN (3000 + sent * 100 / 1.75::DOUBLE) / tokens END, 6) AS est_ratio
    FROM s"""))
def outcome_and_error_class(spark, sf_dir):
    no_status = F.col("event_id") % 6 == 0
    rows = ledger(spark, sf_dir).select(
        "event_id", "batch_size", "tokens",
        F.when(~no_status, 200 + F.floor(F.col("emitted_score") / 10).cast("int") * 50).alias("status"),
        F.when(F.col("event_id") % 12 == 0, "timeout").when(F.col("event_id") % 12 == 6, "reset").alias("kind"),
    )
    failed = F.col("kind").isNotNull() | F.coalesce(F.col("status") >= 400, F.lit(False))
    parsed = F.col("batch_size") - F.col("event_id") % 2
    return rows.select(
        "event_id",
        batch_outcome(failed, parsed, F.col("batch_size")).alias("outcome"),
        error_class(F.col("status"), F.col("kind")).alias("error_class"),
        is_retryable(F.col("status")).alias("retryable"),
        F.round(estimate_ratio(token_estimate(F.col("batch_size") * 100), F.col("tokens")), 6).alias("est_ratio"),
    )


@registered(sql_over("ledger", body="""
    SELECT model, batch_size, count(*) AS batches, CAST(sum(tokens) AS BIGINT) AS actual_tokens,
           count(*) FILTER (WHERE event_id % 9 = 0) AS partial
    FROM ledger GROUP BY ALL"""))
def run_accounting(spark, sf_dir):
    """Per-batch accounting rows, stored by run and read back."""
    path = scratch_path(spark, "accounting")
    rows = ledger(spark, sf_dir).select(
        "model", "batch_size", F.col("event_id").alias("batch_index"), "tokens",
        batch_outcome(F.lit(False), F.col("event_id") % 9, F.lit(1)).alias("outcome"),
    )
    append_run(rows, path, "r1")
    return spark.read.parquet(path).groupBy("model", "batch_size").agg(
        F.count("*").alias("batches"), F.sum("tokens").alias("actual_tokens"),
        F.count_if(F.col("outcome") == "partial").alias("partial"),
    )
