"""Queries over model responses: items, usage, expected scores, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftpanel.functions.expected import expected_score
from driftpanel.functions.items import strict_items
from driftpanel.functions.usage import itemised_usage
from driftpanel.operators.correlate import correlate
from driftpanel.queries.registry import registered
from driftpanel.queries.views import ledger, sql_over, table
from driftpanel.sources.responses import candidate_calls, candidate_items, chat_calls, chat_items

def _event():
    return F.col("event_id")


def _usage_blob():
    """Six kinds of usage blob, by event."""
    k = F.col("tokens")
    both, prompt_only = _event() % 6 == 0, _event() % 6 == 3
    zeros = _event() % 6 == 1
    cached = F.when(both | prompt_only, F.floor(k / 2)).when(zeros, 0)
    reasoning = F.when(both, F.floor(k / 3)).when(zeros, 0)
    blob = F.to_json(F.struct(
        (100 + k).alias("prompt_tokens"), (50 + k).alias("completion_tokens"), (150 + 2 * k).alias("total_tokens"),
        F.when(cached.isNotNull(), F.struct(cached.alias("cached_tokens"))).alias("prompt_tokens_details"),
        F.when(reasoning.isNotNull(), F.struct(reasoning.alias("reasoning_tokens"))).alias("completion_tokens_details"),
    ))
    return F.when(_event() % 6 == 4, "").when(_event() % 6 == 5, '{"prompt_tokens":"12","total_tokens":12}').otherwise(blob)


@registered(sql_over("ledger", body="""
    SELECT event_id,
           CASE event_id % 6 WHEN 0 THEN 100 + tokens - tokens // 2 WHEN 3 THEN 100 + tokens - tokens // 2
                WHEN 1 THEN 100 + tokens END AS input_uncached,
           CASE event_id % 6 WHEN 0 THEN tokens // 2 WHEN 3 THEN tokens // 2 WHEN 1 THEN 0 END AS cached_read,
           CAST(NULL AS BIGINT) AS cache_write,
           CASE event_id % 6 WHEN 0 THEN 50 + tokens - tokens // 3 WHEN 1 THEN 50 + tokens END AS output_tokens,
           CASE event_id % 6 WHEN 0 THEN tokens // 3 WHEN 1 THEN 0 END AS reasoning_tokens,
           CASE WHEN event_id % 6 >= 4 THEN 0.0::DOUBLE ELSE (150 + 2 * tokens)::DOUBLE END AS total,
           event_id % 6 <> 4 AS has_raw
    FROM ledger"""))
def usage_itemised(spark, sf_dir):
    rows = ledger(spark, sf_dir).select("event_id", itemised_usage(_usage_blob()).alias("u"))
    return rows.select(
        "event_id", "u.input_uncached", "u.cached_read", "u.cache_write", "u.output_tokens", "u.reasoning_tokens",
        "u.total", F.col("u.raw").isNotNull().alias("has_raw"),
    )


def _item_text():
    ident = _event().cast("string")

    def item(template: str):
        return F.replace(F.replace(F.lit(template), F.lit("#"), ident), F.lit("@"), F.col("tokens").cast("string"))

    kinds = (
        '{"key":"k#","score":@.5,"reasoning":"r#"}',
        '{"key":7,"score":@,"reasoning":"r#"}',
        '{"key":"k#","score":"N/A","reasoning":"r#"}',
        '{"key":"k#","reasoning":"r#"}',
        '{"key":"k#","score":@,"reasoning":42}',
        '{"score":@,"reasoning":"r#"}',
        '{"key":"k#","score":',
        '{"reasoning":"r#","score":null,"key":"k#","extra":[1]}',
    )
    return F.element_at(F.array(*[item(kind) for kind in kinds]), (_event() % 8 + 1).cast("int"))


@registered(sql_over("ledger", body="""
    SELECT event_id, event_id % 8 IN (0, 3, 5, 7) AS well_formed,
           CASE WHEN event_id % 8 IN (0, 3, 7) THEN 'k' || event_id ELSE '' END AS job_key,
           CASE event_id % 8 WHEN 0 THEN tokens + 0.5::DOUBLE WHEN 5 THEN tokens::DOUBLE WHEN 3 THEN 0.0::DOUBLE
                WHEN 7 THEN 0.0::DOUBLE ELSE -2.0::DOUBLE END AS emitted_score,
           CASE WHEN event_id % 8 IN (4, 6) THEN '' ELSE 'r' || event_id END AS reasoning
    FROM ledger"""))
def strict_score_items(spark, sf_dir):
    items = strict_items(F.array(F.try_parse_json(_item_text())))
    return ledger(spark, sf_dir).select("event_id", F.explode(items).alias("i")).select(
        "event_id", "i.well_formed", "i.job_key", "i.emitted_score", "i.reasoning"
    )


def _tokens(*tokens):
    """Logprobs blob of (text, candidates) pairs."""
    none = F.array().cast("array<struct<token: string, logprob: double>>")
    content = [
        F.struct(text.alias("token"), F.lit(-0.1).alias("logprob"), (none if not candidates else F.array(*[
            F.struct(token.alias("token"), F.lit(logprob).alias("logprob")) for token, logprob in candidates
        ])).alias("top_logprobs"))
        for text, candidates in tokens
    ]
    return F.struct(F.array(*content).alias("content"))


def _chat_responses(spark, sf_dir):
    """One response per event: a good item and one with a text for a score."""
    ident, k = _event().cast("string"), F.col("tokens")
    results = F.when(_event() % 10 == 7, F.lit('{"other":1}'))
    head = F.concat(F.lit('{"results":[{"key":"k'), ident, F.lit('","score":'))
    tail = F.concat(
        F.lit(',"reasoning":"r'), ident, F.lit('"},{"key":"bad","score":"N/A","reasoning":"kept"}]}')
    )
    number = k.cast("string")
    whole = F.concat(head, number, F.when(_event() % 10 == 9, F.lit(',"reas')).otherwise(tail))
    other = F.when(_event() % 6 == 0, "about").otherwise((k + 1).cast("string"))
    logprobs = _tokens((head, ()), (number, ((number, -0.1), (other, -2.5))), (tail, ()))
    choice = F.struct(
        F.struct(F.coalesce(results, whole).alias("content")).alias("message"), logprobs.alias("logprobs")
    )
    body = F.to_json(F.struct(
        F.when(_event() % 10 == 8, F.array().cast(f"array<struct<a: int>>").cast("string"))
        .alias("unused"),
        F.when(_event() % 10 != 8, F.array(choice)).alias("choices"),
        F.struct((150 + k).alias("total_tokens")).alias("usage"),
    ))
    return ledger(spark, sf_dir).select(
        "event_id", (_event() % 2 == 0).alias("want_logprobs"),
        F.when(_event() % 50 == 8, "<html>").otherwise(body).alias("response"),
    )


@registered(sql_over("ledger", body="""
    , good AS (SELECT * FROM ledger WHERE event_id % 10 < 7)
    SELECT event_id, 0 AS pos, true AS well_formed, 'k' || event_id AS job_key, tokens::DOUBLE AS emitted_score,
           CASE WHEN event_id % 2 = 0 AND event_id % 6 <> 0 THEN
               round((exp(-0.1::DOUBLE) * tokens + exp(-2.5::DOUBLE) * (tokens + 1)) / (exp(-0.1::DOUBLE) + exp(-2.5::DOUBLE)), 6)
           END AS ev_score, 'r' || event_id AS reasoning
    FROM good
    UNION ALL
    SELECT event_id, 1, false, '', -2.0::DOUBLE, NULL, 'kept' FROM good"""))
def chat_response_items(spark, sf_dir):
    return chat_items(chat_calls(_chat_responses(spark, sf_dir))).select(
        "event_id", "pos", "well_formed", "job_key", "emitted_score", F.round("ev_score", 6).alias("ev_score"), "reasoning"
    )


@registered(sql_over("ledger", body="""
    SELECT event_id,
           CASE WHEN event_id % 50 = 8 THEN 'envelope' WHEN event_id % 10 = 8 THEN 'empty'
                WHEN event_id % 10 = 9 THEN 'content' END AS failure,
           CASE WHEN event_id % 10 < 7 THEN 2 ELSE 0 END AS items,
           CASE WHEN event_id % 50 = 8 THEN 0.0::DOUBLE ELSE (150 + tokens)::DOUBLE END AS total
    FROM ledger"""))
def chat_call_failures(spark, sf_dir):
    calls = chat_calls(_chat_responses(spark, sf_dir))
    return calls.select("event_id", "failure", F.size("items").alias("items"), F.col("usage.total").alias("total"))


@registered(sql_over("ledger", body="""
    , i AS (SELECT *, unnest([0, 1]) AS pos FROM ledger WHERE event_id % 10 < 8)
    SELECT event_id, pos, CASE pos WHEN 0 THEN 'k' || event_id ELSE 'z' END AS job_key,
           CASE pos WHEN 0 THEN tokens::DOUBLE ELSE 5.0::DOUBLE END AS emitted_score,
           CASE pos WHEN 0 THEN 'r' ELSE '' END AS reasoning, (9 + tokens)::DOUBLE AS total_tokens
    FROM i"""))
def candidate_response_items(spark, sf_dir):
    """One item with a fractional score loses its whole call."""
    k = F.col("tokens")
    second = F.when(_event() % 10 == 9, '{"key":"z","score":1.5}').otherwise('{"key":"z","score":5}')
    text = F.concat(
        F.lit('[{"key":"k'), _event().cast("string"), F.lit('","score":'), k.cast("string"),
        F.lit(',"reasoning":"r"},'), second, F.lit("]"),
    )
    candidate = F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))
    body = F.to_json(F.struct(
        F.when(_event() % 10 != 8, F.array(candidate)).alias("candidates"),
        F.struct((9 + k).alias("totalTokenCount")).alias("usageMetadata"),
    ))
    calls = candidate_calls(ledger(spark, sf_dir).select("event_id", body.alias("response")))
    return candidate_items(calls).select(
        "event_id", "pos", "job_key", "emitted_score", "reasoning", "total_tokens"
    )


@registered("""
    WITH c AS (SELECT conv_id, turn, length(text) % 101 AS n, length(text) % 4 AS kind FROM conversations)
    SELECT conv_id, turn,
           CASE WHEN kind < 2 THEN round((0.7::DOUBLE * n + 0.3::DOUBLE * (n + 2)) / (0.7::DOUBLE + 0.3::DOUBLE), 6) END AS ev_score
    FROM c""")
def ev_score(spark, sf_dir):
    """Expected scores behind text with letters of several bytes."""
    ident = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    n, kind = F.length("text") % 101, F.length("text") % 4
    note = F.translate("text", '"\\\n\t', "")
    first = F.concat(F.lit('{"key":"j'), ident, F.lit('","note":"'), note, F.lit('"'))
    label = F.lit(',"score":')
    number = F.when(kind == 2, F.lit("7x")).otherwise(n.cast("string"))
    other = F.when(kind == 3, F.lit("n/a")).otherwise((n + 2).cast("string"))
    content = F.concat(first, label, F.lit(" "), number, F.lit("}"))
    low, high = -0.35667494393873245, -1.2039728043259361  # ln 0.7, ln 0.3
    logprobs = F.to_json(_tokens(
        (first, ()), (label, ()), (F.lit(" "), ()),
        (number, ((F.concat(F.lit(" "), number), low), (other, high))), (F.lit("}"), ()),
    ))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.round(expected_score(content, logprobs, F.concat(F.lit("j"), ident)), 6).alias("ev_score")
    )


@registered("""
    WITH jobs AS (
        SELECT conv_id AS batch, turn AS pos, 'j' || (turn // 2) AS key FROM conversations WHERE role = 'user'),
    results AS (
        SELECT conv_id AS batch, turn AS pos, length(text) AS n,
               CASE WHEN length(text) % 5 = 0 THEN '' WHEN length(text) % 7 = 0 THEN 'zz' ELSE 'j' || (turn // 2) END AS job_key
        FROM conversations WHERE role = 'assistant'),
    firsts AS (SELECT batch, job_key AS key, min(pos) AS pos, arg_min(n, pos) AS n FROM results WHERE job_key <> '' GROUP BY ALL),
    matched AS (SELECT j.batch, j.pos AS job_pos, j.key, f.pos AS result_pos, f.n FROM jobs j JOIN firsts f USING (batch, key)),
    uj AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY pos) AS k FROM jobs j
           WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.batch = j.batch AND f.key = j.key)),
    ur AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY pos) AS k FROM results r
           WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.batch = r.batch AND m.result_pos = r.pos))
    SELECT batch, job_pos, key, result_pos, (n % 101)::DOUBLE AS emitted_score, true AS by_key FROM matched
    UNION ALL
    SELECT uj.batch, uj.pos, uj.key, ur.pos, -2.0::DOUBLE, false FROM uj JOIN ur USING (batch, k)""")
def correlate_results(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn(
        "key", F.concat(F.lit("j"), F.floor(F.col("turn") / 2).cast("string"))
    )
    jobs = turns.filter("role = 'user'").select(F.col("conv_id").alias("batch"), F.col("turn").alias("pos"), "key")
    size = F.length("text")
    results = turns.filter("role = 'assistant'").select(
        F.col("conv_id").alias("batch"), F.col("turn").alias("pos"),
        F.when(size % 5 == 0, "").when(size % 7 == 0, "zz").otherwise(F.col("key")).alias("job_key"),
        (size % 101).cast("double").alias("emitted_score"), F.lit(None).cast("double").alias("ev_score"),
    )
    return correlate(jobs, results, ["batch"], [], []).select(
        "batch", "job_pos", "key", "result_pos", "emitted_score", "by_key"
    )
