"""Queries over settings documents, model lists, identities and the sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftpanel.config import config_id_column
from driftpanel.functions.keys import content_hash, derived_seed, panel_id
from driftpanel.functions.quota import request_interval, token_budget
from driftpanel.functions.sweep import batch_size_of_day, day_index
from driftpanel.operators.scoring import refusal
from driftpanel.queries.registry import registered
from driftpanel.queries.views import ledger, sql_over, table
from driftpanel.sources.settings import (
    BUILT_IN_MODELS, PROVIDER_ADDRESSES, band_targets, keyword_lists, known_sources, model_catalogue, score_bands,
    source_companies, unknown_providers,
)

PROVIDER_CASE = "CASE doc_id % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'ashby' WHEN 2 THEN 'lever' ELSE 'workday' END"


def _source_documents(spark, sf_dir):
    """One sources document per text: a provider with two companies."""
    provider = F.element_at(
        F.array(*[F.lit(p) for p in ("greenhouse", "ashby", "lever", "workday")]), (F.col("doc_id") % 4 + 1).cast("int")
    )
    companies = F.array("source", F.concat_ws("-", "source", "lang"))
    return table(spark, sf_dir, "documents").select(
        F.to_json(F.create_map(provider, companies)).alias("document")
    )


@registered(f"""
    SELECT provider, company, count(*) AS documents
    FROM (SELECT {PROVIDER_CASE} AS provider, unnest([source, source || '-' || lang]) AS company FROM documents)
    WHERE provider <> 'workday' GROUP BY ALL""")
def config_sources_exploded(spark, sf_dir):
    known = known_sources(source_companies(_source_documents(spark, sf_dir)))
    return known.groupBy("provider", "company").agg(F.count("*").alias("documents"))


@registered("SELECT 'workday' AS provider, 2 * count(*) AS companies FROM documents WHERE doc_id % 4 = 3 HAVING count(*) > 0")
def unknown_source_providers(spark, sf_dir):
    return unknown_providers(source_companies(_source_documents(spark, sf_dir)))


BUILT_IN_SQL = ", ".join(
    f"('{name}', '{protocol}', {tpm}, {rpm}, '{PROVIDER_ADDRESSES[protocol]}')"
    for name, protocol, tpm, rpm in BUILT_IN_MODELS
)


@registered(sql_over("ledger", body=f"""
    SELECT deployment AS name, CAST(sum(tokens) % 3 * 1000 AS INT) AS tpm, CAST(count(*) % 7 AS INT) AS rpm, 'chat' AS protocol,
           '' AS base_url, true AS want_logprobs
    FROM ledger GROUP BY deployment
    UNION ALL
    SELECT name, tpm, rpm, protocol, base_url, false
    FROM (VALUES {BUILT_IN_SQL}) b(name, protocol, tpm, rpm, base_url)"""))
def model_catalogue_rows(spark, sf_dir):
    """Models named by the ledger, as settings documents, then the built-in ones."""
    documents = ledger(spark, sf_dir).groupBy("deployment").agg(
        F.to_json(F.array(F.struct(
            F.col("deployment").alias("name"), F.lit(True).alias("wantLogprobs"),
            (F.sum("tokens") % 3 * 1000).alias("tpm"), (F.count("*") % 7).alias("rpm"), F.lit("chat").alias("protocol"),
        ))).alias("document")
    )
    return model_catalogue(documents).select("name", "tpm", "rpm", "protocol", "base_url", "want_logprobs")


SCREENER = "signup-0"


@registered(sql_over("ledger", body=f"""
    , m AS (
        SELECT deployment AS name, sum(tokens) % 4 * 1000 AS tpm, count(*) % 5 AS rpm,
               CASE WHEN sum(tokens) % 3 = 0 THEN 'other' ELSE 'chat' END AS protocol,
               CASE WHEN count(*) % 2 = 0 THEN '' ELSE 'https://x' END AS base_url
        FROM ledger GROUP BY deployment)
    SELECT name, CAST(floor(tpm * 0.75) AS BIGINT) AS budget,
           CASE WHEN rpm > 0 THEN CAST(ceil(60 / (rpm * 0.75)) AS BIGINT) END AS interval_seconds,
           CASE WHEN tpm <= 0 OR rpm <= 0 THEN 'missing tpm/rpm' WHEN protocol <> 'chat' THEN 'no scorer for protocol'
                WHEN base_url = '' THEN 'missing base url' END AS refusal,
           count(*) OVER () AS graders
    FROM m WHERE name <> '{SCREENER}'"""))
def model_eligibility(spark, sf_dir):
    """Graders with their quotas and, where refused, the reason; the screener is out."""
    models = ledger(spark, sf_dir).groupBy(F.col("deployment").alias("name")).agg(
        (F.sum("tokens") % 4 * 1000).alias("tpm"), (F.count("*") % 5).alias("rpm"),
        F.when(F.sum("tokens") % 3 == 0, "other").otherwise("chat").alias("protocol"),
        F.when(F.count("*") % 2 == 0, "").otherwise("https://x").alias("base_url"),
    )
    graders = models.filter(F.col("name") != SCREENER)
    total = graders.agg(F.count("*")).scalar()
    return graders.select(
        "name", token_budget(F.col("tpm")).alias("budget"),
        F.when(F.col("rpm") > 0, request_interval(F.nullif(F.col("rpm"), F.lit(0)))).alias("interval_seconds"),
        refusal(F.struct("tpm", "rpm", "protocol", "base_url"), ["chat"]).alias("refusal"),
        total.alias("graders"),
    )


def _settings_documents(spark, sf_dir):
    """One document of each kind per customer."""
    cut = (F.col("c_custkey") % 100).cast("double")

    def band(name, low, high):
        return F.struct(F.lit(name).alias("name"), low.alias("min"), high.alias("max"))

    bands = F.array(band("low", F.lit(0.0), cut), band("high", cut, F.lit(100.0)))
    targets = F.array(F.struct(
        F.when(F.col("c_custkey") % 2 == 0, "low").otherwise("high").alias("band"),
        (F.col("c_custkey") % 9).cast("int").alias("target"),
    ))
    rules = F.struct(F.array("c_mktsegment", F.lit("x")).alias("include"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.to_json(bands).alias("bands"), F.to_json(targets).alias("targets"), F.to_json(rules).alias("rules")
    )


@registered("""
    WITH b AS (
        SELECT c_custkey, unnest(['low', 'high']) AS name, unnest([0, c_custkey % 100])::DOUBLE AS min,
               unnest([c_custkey % 100, 100])::DOUBLE AS max FROM customer)
    SELECT c_custkey, name, min, max,
           CASE WHEN (name = 'low') = (c_custkey % 2 = 0) THEN CAST(c_custkey % 9 AS INT) END AS target
    FROM b""")
def bands_and_targets(spark, sf_dir):
    documents = _settings_documents(spark, sf_dir)
    bands = score_bands(documents.select("c_custkey", F.col("bands").alias("document")))
    targets = band_targets(documents.select("c_custkey", F.col("targets").alias("document")))
    return bands.join(
        targets.select("c_custkey", F.col("band").alias("name"), "target"), ["c_custkey", "name"], "left"
    )


@registered("SELECT c_mktsegment AS word, count(*) AS included, CAST(0 AS BIGINT) AS excluded FROM customer GROUP BY 1 "
            "UNION ALL SELECT 'x', count(*), 0 FROM customer")
def keyword_rules(spark, sf_dir):
    rules = keyword_lists(_settings_documents(spark, sf_dir).select(F.col("rules").alias("document")))
    return rules.select(F.explode("include").alias("word"), F.size("exclude").alias("n")).groupBy("word").agg(
        F.count("*").alias("included"), F.sum("n").alias("excluded")
    )


@registered("""
    SELECT doc_id, substr(sha256(text), 1, 12) AS content_hash, substr(sha256(source), 1, 12) AS contributor_id
    FROM documents""")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", content_hash(F.col("text")).alias("content_hash"), content_hash(F.col("source")).alias("contributor_id")
    )


@registered("""
    WITH d AS (
        SELECT doc_id, '{"sources":{"greenhouse":["' || least(lang, source) || '","' || greatest(lang, source)
                   || '"],"lever":["' || source || '"]},"filter_rules":{"include":["\\u003cb\\u003e \\u0026","' || lang
                   || '"],"exclude":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '["' || source || '"]' END
                   || '},"screening_model":"m' || (doc_id % 3) || '","score_bands":[{"name":"reject","min":0,"max":'
                   || (40 + doc_id % 2) || '.5},{"name":"viable","min":80,"max":100}],"band_targets":'
                   || CASE WHEN doc_id % 5 = 0 THEN 'null' ELSE
                      '[{"band":"reject","target":4,"floor":0},{"band":"viable","target":8,"floor":8}]' END
                   || ',"panel_size":' || (n_chars % 50) || '}' AS doc
        FROM documents)
    SELECT doc_id, 'config-' || substr(sha256(doc), 1, 12) AS config_id FROM d""")
def config_ids(spark, sf_dir):
    """One configuration per text, its collections in no particular order."""
    doc = F.col("doc_id")
    bands = F.array(
        F.struct(F.lit("viable").alias("name"), F.lit(80.0).alias("min"), F.lit(100.0).alias("max")),
        F.struct(F.lit("reject").alias("name"), F.lit(0.0).alias("min"), (F.lit(40.5) + doc % 2).alias("max")),
    )
    target = "struct<band: string, target: int, floor: int>"
    targets = F.array(
        F.struct(F.lit("viable"), F.lit(8), F.lit(8)).cast(target), F.struct(F.lit("reject"), F.lit(4), F.lit(0)).cast(target)
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        config_id_column(
            F.create_map(F.lit("lever"), F.array("source"), F.lit("greenhouse"), F.array("source", "lang")),
            F.array(F.col("lang"), F.lit("<b> &")),
            F.when(doc % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("source")),
            F.concat(F.lit("m"), (doc % 3).cast("string")),
            bands,
            F.when(doc % 5 == 0, F.array().cast(f"array<{target}>")).otherwise(targets),
            F.col("n_chars") % 50,
        ).alias("config_id"),
    )


@registered(sql_over("ledger", body="""
    SELECT event_id, CAST(strftime(scored_at, '%Y%m%d%H%M%S') AS BIGINT) AS seed,
           'panel-' || user_id || '-' || strftime(scored_at, '%Y%m%dT%H%M%SZ') AS panel_id
    FROM ledger"""))
def panel_identity(spark, sf_dir):
    return ledger(spark, sf_dir).select(
        "event_id", derived_seed(F.col("scored_at")).alias("seed"),
        panel_id(F.col("user_id"), F.col("scored_at")).alias("panel_id"),
    )


# Sizes of five days, for each of the five cycles.
SWEEP_SQL = "[[1, 10, 2, 5, 3], [2, 1, 3, 10, 5], [3, 2, 5, 1, 10], [5, 3, 10, 2, 1], [10, 5, 1, 3, 2]]"


@registered(sql_over("ledger", body=f"""
    , d AS (SELECT day, count(*) AS events, greatest(date_diff('day', DATE '2024-01-03', CAST(day AS DATE)), 0) AS i
            FROM ledger GROUP BY day)
    SELECT day, events, {SWEEP_SQL}[(i // 5) % 5 + 1][i % 5 + 1] AS batch_size FROM d"""))
def batch_sweep_calendar(spark, sf_dir):
    days = ledger(spark, sf_dir).groupBy("day").agg(F.count("*").alias("events"))
    index = day_index(F.lit("2024-01-03").cast("timestamp"), F.col("day").cast("timestamp"))
    return days.select("day", "events", batch_size_of_day(index).alias("batch_size"))


@registered(sql_over("ledger", body=f"""
    , d AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', CAST(day AS DATE)) AS i FROM ledger)
    SELECT {SWEEP_SQL}[(i // 5) % 5 + 1][i % 5 + 1] AS batch_size, count(*) AS days FROM d GROUP BY 1"""))
def batch_sweep_allocation(spark, sf_dir):
    days = ledger(spark, sf_dir).select("day").distinct()
    index = day_index(F.lit("2024-01-01").cast("timestamp"), F.col("day").cast("timestamp"))
    return days.groupBy(batch_size_of_day(index).alias("batch_size")).agg(F.count("*").alias("days"))
