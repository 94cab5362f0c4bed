"""Stand-ins for postings, landing payloads and the ledger over the given tables.

Each view exists twice, as a DataFrame and as SQL, with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftpanel.functions.keys import with_identity
from driftpanel.functions.moments import epoch_micros
from driftpanel.functions.payload import display_score

SITE = "https://boards.example/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings: company is the customer's nation."""
    rows = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("order_id"),
            F.col("n_name").alias("company"),
            F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("title"),
            F.col("o_orderstatus").alias("location"),
            F.col("c_name").alias("description"),
            F.concat(F.lit(SITE), F.col("o_orderkey").cast("string")).alias("url"),
            F.concat(F.lit("board:"), F.col("n_name")).alias("source"),
            F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("posted_at"),
            (F.col("o_orderkey") % 10 < 7).alias("is_remote"),
            F.least(F.lit(100.0), F.col("o_totalprice") / 5000).alias("score"),
        )
    )
    return with_identity(rows)


def text_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: the first characters are the title."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("company"),
        F.left("text", F.lit(40)).alias("title"),
        F.col("lang").alias("location"),
        F.col("text").alias("description"),
        F.concat(F.lit(SITE), F.col("doc_id").cast("string")).alias("url"),
        F.concat(F.lit("board:"), F.col("source")).alias("source"),
        (F.lit(1700000000) + 3600 * F.col("doc_id")).alias("posted_at"),
        (F.col("doc_id") % 10 < 7).alias("is_remote"),
    )
    return with_identity(rows)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scoring events: the event type is the model, the user the posting."""
    sentinel = F.col("event_id") % 37 == 0
    capped = F.least(F.lit(100.0), F.col("value"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id",
        F.col("event_type").alias("model"),
        F.concat_ws("-", "event_type", (F.col("user_id") % 3).cast("string")).alias("deployment"),
        F.col("user_id").cast("string").alias("composite_key"),
        F.col("ts").cast("timestamp").alias("scored_at"),
        epoch_micros(F.col("ts")).alias("micros"),
        F.to_date("ts").cast("string").alias("day"),
        F.when(sentinel, -2.0).otherwise(capped).alias("emitted_score"),
        F.when(~sentinel & (F.col("event_id") % 4 != 0), capped * 0.99).alias("ev_score"),
        F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)).alias("tokens"),
        F.element_at(F.array(*[F.lit(n) for n in (1, 2, 3, 5, 10)]),
                     (F.col("user_id") % 5 + 1).cast("int")).alias("batch_size"),
        F.concat(F.lit("c"), (F.col("user_id") % 4).cast("string")).alias("contributor_id"),
        F.concat(F.lit("config-"), (F.col("event_id") % 2).cast("string")).alias("config_id"),
        F.concat(F.lit("i"), (F.col("user_id") % 2).cast("string")).alias("instructions_version"),
        (F.col("event_id") % 2).cast("double").alias("temperature_sent"),
    )
    return rows.withColumn("score", display_score(F.col("ev_score"), F.col("emitted_score")))


def valid_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).filter("emitted_score >= 0")


SQL_VIEWS = {
    "postings": f"""
        SELECT *, replace(company || title, ' ', '') || posted_at AS key,
               replace(company || title || location, ' ', '') AS stablekey,
               replace(company || title || location, ' ', '') || '#' || posted_at AS composite_key
        FROM (
            SELECT o_orderkey AS order_id, n_name AS company,
                   o_orderpriority || ' ' || c_mktsegment AS title, o_orderstatus AS location,
                   c_name AS description, '{SITE}' || o_orderkey AS url,
                   'board:' || n_name AS source, CAST(epoch(o_orderdate) AS BIGINT) AS posted_at,
                   o_orderkey % 10 < 7 AS is_remote,
                   least(100.0::DOUBLE, o_totalprice / 5000) AS score
            FROM orders JOIN customer ON o_custkey = c_custkey
                        JOIN nation ON c_nationkey = n_nationkey)""",
    "text_postings": f"""
        SELECT *, regexp_replace(company || title, '\\s+', '', 'g') || posted_at AS key,
               regexp_replace(company || title || location, '\\s+', '', 'g') AS stablekey
        FROM (
            SELECT doc_id, source AS company, left(text, 40) AS title, lang AS location,
                   text AS description, '{SITE}' || doc_id AS url, 'board:' || source AS source,
                   1700000000 + 3600 * doc_id AS posted_at, doc_id % 10 < 7 AS is_remote
            FROM documents)""",
    "ledger": """
        SELECT *, coalesce(ev_score, emitted_score) AS score
        FROM (
            SELECT event_id, user_id, event_type AS model,
                   event_type || '-' || (user_id % 3) AS deployment,
                   user_id::VARCHAR AS composite_key, ts AS scored_at, epoch_us(ts) AS micros,
                   strftime(ts, '%Y-%m-%d') AS day,
                   CASE WHEN event_id % 37 = 0 THEN -2.0::DOUBLE ELSE least(100.0::DOUBLE, value) END
                       AS emitted_score,
                   CASE WHEN event_id % 37 <> 0 AND event_id % 4 <> 0
                        THEN least(100.0::DOUBLE, value) * 0.99::DOUBLE END AS ev_score,
                   coalesce(CAST(props ->> 'k' AS BIGINT), 0) AS tokens,
                   [1, 2, 3, 5, 10][user_id % 5 + 1] AS batch_size,
                   'c' || (user_id % 4) AS contributor_id, 'config-' || (event_id % 2) AS config_id,
                   'i' || (user_id % 2) AS instructions_version,
                   (event_id % 2)::DOUBLE AS temperature_sent
            FROM events)""",
    "valid_ledger": "SELECT * FROM ledger WHERE emitted_score >= 0",
}
_NEEDS = {"valid_ledger": ("ledger",)}


def sql_over(*views: str, body: str) -> str:
    """``body`` with the named views in front of it; further CTEs follow a comma."""
    names: list[str] = []
    for view in views:
        for name in (*_NEEDS.get(view, ()), view):
            if name not in names:
                names.append(name)
    ctes = ", ".join(f"{name} AS ({SQL_VIEWS[name]})" for name in names)
    body = body.strip()
    return f"WITH {ctes}{body}" if body.startswith(",") else f"WITH {ctes} {body}"


def exact_mean(column: str) -> str:
    """SQL for the mean of a column through exact sums."""
    return f"(CAST(sum(CAST({column} AS DECIMAL(18,6))) AS DOUBLE) / count({column}))"
