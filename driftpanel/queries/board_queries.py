"""Queries over postings: decoding, keys, filters, liveness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftpanel.functions.moments import NO_DATE_EPOCH
from driftpanel.functions.pay import pay_period, salary
from driftpanel.functions.payload import html_safe_bytes, job_payload
from driftpanel.operators import liveness
from driftpanel.operators.filters import filter_postings
from driftpanel.operators.jobs_table import JobsTable
from driftpanel.plans.runs import job_rows
from driftpanel.queries.registry import registered
from driftpanel.queries.views import SITE, postings, sql_over, table, text_postings
from driftpanel.session import scratch_path, written_once
from driftpanel.sources.boards import (
    collect_boards, fetched_counts, mentions_remote, parse_payloads, postings_of, quarantined,
)

ONE_SECOND_PAST = 250  # milliseconds that must round away


def _payload(cased):
    """A document as its board sends it."""
    doc, no_date = F.col("doc_id"), F.col("doc_id") % 5 == 0
    moment = F.timestamp_seconds("posted_at")
    utc = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    east = F.concat(F.date_format(moment + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".5+02:00"))

    def document(**fields):
        return F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(cased(k)) for k, v in fields.items()])

    greenhouse = document(
        title="title", content="description", absolute_url="url",
        updated_at=F.when(no_date, F.date_format(moment, "yyyy-MM-dd")).otherwise(east), location=document(name="location"),
    )
    ashby = document(
        title="title", location="location", descriptionHtml="description", jobUrl="url",
        isListed=F.when(doc % 14 != 0, doc % 7 != 0), isRemote=doc % 2 == 0, publishedAt=F.when(~no_date, utc),
    )
    lever = document(
        id=doc.cast("string"), text="title", hostedUrl="url", descriptionPlain="description",
        workplaceType=F.when(doc % 2 == 0, "remote").otherwise("Remote-ish"),
        createdAt=F.when(~no_date, F.col("posted_at") * 1000 + ONE_SECOND_PAST), categories=document(location="location"),
    )
    return (
        F.when(doc % 3 == 0, F.to_json(document(jobs=F.array(greenhouse))))
        .when(doc % 3 == 1, F.to_json(document(jobs=F.array(ashby))))
        .otherwise(F.to_json(F.array(lever)))
    )


def landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents wrapped into the payload shapes of the three boards.

    Every fifth date is unusable, every seventh posting unlisted, every
    thirteenth payload cut off; every eleventh has its names in capitals.
    """
    docs = text_postings(spark, sf_dir)
    doc = F.col("doc_id")
    payload = F.when(doc % 11 == 0, _payload(str.upper)).otherwise(_payload(str))
    # Payloads that broke off on the way arrive beside the whole ones.
    arrived = F.when(doc % 13 == 0, F.array(payload, F.substring(payload, 1, 60))).otherwise(F.array(payload))
    return docs.select(
        "doc_id",
        F.element_at(F.array(F.lit("greenhouse"), F.lit("ashby"), F.lit("lever")), (doc % 3 + 1).cast("int"))
        .alias("provider"),
        "company", F.explode_outer(arrived).alias("payload"),
    )


DECODED_SQL = f"""
    SELECT regexp_replace(company || title, '\\s+', '', 'g') || posted AS key, title, company, location, url,
           source_label AS source, posted AS posted_at, remote AS is_remote,
           CAST(strlen(description) AS BIGINT) AS description_bytes
    FROM (
        SELECT *, CASE WHEN doc_id % 5 <> 0 THEN posted_at WHEN doc_id % 3 = 2 THEN 0 ELSE {NO_DATE_EPOCH} END AS posted,
               CASE doc_id % 3 WHEN 0 THEN 'greenhouse:' || company WHEN 1 THEN 'ashby' ELSE 'lever:' || company END
                   AS source_label,
               CASE doc_id % 3 WHEN 0 THEN contains(lower(location), 'remote') OR contains(lower(description), 'remote')
                    ELSE doc_id % 2 = 0 END AS remote
        FROM text_postings
        WHERE NOT (doc_id % 3 = 1 AND doc_id % 7 = 0))"""


@registered(sql_over("text_postings", body=DECODED_SQL))
def board_union_normalised(spark, sf_dir):
    rows = landing(spark, sf_dir)
    sources = rows.select("provider", "company")
    return collect_boards(rows, sources).select(
        "key", "title", "company", "location", "url", "source", "posted_at", "is_remote",
        F.octet_length("description").cast("bigint").alias("description_bytes"),
    )


@registered("""
    SELECT CASE doc_id % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'ashby' ELSE 'lever' END AS provider,
           source AS company, count(*) AS payloads
    FROM documents WHERE doc_id % 13 = 0 GROUP BY ALL""")
def quarantined_payloads(spark, sf_dir):
    bad = quarantined(parse_payloads(landing(spark, sf_dir)))
    return bad.groupBy("provider", "company").agg(F.count("*").alias("payloads"))


@registered("""
    SELECT CASE doc_id % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'ashby' ELSE 'lever' END AS provider,
           source AS company, count(*) AS listed FROM documents
    WHERE NOT (doc_id % 3 = 1 AND doc_id % 7 = 0) GROUP BY ALL""")
def listed_only(spark, sf_dir):
    """Only one provider marks postings as unlisted; all are decoded."""
    rows = postings_of(parse_payloads(landing(spark, sf_dir)))
    return rows.groupBy(F.substring_index("source", ":", 1).alias("provider"), "company").agg(F.count("*").alias("listed"))


@registered("""
    SELECT CASE doc_id % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'ashby' ELSE 'lever' END AS provider,
           source AS company, count(*) AS fetched
    FROM documents GROUP BY ALL""")
def fetched_per_company(spark, sf_dir):
    return fetched_counts(parse_payloads(landing(spark, sf_dir)))


@registered(sql_over("postings", body="SELECT order_id, key, stablekey, composite_key FROM postings"))
def stable_and_composite_keys(spark, sf_dir):
    return postings(spark, sf_dir).select("order_id", "key", "stablekey", "composite_key")


INCLUDE, EXCLUDE = ("the", "ein", "on."), ("Licen", "x.*", "éeç")


@registered(sql_over("text_postings", body="""
    SELECT doc_id FROM text_postings
    WHERE is_remote
      AND (contains(lower(description || ' ' || location), 'the') OR contains(lower(description || ' ' || location), 'ein')
           OR contains(lower(description || ' ' || location), 'on.'))
      AND NOT (contains(lower(description || ' ' || location), 'licen') OR contains(lower(description || ' ' || location), 'x.*')
           OR contains(lower(description || ' ' || location), 'éeç'))"""))
def keyword_filter(spark, sf_dir):
    """Over whole texts: each document is its own title."""
    rows = text_postings(spark, sf_dir).withColumn("title", F.col("description"))
    return filter_postings(rows, INCLUDE, EXCLUDE).select("doc_id")


@registered("""
    SELECT page_id, contains(lower(url), 'remote') OR contains(lower(html), 'remote') AS is_remote FROM pages
    UNION ALL
    SELECT -doc_id - 1, contains(lower(lang), 'remote') OR contains(lower(text), 'remote') FROM documents""")
def remote_flag(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", (mentions_remote(F.col("url")) | mentions_remote(F.col("html"))).alias("is_remote")
    )
    docs = table(spark, sf_dir, "documents").select(
        (-F.col("doc_id") - 1).alias("page_id"),
        (mentions_remote(F.col("lang")) | mentions_remote(F.col("text"))).alias("is_remote"),
    )
    return pages.unionByName(docs)


@registered("""
    WITH p AS (
        SELECT page_id, url AS title, html AS description, page_id % 2 = 0 AS is_remote FROM pages
        UNION ALL SELECT -doc_id - 1, source, text, doc_id % 2 = 0 FROM documents),
    j AS (
        SELECT page_id, description, CAST(CASE WHEN is_remote THEN
            json_object('key', 'k', 'title', title, 'company', 'c', 'location', '', 'description', description,
                        'url', title, 'source', 's', 'posted_at', page_id, 'is_remote', true)
          ELSE
            json_object('key', 'k', 'title', title, 'company', 'c', 'location', '', 'description', description,
                        'url', title, 'source', 's', 'posted_at', page_id) END AS VARCHAR) AS doc FROM p)
    SELECT page_id, CAST(strlen(description) AS BIGINT) AS description_chars,
           CAST(strlen(doc) + 5 * (length(doc) - length(translate(doc, '<>&', '')))
                + 3 * (length(doc) - length(translate(doc, chr(8232) || chr(8233), ''))) AS BIGINT) AS payload_chars
    FROM j""")
def payload_bytes(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.col("url").alias("title"), F.col("html").alias("description"),
        (F.col("page_id") % 2 == 0).alias("is_remote"),
    )
    docs = table(spark, sf_dir, "documents").select(
        (-F.col("doc_id") - 1).alias("page_id"), F.col("source").alias("title"),
        F.col("text").alias("description"), (F.col("doc_id") % 2 == 0).alias("is_remote"),
    )
    rows = pages.unionByName(docs).select(
        "*", F.lit("k").alias("key"), F.lit("c").alias("company"), F.lit("").alias("location"),
        F.col("title").alias("url"), F.lit("s").alias("source"), F.col("page_id").alias("posted_at"),
    )
    return rows.select(
        "page_id", F.octet_length("description").cast("bigint").alias("description_chars"),
        html_safe_bytes(job_payload()).cast("bigint").alias("payload_chars"),
    )


@registered("""
    WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0 ELSE round(o_totalprice) END AS lo,
                      CASE o_orderkey % 4 WHEN 0 THEN 0 ELSE round(o_totalprice) + 500 END AS hi FROM orders)
    SELECT o_orderkey,
           CASE WHEN hi > 0 THEN lo / 100 WHEN o_orderkey % 8 = 0 THEN 0.0 ELSE 0.01 END AS min_salary,
           CASE WHEN hi > 0 THEN hi / 100 WHEN o_orderkey % 8 = 0 THEN 0.0 ELSE 0.02 END AS max_salary,
           CASE WHEN hi > 0 THEN 'USD' WHEN o_orderkey % 8 = 0 THEN '' ELSE 'EUR' END AS currency,
           CASE WHEN hi > 0 THEN (CASE o_orderkey % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'hour' ELSE 'per-piece' END)
                WHEN o_orderkey % 8 = 0 THEN '' ELSE 'month' END AS period
    FROM r""")
def pay_ranges(spark, sf_dir):
    order = F.col("o_orderkey")
    paid = order % 4 != 0
    low = F.when(paid, F.round("o_totalprice")).otherwise(0.0)
    high = F.when(paid, F.round("o_totalprice") + 500).otherwise(0.0)
    label = F.when(order % 3 == 0, "per-year-salary").when(order % 3 == 1, "per-hour-wage").otherwise("per-piece")

    def pay_range(lo, hi, currency, interval):
        return F.struct(
            lo.alias("min_cents"), hi.alias("max_cents"), currency.alias("currency_type"), interval.alias("interval")
        )

    first = pay_range(low, high, F.lit("USD"), label)
    second = F.when(order % 8 != 0, pay_range(F.lit(1.0), F.lit(2.0), F.lit("EUR"), F.lit("per-month-salary")))
    ranges = F.array_compact(F.array(first, second))
    return table(spark, sf_dir, "orders").select("o_orderkey", salary(ranges).alias("s")).select(
        "o_orderkey", "s.min_salary", "s.max_salary", "s.currency", pay_period(F.col("s.period")).alias("period")
    )


CUT = 852076800  # 1997-01-01
OVERLAP = 820454400  # 1996-01-01
NOW = 860000000


def _seen(spark, sf_dir):
    """Postings seen up to the cut, last ten days after they were posted."""
    return (
        postings(spark, sf_dir).filter(F.col("posted_at") < CUT)
        .groupBy("composite_key", "stablekey", "posted_at")
        .agg((F.min("order_id") % 11 == 0).alias("has_applied"))
        .withColumn("last_seen", F.timestamp_seconds(F.col("posted_at") + 864000))
    )


def _current(spark, sf_dir):
    return postings(spark, sf_dir).filter(F.col("posted_at") >= OVERLAP)


@registered(sql_over("postings", body=f"""
    SELECT order_id, composite_key FROM postings WHERE posted_at >= {OVERLAP}
      AND composite_key NOT IN (SELECT composite_key FROM postings WHERE posted_at < {CUT})"""))
def fresh_candidates(spark, sf_dir):
    fresh = liveness.fresh_postings(_current(spark, sf_dir), _seen(spark, sf_dir))
    return fresh.select("order_id", "composite_key")


LIVENESS_CTE = f"""
    , seen AS (
        SELECT composite_key, posted_at, min(order_id) % 11 = 0 AS has_applied, posted_at + 864000 AS last_seen
        FROM postings WHERE posted_at < {CUT} GROUP BY ALL),
    split AS (
        SELECT *, CASE WHEN composite_key IN (SELECT composite_key FROM postings WHERE posted_at >= {OVERLAP}) THEN 'bump'
                       WHEN last_seen < {NOW} - 172800 AND NOT has_applied THEN 'age' ELSE 'keep' END AS action
        FROM seen)"""


@registered(sql_over("postings", body=LIVENESS_CTE + " SELECT composite_key, action FROM split"))
def liveness_split(spark, sf_dir):
    now = F.timestamp_seconds(F.lit(NOW))
    return liveness.liveness_split(_seen(spark, sf_dir), _current(spark, sf_dir), now).select(
        "composite_key", "action"
    )


@registered(sql_over("postings", body=LIVENESS_CTE + f"""
    SELECT composite_key, CASE WHEN action = 'bump' THEN {NOW} ELSE last_seen END AS last_seen, has_applied
    FROM split WHERE action <> 'age'"""))
def liveness_maintained(spark, sf_dir):
    now = F.timestamp_seconds(F.lit(NOW))
    kept = liveness.maintain(_seen(spark, sf_dir), _current(spark, sf_dir), now, delete=True)
    return kept.select("composite_key", F.unix_seconds("last_seen").alias("last_seen"), "has_applied")


@registered(sql_over("postings", body=f"""
    , c AS (SELECT * FROM postings WHERE posted_at >= {OVERLAP} AND is_remote
              AND contains(lower(title || ' ' || location), 'high')
              AND NOT contains(lower(title || ' ' || location), 'machinery'))
    SELECT 'all' AS policy, order_id FROM c
    UNION ALL
    SELECT 'fresh', order_id FROM c
    WHERE composite_key NOT IN (SELECT composite_key FROM postings WHERE posted_at < {CUT})"""))
def rescore_policy(spark, sf_dir):
    """Candidates under both policies."""
    current, seen = _current(spark, sf_dir), _seen(spark, sf_dir)
    words = (("HIGH",), ("Machinery",))
    both = [
        liveness.candidates(current, seen, rescore_all, *words).select(F.lit(name).alias("policy"), "order_id")
        for name, rescore_all in (("all", True), ("fresh", False))
    ]
    return both[0].unionByName(both[1])


FIRST_LOAD, SECOND_LOAD = 1000000000, 1000086400


@registered(sql_over("postings", body=f"""
    , k AS (
        SELECT composite_key, min(url) FILTER (WHERE order_id % 3 < 2) AS url1,
               min(url) FILTER (WHERE order_id % 3 >= 1) AS url2
        FROM postings GROUP BY ALL)
    SELECT composite_key, coalesce(url1, url2) AS url,
           CASE WHEN url1 IS NULL THEN {SECOND_LOAD} ELSE {FIRST_LOAD} END AS first_epoch,
           CASE WHEN url2 IS NULL THEN {FIRST_LOAD} ELSE {SECOND_LOAD} END AS last_epoch
    FROM k"""))
def jobs_upsert(spark, sf_dir):
    """Two loads into the jobs table, read back."""
    jobs = JobsTable(spark, scratch_path(spark, "jobs"), 16)
    loads = postings(spark, sf_dir).withColumn("load", F.col("order_id") % 3)
    jobs.advance("1", F.timestamp_seconds(F.lit(FIRST_LOAD)), written_once(job_rows(loads.filter("load < 2")), "load"))
    jobs.advance("2", F.timestamp_seconds(F.lit(SECOND_LOAD)), written_once(job_rows(loads.filter("load >= 1")), "load"))
    return jobs.read().select(
        "composite_key", "url", F.unix_seconds("first_seen").alias("first_epoch"),
        F.unix_seconds("last_seen").alias("last_epoch"),
    )


@registered(sql_over("postings", body=f"""
    SELECT company, count(*) AS collected, count(DISTINCT composite_key) AS live_keys,
           count(*) FILTER (WHERE posted_at >= {CUT}) AS recent, count(*) FILTER (WHERE is_remote) AS matched
    FROM postings GROUP BY company"""))
def funnel_counts(spark, sf_dir):
    return postings(spark, sf_dir).groupBy("company").agg(
        F.count("*").alias("collected"), F.countDistinct("composite_key").alias("live_keys"),
        F.count_if(F.col("posted_at") >= CUT).alias("recent"), F.count_if("is_remote").alias("matched"),
    )
