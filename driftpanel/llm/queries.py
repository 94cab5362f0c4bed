"""One registered query per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftpanel.llm import licenses, oracles, personal_data
from driftpanel.llm.common import sha256_of, table
from driftpanel.llm.contamination import decontaminate
from driftpanel.llm.exact_dedup import deduplicate
from driftpanel.llm.jaccard_join import jaccard_groups
from driftpanel.llm.language import identify
from driftpanel.llm.line_dedup import dedup_lines
from driftpanel.llm.piece_sampling import encode
from driftpanel.llm.quality import repetition_coverage
from driftpanel.llm.source_audit import audit_sources
from driftpanel.llm.suffix_tree import suffix_tree_scores
from driftpanel.llm.token_files import token_counts
from driftpanel.llm.vector_codes import coded

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "declared", "language", F.round("posterior", 6).alias("posterior"), "known_share", "kept")


@query()
def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over web pages: markup language, address suffix and hosts as evidence."""
    text = F.regexp_replace("html", r"(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")
    declared = F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?\s*([A-Za-z][A-Za-z0-9_-]*)", 1), F.lit(""))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", text.alias("text"), declared.alias("declared"))
    found = identify(pages, "page_id", "text", "declared", "url")
    return found.select(F.col("id").alias("page_id"), "declared", "language", F.round("posterior", 6).alias("posterior"), "kept")


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


@query()
def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.size("pieces").cast("long").alias("n_pieces"),
                        F.xxhash64("pieces").alias("pieces_hash"), "lossless")


@query(oracles.private())
def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find_personal_data(table(spark, sf_dir, "documents")))


@query(oracles.license_texts())
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


@query()
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"), equal_from=1)
    return found.select(F.col("id").alias("doc_id"), "n_lines", "n_equal", "n_near", F.sha2("text", 256).alias("text_sha256"))


@query()
def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_scores(table(spark, sf_dir, "documents"))


@query(oracles.repetition())
def op6_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition_coverage(table(spark, sf_dir, "documents"))
    return found.drop("gram_share", "line_share")


@query(oracles.jaccard(3, 90))
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_groups(table(spark, sf_dir, "documents"), n=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), F.col("n_grams").alias("n_shingles"), F.col("group_id").alias("component_id"))


@query(oracles.WINNOWING)
def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        sha256_of(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query(oracles.SOURCE_AUDIT)
def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


@query(oracles.vector_codes())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query(oracles.EXACT)
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(spark, f"{sf_dir}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))
