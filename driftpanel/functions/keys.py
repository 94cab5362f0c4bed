"""Posting identity, content hashes and panel names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unicode white space, not only the ASCII kind.
WHITESPACE_RUN = r"(?U)\s+"
HASH_CHARS = 12


def strip_spaces(text: Column) -> Column:
    return F.regexp_replace(text, WHITESPACE_RUN, "")


def stable_key(company: Column, title: Column, location: Column) -> Column:
    return strip_spaces(F.concat(company, title, location))


def composite_key(stablekey: Column, posted_at: Column) -> Column:
    return F.concat_ws("#", stablekey, posted_at.cast("string"))


def job_key(company: Column, title: Column, posted_at: Column) -> Column:
    """Location takes no part: postings that differ only there share a key."""
    return F.concat(strip_spaces(company), strip_spaces(title), posted_at.cast("string"))


def content_hash(content: Column) -> Column:
    """Short sha256; also the resume id and the contributor pseudonym."""
    return F.substring(F.sha2(content, 256), 1, HASH_CHARS)


def utc_format(moment: Column, pattern: str) -> Column:
    """Formats a timestamp; the session runs in UTC."""
    return F.date_format(moment, pattern)


def panel_id(seed: Column, built_at: Column) -> Column:
    return F.concat(
        F.lit("panel-"), seed.cast("string"), F.lit("-"), utc_format(built_at, "yyyyMMdd'T'HHmmss'Z'")
    )


def derived_seed(moment: Column) -> Column:
    return utc_format(moment, "yyyyMMddHHmmss").cast("bigint")


def with_identity(postings):
    """Adds key, stablekey and composite_key to a postings DataFrame."""
    return (
        postings.withColumn("key", job_key(F.col("company"), F.col("title"), F.col("posted_at")))
        .withColumn("stablekey", stable_key(F.col("company"), F.col("title"), F.col("location")))
        .withColumn("composite_key", composite_key(F.col("stablekey"), F.col("posted_at")))
    )
