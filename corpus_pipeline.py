"""The corpus pipeline: stages from raw documents to sampled pieces.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet
in the shared folder and read again for the next one. All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftpanel.llm.common import stored, table
from driftpanel.llm.contamination import clean
from driftpanel.llm.jaccard_join import one_of_each
from driftpanel.llm.language import identify
from driftpanel.llm.line_dedup import dedup_lines
from driftpanel.llm.piece_sampling import with_pieces


# The stages' Python workers live on through all of them. What they free goes back to the
# machine at once, instead of staying with each of them for its largest batch so far.
FRUGAL = {
    "MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "262144",
    "ARROW_DEFAULT_MEMORY_POOL": "system", "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1",
}


def frugal(stage: Callable) -> Callable:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.sparkContext.environment.update(FRUGAL)
        return stage(spark, docs, sf_dir)

    return run


def besides(docs: DataFrame, *left_out: str):
    """A document's other columns, as one."""
    return F.struct(*[docs[c] for c in docs.columns if c not in left_out])


@frugal
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told, by text, declared language and source.

    Documents that agree in what is looked at are judged alike, so the few that are rejected
    are taken out by that; the others never travel.
    """
    looked_at = F.xxhash64("text", "lang", "source")
    found = identify(docs, "doc_id", "text", "lang", "source", carry=looked_at)
    rejected = stored(found.filter(~F.col("kept")).select("id", F.col("carry").alias("looked_at")).distinct(), "rejected")
    return docs.join(rejected, docs["doc_id"].eqNullSafe(rejected["id"]) & (looked_at == rejected["looked_at"]), "left_anti")


@frugal
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stood before, in any document, or nearly so.

    Every line with a word is compared. A document goes when lines of it go and no word is
    left in the others; so does one whose whole text equals an earlier one. `n_chars` follows
    the text.
    """
    found = dedup_lines(docs, carry=besides(docs, "text"), equal_from=1)
    gone = F.col("n_equal") + F.col("n_near")
    left = found.filter((gone == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("text"), "n_chars": F.when(gone > 0, F.length("text").cast("long")).otherwise(F.col("carry.n_chars"))}
    return left.select(*[changed.get(c, F.col(f"carry.`{c}`")).alias(c) for c in docs.columns])


@frugal
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return one_of_each(docs, n=5, percent=80)


@frugal
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


@frugal
def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a sampled segmentation; `lossless` says that decoding gives the text back."""
    return with_pieces(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sampled_pieces", sampled_pieces),
]

# SQL can't express trained language models, edit-distance neighbourhoods or sampling.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
