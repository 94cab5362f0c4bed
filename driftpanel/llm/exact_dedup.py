r"""Exact deduplication with a stateful stream: column expressions only.

The files of a table are read as a stream. State is keyed by the digest of a text's normal
form (each run of ASCII white space as one space), lives on the executors' disks (RocksDB,
copied to the shared checkpoint folder) and never expires. It retains, per digest, the row
that stays, by identifier and by locator (file and row in the file), and the number of rows.
Rows fold on the map side first, so a third of all rows with one text is one state row per
task. Later files go into the same state: calling `remember` again with the same
checkpoint reads only what is new, and a run that stopped goes on where its checkpoint ends.

A digest alone decides nothing. Every row that hits a digest is compared, as a whole text,
with the content at the retained locator; digests under which texts differ are settled again
by the texts themselves.

Which row stays: the one with the smallest identifier; of equal identifiers, and of rows
without one, the first by file and row. An identifier beats none. Nulls: text counts as
empty. Empty texts are equal to each other. A table without rows gives no rows. Other columns,
whatever their names, are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftpanel.llm.common import stored
from driftpanel.session import configure, scratch_path

SPACES = r"[\x20\x09-\x0D]+"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # All state partitions of an executor share one write buffer and cache.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Small stores are many: none reserves megabytes for its logs ahead.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def located(df: DataFrame, id_column: str, text_column: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(id, path, at, content, digest): `content` is the normal form, (path, at) says where the row stands."""
    place = df.metadataColumn("_metadata")
    content = F.regexp_replace(F.coalesce(df[text_column], F.lit("")), SPACES, " ")
    return df.select(
        df[id_column].cast("long").alias("id"), place["file_path"].alias("path"), place["row_index"].alias("at"),
        content.alias("content"),
    ).withColumn("digest", digest(F.col("content")))


def as_pattern(path: str) -> str:
    """The path as a pattern that matches itself: a stream reads single files only by pattern."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def remember(spark: SparkSession, path: str, checkpoint: str, id_column: str = "doc_id", text_column: str = "text",
             digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None) -> None:
    """Folds every file under `path` that the checkpoint doesn't know yet into its state."""
    configure(spark)
    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    try:
        for name, value in STATE_SETTINGS.items():
            spark.conf.set(name, value)
        source = spark.readStream.schema(spark.read.parquet(path).schema)
        if files_per_batch:
            source = source.option("maxFilesPerTrigger", files_per_batch)
        rows = located(source.parquet(as_pattern(path)), id_column, text_column, digest)
        first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "path", "at")).alias("keep")
        folded = rows.groupBy("digest").agg(first, F.count("*").alias("n"))
        # The state is the result; nothing else is written.
        folded.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(
            availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state: (digest, keep, n)."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.digest", "value.*").toDF("digest", "keep", "n")


def deduplicate(spark: SparkSession, path: str, checkpoint: str | None = None, id_column: str = "doc_id",
                text_column: str = "text", digest: Callable[[Column], Column] = sha256,
                files_per_batch: int | None = None) -> DataFrame:
    """Per row of the table at `path`: id, path, at, digest, keep_id, keep_path, keep_at, n, kept.

    `n` is the number of rows with the same text, `kept` says that this row stays.
    """
    checkpoint = checkpoint or scratch_path(spark, "dedup-state")
    remember(spark, path, checkpoint, id_column, text_column, digest, files_per_batch)
    rows = located(spark.read.parquet(path), id_column, text_column, digest)
    stays = (F.col("path") == F.col("keep.path")) & (F.col("at") == F.col("keep.at"))
    # Texts are needed again only where a digest was hit more than once.
    held = stored(
        rows.join(remembered(spark, checkpoint), "digest").select(
            "id", "path", "at", "digest", "keep.id", "keep.path", "keep.at", "n", stays,
            F.when(F.col("n") > 1, F.col("content")),
        ).toDF("id", "path", "at", "digest", "keep_id", "keep_path", "keep_at", "n", "kept", "content"),
        "dedup-held",
    )
    hits = held.filter("n > 1")
    first = hits.filter("kept").select("digest", F.col("content").alias("kept_content"))
    unlike = hits.filter("not kept").join(first, "digest").filter("content <> kept_content").select("digest")
    # Written as joined, so that one digest's many rows can be split over tasks.
    clashes = stored(unlike, "dedup-clashes")
    if clashes.isEmpty():
        return held.drop("content")
    clashes = clashes.distinct()
    return held.join(clashes, "digest", "left_anti").drop("content").unionByName(by_content(held.join(clashes, "digest", "left_semi")))


def by_content(rows: DataFrame) -> DataFrame:
    """The same verdicts where one digest stands for several texts, by the texts."""
    first = F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "path", "at")).alias("keep")
    groups = rows.groupBy("digest", "content").agg(first, F.count("*").alias("n"))
    stays = (F.col("path") == F.col("keep.path")) & (F.col("at") == F.col("keep.at"))
    return rows.select("id", "path", "at", "digest", "content").join(groups, ["digest", "content"]).select(
        "id", "path", "at", "digest", "keep.id", "keep.path", "keep.at", "n", stays,
    ).toDF("id", "path", "at", "digest", "keep_id", "keep_path", "keep_at", "n", "kept")
