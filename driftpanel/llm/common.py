"""What the operators share on the Spark side."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftpanel.session import configure, scratch_path, shared_folder

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepared(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine's paths import the package.

    On a cluster the package travels with --py-files, as any other.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    shared_folder(spark)
    return configure(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once in the shared folder and read from there; cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Within it, what an action shuffles is deleted as soon as the action ends."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def dropped(*tables: DataFrame) -> None:
    """Deletes what `stored` wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, under the operator's own names."""
    return df.select(*[df[theirs].alias(ours) for ours, theirs in columns.items()])


def keyed(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, row, text): the id may be null or stand on several texts, `row` is a hash of the text."""
    return df.select(df[id_column].cast("long").alias("id"), F.xxhash64(df[text]).alias("row"), df[text].alias("text"))


def same_row(df: DataFrame, keys: DataFrame, id_column: str, text: str) -> Column:
    """Joins rows with their (id, row)."""
    return df[id_column].cast("long").eqNullSafe(keys["id"]) & (F.xxhash64(df[text]) == keys["row"])


def without(df: DataFrame, keys: DataFrame, id_column: str, text: str) -> DataFrame:
    """Rows whose (id, row) isn't among the keys."""
    return df.join(keys, same_row(df, keys, id_column, text), "left_anti")


def sha256_of(parts: Column) -> Column:
    """SHA-256 of an array of strings joined by commas, in lower-case hex."""
    return F.sha2(F.concat_ws(",", parts), 256)
