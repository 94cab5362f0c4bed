"""The jobs table: content written once, liveness in buckets, one manifest per load.

Content never changes after the first load of a posting, so each load appends the new
postings' content as files of its own and no load writes old content again. What does
change, ``last_seen``, is a narrow table in hash buckets of the composite key; a load
rewrites only the buckets it touches. A manifest names, for each bucket, the load whose
files hold it. It is one file and is written last: readers see a load whole or not at
all, and files of a load that stopped are never referred to.

Loads follow each other: one writer at a time. Two that met are noticed by two manifests
of the same number. Repeating the latest load changes nothing.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftpanel.operators.liveness import TTL_HOURS, WRITE_ONCE, live_keys

SEEN_TYPE = (
    "composite_key string, stablekey string, posted_at timestamp, first_seen timestamp, "
    "last_seen timestamp, version string, bucket int"
)
CONTENT_TYPE = (
    "composite_key string, source string, title string, company string, url string, payload string, "
    "description_chars int, payload_chars int, version string"
)
CONTENT = ("source", "title", "company", "url", "payload", "description_chars", "payload_chars")
BUCKETS = 64
LOAD_NAME = re.compile(r"[A-Za-z0-9_.-]+")


@dataclass(frozen=True)
class Manifest:
    number: int
    load: str
    buckets: int
    versions: dict[int, str]  # bucket -> version whose files hold it

    @property
    def version(self) -> str:
        return f"{self.number:08d}-{self.load}"

    def text(self) -> str:
        return json.dumps(
            {"number": self.number, "load": self.load, "buckets": self.buckets,
             "versions": {str(b): v for b, v in sorted(self.versions.items())}}
        )

    @classmethod
    def parse(cls, text: str) -> Manifest:
        found = json.loads(text)
        versions = {int(b): v for b, v in found["versions"].items()}
        return cls(found["number"], found["load"], found["buckets"], versions)


def files_under(spark: SparkSession, path: str) -> list[str]:
    """Data files under a folder; none if there is no such folder."""
    try:
        return spark.read.schema("value string").text(path).inputFiles()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


class JobsTable:
    """``buckets`` only counts when the first load is written."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        if buckets <= 0:
            raise ValueError(f"the number of buckets must be positive, not {buckets}")
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets

    def manifest(self) -> Manifest | None:
        """The newest manifest. Manifests are listed, only one is read."""
        files = files_under(self.spark, f"{self.root}/manifests/*")
        if not files:
            return None
        names = sorted((file.rsplit("/", 2)[1], file) for file in files)
        if len(names) > 1 and names[-1][0].split("-")[0] == names[-2][0].split("-")[0]:
            raise RuntimeError(f"two loads wrote version {names[-1][0].split('-')[0]} of {self.root}")
        return Manifest.parse(self.spark.read.text(names[-1][1], wholetext=True).first()[0])

    def seen(self, manifest: Manifest | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The narrow table: keys, ``first_seen``, ``last_seen``; of some buckets only, if named."""
        manifest = manifest or self.manifest()
        held = manifest.versions if manifest else {}
        paths = [
            f"{self.root}/seen/version={version}/bucket={bucket}"
            for bucket, version in held.items() if buckets is None or bucket in buckets
        ]
        if not paths:
            return self.spark.createDataFrame([], SEEN_TYPE)
        # The folders name the load that wrote the bucket; a row's version is that of its content.
        stored = SEEN_TYPE.replace("version", "content_version")
        rows = self.spark.read.schema(stored).option("basePath", f"{self.root}/seen").parquet(*paths)
        return rows.drop("version").withColumnRenamed("content_version", "version")

    def read(self) -> DataFrame:
        """Whole rows of the table."""
        seen = self.seen()
        if files_under(self.spark, f"{self.root}/content/*"):
            content = self.spark.read.schema(CONTENT_TYPE).parquet(f"{self.root}/content")
        else:
            content = self.spark.createDataFrame([], CONTENT_TYPE)
        return seen.join(content, ["version", "composite_key"]).select(
            "composite_key", *WRITE_ONCE, "first_seen", "last_seen")

    def advance(self, load: str, now: Column, incoming: DataFrame | None = None, live: DataFrame | None = None,
                delete_aged: bool = False) -> Manifest:
        """Applies one load and gives its manifest.

        Stored postings among ``live`` are touched; with ``delete_aged`` those neither live
        nor touched within the time to live go. ``incoming`` has one row per composite key:
        new ones are added, known ones touched.
        """
        if not LOAD_NAME.fullmatch(load):
            raise ValueError(f"{load!r} is not a name for a load")
        before = self.manifest()
        if before and before.load == load:
            return before
        held = dict(before.versions) if before else {}
        after = Manifest(before.number + 1 if before else 0, load, before.buckets if before else self._buckets, held)
        if incoming is None:
            incoming = self.spark.createDataFrame([], CONTENT_TYPE.replace("version string", "stablekey string, posted_at timestamp"))
        live = live_keys(live) if live is not None else incoming.select("composite_key").limit(0)

        touched = self._touched(before, after.buckets, incoming, live, now, delete_aged)
        old = self.seen(before, touched) if before else self.spark.createDataFrame([], SEEN_TYPE)
        kept = self._kept(old, live, now, delete_aged)
        fresh = incoming.join(kept.select("composite_key"), "composite_key", "left_anti")
        fresh.select("composite_key", *CONTENT).write.mode("overwrite").parquet(
            f"{self.root}/content/version={after.version}")

        rows = self._next(kept, incoming, now, after).withColumnRenamed("version", "content_version")
        path = f"{self.root}/seen/version={after.version}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        written = {int(b) for b in re.findall(r"/bucket=(\d+)/", "\n".join(files_under(self.spark, path)))}
        for bucket in touched:
            held.pop(bucket, None)
        held.update(dict.fromkeys(written, after.version))
        self.spark.createDataFrame([(after.text(),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{self.root}/manifests/{after.version}")
        return after

    def _touched(self, before: Manifest | None, buckets: int, incoming: DataFrame, live: DataFrame, now: Column,
                 delete_aged: bool) -> list[int]:
        """Buckets whose rows a load may change; there are no more of them than buckets."""
        keys = incoming.select("composite_key").unionByName(live)
        numbers = keys.select(bucket_of(buckets).alias("bucket"))
        if delete_aged and before:
            numbers = numbers.unionByName(self.seen(before).filter(aged(now)).select("bucket"))
        return sorted(row["bucket"] for row in numbers.distinct().collect())

    def _kept(self, old: DataFrame, live: DataFrame, now: Column, delete_aged: bool) -> DataFrame:
        marked = old.join(live.withColumn("live", F.lit(True)), "composite_key", "left")
        if delete_aged:
            marked = marked.filter(F.col("live").isNotNull() | ~aged(now))
        seen = F.when(F.col("live"), now).otherwise(F.col("last_seen"))
        return marked.withColumn("last_seen", seen).drop("live")

    def _next(self, kept: DataFrame, incoming: DataFrame, now: Column, after: Manifest) -> DataFrame:
        arrived = incoming.select(
            "composite_key", F.col("stablekey").alias("new_stablekey"), F.col("posted_at").alias("new_posted_at"),
            F.lit(True).alias("arrived"),
        )
        moved = F.when(F.col("arrived"), F.greatest(now, F.col("last_seen"))).otherwise(F.col("last_seen"))
        return kept.join(arrived, "composite_key", "full_outer").select(
            "composite_key", F.coalesce("stablekey", "new_stablekey").alias("stablekey"),
            F.coalesce("posted_at", "new_posted_at").alias("posted_at"),
            F.coalesce(F.col("first_seen"), now).alias("first_seen"), moved.alias("last_seen"),
            F.coalesce(F.col("version"), F.lit(after.version)).alias("version"),
            bucket_of(after.buckets).alias("bucket"),
        )


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("composite_key"), F.lit(buckets)).cast("int")


def aged(now: Column) -> Column:
    """A ledger does not track applications, so only the time counts."""
    return F.col("last_seen") < now - F.expr(f"INTERVAL {TTL_HOURS} HOURS")


def merge_into(table: str, incoming: DataFrame, now: Column) -> None:
    """The same load into a catalog table that can change rows itself."""
    merged = incoming.select(
        "composite_key", *WRITE_ONCE, now.alias("first_seen"), now.alias("last_seen")).alias("incoming")
    same = F.col(f"{table}.composite_key") == F.col("incoming.composite_key")
    merged.mergeInto(table, same).whenMatched().update({"last_seen": F.col("incoming.last_seen")}).whenNotMatched().insertAll().merge()
