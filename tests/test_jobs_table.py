"""The jobs table against a plain dictionary, and what its files show."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import functions as F

from driftpanel.operators.jobs_table import JobsTable, Manifest, merge_into

START = datetime(2026, 7, 1, tzinfo=timezone.utc)
JOB = ("composite_key string, stablekey string, posted_at timestamp, source string, title string, company string, url string, "
       "payload string, description_chars int, payload_chars int")


def job(key, title):
    return (key, "s" + key, START, "src", title, "co", "u" + key, "{}", 1, 2)


def files_of(root, part):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f))
            for d, _, names in os.walk(os.path.join(root, part)) for f in names if f.endswith(".parquet")}


def rows_of(table):
    return {r.composite_key: (r.title, r.first_seen, r.last_seen) for r in table.read().collect()}


def test_random_loads(spark, tmp_path):
    rng = random.Random(1)
    table, model = JobsTable(spark, str(tmp_path), 8), {}
    for n in range(5):
        now = START + timedelta(hours=30 * n)
        keys = rng.sample(range(40), 12)
        live, arrived, delete = keys[:8], keys[4:], n % 2 == 1
        plain = now.replace(tzinfo=None)
        for key in live:
            if key in model:
                model[key] = (*model[key][:2], plain)
        if delete:
            limit = plain - timedelta(hours=48)
            model = {k: v for k, v in model.items() if k in live or v[2] >= limit}
        for key in arrived:
            title, first, _ = model.get(key, (f"t{n}", plain, None))
            model[key] = (title, first, plain)
        incoming = spark.createDataFrame([job(str(k), f"t{n}") for k in arrived], JOB)
        current = spark.createDataFrame([(str(k),) for k in live + live], "composite_key string")
        for _ in range(2):  # repeating the latest load changes nothing
            table.advance(f"load-{n}", F.lit(now), incoming, current, delete)
        assert rows_of(table) == {str(k): v for k, v in model.items()}
        assert table.seen().count() == len(model)
    assert table.manifest().number == 4


def test_untouched_files_stay(spark, tmp_path):
    root = str(tmp_path)
    table = JobsTable(spark, root, 16)
    table.advance("a", F.lit(START), spark.createDataFrame([job(str(k), "t") for k in range(200)], JOB))
    content, seen, before = files_of(root, "content"), files_of(root, "seen"), table.manifest()
    assert set(before.versions) == set(range(16))
    table.advance("b", F.lit(START + timedelta(days=1)), spark.createDataFrame([job("7", "changed"), job("x", "new")], JOB))
    after = table.manifest()
    moved = {b for b in after.versions if after.versions[b] != before.versions[b]}
    assert 1 <= len(moved) <= 2
    # No file of the first load was written again; only the new posting's content was added.
    assert files_of(root, "content").items() >= content.items() and files_of(root, "seen").items() >= seen.items()
    new = set(files_of(root, "seen")) - set(seen)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in new} == moved
    added = [f for f in files_of(root, "content") if f not in content]
    assert [r.composite_key for r in spark.read.parquet(*added).collect()] == ["x"]
    assert rows_of(table)["7"][0] == "t" and len(rows_of(table)) == 201
    # Only the touched buckets are read for a load that deletes nothing.
    assert {b for f in table.seen(after, sorted(moved)).inputFiles() for b in moved if f"bucket={b}/" in f} == moved


def test_a_load_counts_once_its_manifest_is_there(spark, tmp_path):
    root = str(tmp_path)
    table = JobsTable(spark, root, 4)
    assert table.manifest() is None and table.read().isEmpty() and table.seen().isEmpty()
    table.advance("a", F.lit(START), spark.createDataFrame([job("1", "t")], JOB))
    # A load that stopped before its manifest: its files lie there and are not read.
    stopped = JobsTable(spark, root)
    real, Manifest.text = Manifest.text, lambda self: 1 / 0
    try:
        with pytest.raises(ZeroDivisionError):
            stopped.advance("b", F.lit(START), spark.createDataFrame([job("2", "lost")], JOB))
    finally:
        Manifest.text = real
    assert set(rows_of(table)) == {"1"}
    table.advance("b", F.lit(START), spark.createDataFrame([job("3", "t")], JOB))
    assert set(rows_of(table)) == {"1", "3"}


def test_two_writers_are_noticed(spark, tmp_path):
    root = str(tmp_path)
    table = JobsTable(spark, root, 4)
    table.advance("a", F.lit(START), spark.createDataFrame([job("1", "t")], JOB))
    other = Manifest(0, "b", 4, {})
    spark.createDataFrame([(other.text(),)], "value string").coalesce(1).write.text(f"{root}/manifests/{other.version}")
    with pytest.raises(RuntimeError, match="two loads"):
        table.manifest()


def test_names_and_sizes(spark, tmp_path):
    with pytest.raises(ValueError):
        JobsTable(spark, str(tmp_path), 0)
    with pytest.raises(ValueError):
        JobsTable(spark, str(tmp_path)).advance("a/b", F.lit(START))
    table = JobsTable(spark, str(tmp_path), 4)
    table.advance("empty", F.lit(START))
    assert table.read().isEmpty() and json.loads(table.manifest().text())["versions"] == {}


def test_loads_of_one_bucket_delete_it(spark, tmp_path):
    table = JobsTable(spark, str(tmp_path), 1)
    table.advance("a", F.lit(START), spark.createDataFrame([job("1", "t")], JOB))
    table.advance("b", F.lit(START + timedelta(days=9)), delete_aged=True)
    assert table.read().isEmpty() and table.manifest().versions == {}
    table.advance("c", F.lit(START + timedelta(days=10)), spark.createDataFrame([job("1", "again")], JOB))
    assert rows_of(table)["1"][0] == "again"


def test_merge_needs_a_catalog_that_can(spark):
    """The session catalog's parquet tables can't change rows; the call is refused, not half done."""
    spark.sql(f"create table if not exists jobs_merge_test ({JOB}, first_seen timestamp, last_seen timestamp) using parquet")
    try:
        with pytest.raises(UnsupportedOperationException, match="MERGE"):
            merge_into("jobs_merge_test", spark.createDataFrame([job("1", "t")], JOB), F.lit(START))
    finally:
        spark.sql("drop table jobs_merge_test")
