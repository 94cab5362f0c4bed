from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from driftpanel.operators import latest, ledger, liveness
from driftpanel.operators.jobs_table import JobsTable
from driftpanel.plans.runs import write_sheet

NOW = datetime(2026, 7, 29, 13, 0, tzinfo=timezone.utc)


def moment(hours_ago):
    return NOW - timedelta(hours=hours_ago)


@pytest.fixture
def seen(spark):
    return spark.createDataFrame([
        ("live", "live", 1, moment(100), False), ("old", "old", 1, moment(49), False), ("edge", "edge", 1, moment(48), False),
        ("applied", "applied", 1, moment(100), True), ("young", "young", 1, moment(1), False),
    ], "composite_key string, stablekey string, posted_at bigint, last_seen timestamp, has_applied boolean")


@pytest.fixture
def current(spark):
    return spark.createDataFrame([("live",), ("live",), ("new",), ("new",)], "composite_key string")


def test_liveness_split(spark, seen, current):
    split = liveness.liveness_split(seen, current, F.lit(NOW))
    assert {r.composite_key: r.action for r in split.collect()} == {
        "live": "bump", "old": "age", "edge": "keep", "applied": "keep", "young": "keep",
    }


@pytest.mark.parametrize("delete,left", [(True, 4), (False, 5)])
def test_maintain(spark, seen, current, delete, left):
    rows = {r.composite_key: r.last_seen for r in liveness.maintain(seen, current, F.lit(NOW), delete).collect()}
    assert len(rows) == left
    assert rows["live"] == NOW.replace(tzinfo=None) and rows["young"] == moment(1).replace(tzinfo=None)


def test_fresh_keeps_repeats(spark, seen, current):
    assert [r[0] for r in liveness.fresh_postings(current, seen).collect()] == ["new", "new"]


def test_candidates_by_policy(spark, seen):
    postings = spark.createDataFrame(
        [("live", "dev", "x", True), ("new", "dev", "x", True), ("new2", "dev", "x", False)],
        "composite_key string, title string, location string, is_remote boolean",
    )
    assert liveness.candidates(postings, seen, True, ["dev"], []).count() == 2
    assert liveness.candidates(postings, seen, False, ["dev"], []).count() == 1


JOB = ("stablekey string, posted_at timestamp, source string, title string, company string, url string, payload string, "
       "description_chars int, payload_chars int, composite_key string")


def job(key, title):
    return ("s", moment(500), "src", title, "c", "u" + title, "{}", 1, 2, key)


def test_upsert_is_write_once(spark, tmp_path):
    repeated = spark.createDataFrame([job("k1", "c"), job("k1", "b"), job("k2", "z")], JOB)
    scored = liveness.first_per_posting(repeated, liveness.WRITE_ONCE)
    table = JobsTable(spark, str(tmp_path))
    table.advance("1", F.lit(moment(24)), scored)
    table.advance("2", F.lit(NOW), spark.createDataFrame([job("k1", "changed"), job("k3", "n")], JOB))
    rows = {r.composite_key: r for r in table.read().collect()}
    assert sorted(rows) == ["k1", "k2", "k3"]
    assert rows["k1"].title == "b"
    assert (rows["k1"].first_seen, rows["k1"].last_seen) == (moment(24).replace(tzinfo=None), NOW.replace(tzinfo=None))
    assert rows["k2"].last_seen == moment(24).replace(tzinfo=None)


EVENTS = ("model string, minute bigint, pos int, deployment string, composite_key string, emitted_score double, ev_score double, "
          "reasoning string, raw string, logprobs string")


@pytest.fixture
def events(spark):
    return spark.createDataFrame([
        ("m", 1, 1, "second", "k2", 5.0, None, "", "{}", ""), ("m", 1, 0, "first", "k1", 7.0, 7.5, "why", "{}", "{}"),
        ("m", 2, 0, "d", "k1", 1.0, None, "r", "{}", ""),
    ], EVENTS)


def test_calls_from_events(spark, events):
    calls = ledger.rebuild_calls(events, ("model", "minute"), "pos", ("deployment",)).collect()
    assert {(c.minute, c.batch_size, c.deployment, c.run_kind) for c in calls} == {(1, 2, "first", "main"), (2, 1, "d", "main")}


def test_event_rows_keep_null_apart_from_empty(spark, events):
    rows = {r.emitted_score: r for r in ledger.event_rows(events, ("model", "minute"), "pos").collect()}
    assert rows[5.0].reasoning is None and rows[5.0].logprobs is None and rows[5.0].ev_score is None
    assert rows[7.0].reasoning == "why" and rows[7.0].ev_score == 7.5
    assert len({r.event_id for r in rows.values()}) == 3 and rows[5.0].call_id == rows[7.0].call_id


def test_a_repeated_run_replaces_itself_only(spark, events, tmp_path):
    path = str(tmp_path / "events")
    for run in ("r1", "r2", "r2"):
        ledger.append_run(events, path, run)
    assert {r.run_id: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {"r1": 3, "r2": 3}


def test_export_takes_the_latest_across_composite_keys(spark, tmp_path):
    jobs = spark.createDataFrame(
        [("s1#1", "s1", 1, "t", "c", "u1", '{"location":"Oslo"}'), ("s1#2", "s1", 2, "t", "c", "u2", "{}"),
         ("s2#1", "s2", 1735689600, "t", "c", "u3", "{}"), ("s3#1", "s3", 1, "t", "c", "u4", "{}")],
        "composite_key string, stablekey string, posted_at bigint, title string, company string, url string, payload string",
    )
    events = spark.createDataFrame(
        [(1, "a", "s1#1", 10.0, None, None), (2, "b", "s1#2", 20.0, 21.5, "x"), (3, "a", "s2#1", -2.0, None, 'say "hi", then\ngo'),
         (4, "gone", "s1#1", 99.0, None, "z")],
        "event_id bigint, call_id string, composite_key string, emitted_score double, ev_score double, reasoning string",
    )
    calls = spark.createDataFrame([("a", moment(1)), ("b", moment(2))], "call_id string, scored_at timestamp")
    rows = latest.export_rows(jobs, events, calls)
    got = {r.stablekey: r for r in rows.collect()}
    assert sorted(got) == ["s1", "s2"]
    assert (got["s1"].score, got["s1"].url, got["s1"].location, got["s1"].reasoning) == (10.0, "u1", "Oslo", "")
    assert (got["s2"].score, got["s2"].posted) == (-2.0, "2025-01-01")
    assert rows.columns == ["stablekey", "posted_at", "posted", "title", "company", "score", "has_applied", "reasoning", "location", "url"]
    path = str(tmp_path / "sheet")
    for _ in range(2):
        write_sheet(rows, path)
    read = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).collect()
    assert [r.stablekey for r in read] == ["s1", "s2"] and read[1].reasoning == 'say "hi", then\ngo'


def test_overwrite_resets_has_applied(spark):
    kinds = "stablekey string, posted_at bigint, score double, title string, company string, location string, url string, source string, reasoning string"
    stored = spark.createDataFrame(
        [("a", 1, 1.0, "", "", "", "", "", "", True, moment(9)), ("b", 1, 2.0, "", "", "", "", "", "", True, moment(9))],
        kinds + ", has_applied boolean, last_seen timestamp",
    )
    events = spark.createDataFrame(
        [("a", 1, "t", "", "", "", "", "new", 5.0, 6.0, moment(2), 1), ("a", 1, "t", "", "", "", "", "newer", 7.0, None, moment(1), 2)],
        "stablekey string, posted_at bigint, title string, company string, location string, url string, source string, reasoning string, "
        "emitted_score double, ev_score double, scored_at timestamp, event_id int",
    )
    got = {r.stablekey: r for r in latest.overwrite_latest(stored, events, F.lit(NOW)).collect()}
    assert (got["a"].score, got["a"].reasoning, got["a"].has_applied) == (7.0, "newer", False)
    assert (got["b"].score, got["b"].has_applied) == (2.0, True)
    assert latest.export_items(spark.createDataFrame(list(got.values()))).count() == 2
