"""Whole runs with the offline scorer."""

import json
import sys
import time
import uuid
from collections import Counter
from dataclasses import replace
from datetime import datetime, timezone

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftpanel.config import BandTarget, ModelConfig, RunConfig
from driftpanel.functions.keys import with_identity
from driftpanel.operators.jobs_table import JobsTable
from driftpanel.operators.scoring import candidates_route, from_batches, grade, screen
from driftpanel.operators.waves import STARTS, Landing
from driftpanel.plans import panels
from driftpanel.plans import runs
from driftpanel.plans.runs import CallsFailed, EventsLost, grade_run, run_totals
from driftpanel.queries.standin import offline_scorer
from driftpanel.sources.boards import Boards
from driftpanel.sources.run_settings import load_run
from driftpanel.sources.settings import BUILT_IN_MODELS
from driftpanel.streaming.landing import stream_landing, upsert_stream

# Workers cannot import this file; the scorers below travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NOW = datetime(2026, 7, 29, 13, 0, tzinfo=timezone.utc)
MODELS = tuple(ModelConfig(n, n + "-d", n == "g1", 1000, 60, "offline", "x") for n in ("screener", "g1", "g2"))
CONFIG = RunConfig(
    models=(*MODELS, ModelConfig("no-quota", protocol="offline", base_url="x")), screening_model="screener",
    instructions="be fair", contributor_id="me", include=["dev"], batch_size_override=4, panel_size=12,
    targets=(BandTarget("reject", 4), BandTarget("viable", 4, 2)),
)
OFFLINE = {"offline": offline_scorer}


@pytest.fixture(scope="module")
def postings(spark):
    rows = spark.range(60).select(
        F.concat(F.lit("dev "), F.col("id").cast("string")).alias("title"),
        F.concat(F.lit("co"), (F.col("id") % 7).cast("string")).alias("company"),
        F.lit("Oslo").alias("location"), F.lit("text é").alias("description"),
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.lit("ashby").alias("source"),
        (F.col("id") * 1000).alias("posted_at"), (F.col("id") % 10 != 0).alias("is_remote"),
    )
    return with_identity(rows)


def test_two_runs_share_a_panel(spark, postings, tmp_path):
    calls = []

    def collected():
        calls.append(1)
        return postings

    root = str(tmp_path)
    grade_run(spark, CONFIG, collected, OFFLINE, NOW, root, "r1")
    second = grade_run(spark, CONFIG, collected, OFFLINE, NOW.replace(day=30), root, "r2")
    assert len(calls) == 1  # a stored panel makes collecting pointless
    assert second["events"].count() == 2 * 2 * 12
    assert second["jobs"].count() == 12
    rows = second["calls"].collect()
    assert len(rows) == 2 * 2 * 3 and {r.model for r in rows} == {"g1", "g2"}
    assert {(r.contributor_id, r.resume_id, r.config_id, r.instructions_version, r.run_kind) for r in rows} == {
        ("me", CONFIG.instructions_version, CONFIG.config_id, CONFIG.instructions_version, "main")}
    assert {(r.batch_size, r.temperature_sent, r.cached_read) for r in rows} == {(4, 1.0, None)}
    assert {r.outcome for r in second["outcomes"].collect()} == {"ok"}
    assert {(r.panel_size, r.batch_size, r.model_count) for r in second["runs"].collect()} == {(12, 4, 3)}
    job = second["jobs"].first()
    assert job.first_seen.day == 29 and job.last_seen.day == 30
    assert json.loads(job.payload)["key"] and job.payload_chars == len(job.payload.encode())
    assert second["events"].filter("reasoning IS NULL OR raw IS NULL").count() == 0


def test_run_without_a_panel(spark, postings, tmp_path):
    config = replace(CONFIG, panel_enabled=False, models=MODELS[:2])
    out = grade_run(spark, config, lambda: postings, OFFLINE, NOW, str(tmp_path), "r1")
    assert out["events"].count() == 54 and out["runs"].first().panel_size == -1
    # Two days on only a third of the postings is live: those are touched, the rest age out.
    later = replace(config, rescore_every_run=False, delete_aged=True)
    fewer = postings.filter(F.col("posted_at") < 20000)
    fresh = fewer.withColumn("posted_at", F.col("posted_at") + 1)
    current = fewer.unionByName(with_identity(fresh.drop("key", "stablekey", "composite_key")))
    again = grade_run(spark, later, lambda: current, OFFLINE, NOW.replace(day=31, hour=14), str(tmp_path), "r2")
    assert again["events"].filter("run_id = 'r2'").count() == 18
    rows = again["jobs"].collect()
    assert len(rows) == 36 and {r.last_seen.day for r in rows} == {31}
    assert sorted(r.first_seen.day for r in rows) == [29] * 18 + [31] * 18


def test_refused_run(spark, postings, tmp_path):
    with pytest.raises(ValueError):
        grade_run(spark, replace(CONFIG, run_mode="floor"), lambda: postings, OFFLINE, NOW, str(tmp_path), "r")


def test_panels(spark, postings, tmp_path):
    path = str(tmp_path / "panels")
    assert panels.load_panel(spark, CONFIG, path) is None
    with pytest.raises(ValueError):
        panels.load_panel(spark, replace(CONFIG, active_panel_id="panel-1-x"), path)
    panels.build_panel(postings, replace(CONFIG, panel_seed=1), OFFLINE, NOW, path)
    panels.build_panel(postings, replace(CONFIG, panel_seed=2), OFFLINE, NOW.replace(hour=14), path)
    stored = panels.read_panels(spark, path)
    ids = sorted(r.panel_id for r in stored.select("panel_id").distinct().collect())
    assert ids == ["panel-1-20260729T130000Z", "panel-2-20260729T140000Z"]
    newest = panels.load_panel(spark, CONFIG, path)
    assert {r.panel_id for r in newest.collect()} == {ids[1]}
    pinned = panels.load_panel(spark, replace(CONFIG, active_panel_id=ids[0]), path)
    assert {r.panel_id for r in pinned.collect()} == {ids[0]} and pinned.count() == 12
    with pytest.raises(ValueError):
        panels.load_panel(spark, replace(CONFIG, active_panel_id="panel-9-x"), path)
    assert panels.load_panel(spark, replace(CONFIG, rebuild_panel=True), path) is None
    columns = list(panels.POSTING_COLUMNS)
    frozen = {tuple(r) for r in newest.select(*columns).collect()}
    assert frozen <= {tuple(r) for r in postings.select(*columns).collect()}


def answer(frame, reply):
    """Answers each request through ``reply(model, batch_index, keys)``."""
    out = []
    for row in frame.itertuples():
        keys = [job["key"] for job in json.loads(json.loads(row.request)["messages"][1]["content"].split("\n", 1)[1])]
        out.append(reply(row.model, row.batch_index, keys))
    return pd.DataFrame(out, columns=["response", "status", "error_kind"])


def body(results):
    return json.dumps({"choices": [{"message": {"content": json.dumps({"results": results})}}]})


def test_pandas_scorer_and_stop_after_failure(spark, postings):
    def reply(model, batch, keys):
        if model == "g1" and batch == 2:
            return None, 503, None
        if model == "g2" and batch == 1:
            return body([{"key": keys[0], "score": 1}, {"key": "?", "score": 9, "reasoning": "lost"}]), None, None
        return body([{"key": k, "score": 50, "reasoning": "r"} for k in keys]), None, None

    scorer = from_batches(lambda frame: answer(frame, reply))
    outcomes, events = grade(postings.limit(20), MODELS[1:], {"offline": scorer}, "i", 0.0, 4)
    tried = {(r.model, r.batch_index): (r.outcome, r.error_class, r.scores_parsed) for r in outcomes.filter("attempted").collect()}
    assert sorted((r.model, r.batch_index) for r in outcomes.filter("not attempted").collect()) == [("g1", 3), ("g1", 4)]
    assert sorted(b for m, b in tried if m == "g1") == [0, 1, 2]
    assert tried["g1", 2] == ("failed", "http_5xx", 0)
    assert tried["g2", 1] == ("partial", "", 2) and sorted(b for m, b in tried if m == "g2") == [0, 1, 2, 3, 4]
    rows = events.collect()
    assert sum(r.model == "g1" for r in rows) == 8
    odd = sorted((r.emitted_score, r.reasoning) for r in rows if r.model == "g2" and r.batch_index == 1)
    assert odd == [(-2.0, "lost"), (1.0, "")]


def test_screening_fails_as_a_whole(spark, postings):
    scorer = from_batches(lambda frame: answer(
        frame, lambda m, b, keys: (None, None, "timeout") if b == 3 else (body([]), None, None)))
    with pytest.raises(PySparkException, match="screening batch failed: 3"):
        screen(postings, MODELS[0], {"offline": scorer}, "i", 0.0).collect()
    with pytest.raises(ValueError):
        screen(postings, ModelConfig("x"), OFFLINE, "i", 0.0)


def test_landing_stream(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "jobs")
    source.mkdir()

    def land(name, *texts):
        payload = json.dumps([{"text": t, "createdAt": 1000} for t in texts])
        (source / name).write_text(json.dumps({"provider": "lever", "company": "A", "payload": payload}))

    def drain():
        query = upsert_stream(stream_landing(spark, str(source)), root, str(tmp_path / "checkpoint"))
        query.awaitTermination()

    land("1.json", "dev", "ops")
    drain()
    land("2.json", "ops", "qa")
    drain()
    table = JobsTable(spark, root)
    assert table.manifest().load == "batch-1" and table.manifest().number == 1
    assert sorted(r.title for r in table.read().collect()) == ["dev", "ops", "qa"]


def test_candidates_route_and_failed_calls(spark, postings, tmp_path):
    def reply(request):
        parts = json.loads(request)["contents"][0]["parts"]
        keys = [job["key"] for job in json.loads(parts[1]["text"].split("\n", 1)[1])]
        return json.dumps({"candidates": [{"content": {"parts": [{"text": json.dumps(
            [{"key": k, "score": 70, "reasoning": "c"} for k in keys])}]}}], "usageMetadata": {"totalTokenCount": 9}})

    def candidates(frame):
        return pd.DataFrame({"response": [reply(r) for r in frame.request], "status": None, "error_kind": None})

    def failing(frame):
        return pd.DataFrame({"response": None, "status": [500] * len(frame), "error_kind": None})

    models = (MODELS[0], replace(MODELS[1], protocol="candidates"), replace(MODELS[2], tpm=0))
    config = replace(CONFIG, panel_enabled=False, models=models)
    registry = {**OFFLINE, "candidates": candidates_route(from_batches(candidates))}
    for _ in range(2):  # a repeated attempt leaves the same tables
        out = grade_run(spark, config, lambda: postings, registry, NOW, str(tmp_path), "r1")
        assert {(r.emitted_score, r.reasoning) for r in out["events"].collect()} == {(70.0, "c")}
        assert [(r.model, r.expected, r.actual, r.failed_calls) for r in out["totals"].collect()] == [("g1", 54, 54, 0)]
        assert [(r.model, r.reason) for r in out["refused"].collect()] == [("g2", "missing tpm/rpm")]
        sheet = spark.read.option("header", "true").csv(f"{tmp_path}/export")
        assert sheet.count() == out["jobs"].select("stablekey").distinct().count()
    registry["candidates"] = candidates_route(from_batches(failing))
    with pytest.raises(CallsFailed, match="of 14 calls failed|of 1 calls failed"):
        grade_run(spark, config, lambda: postings, registry, NOW, str(tmp_path), "r2", stop_on_failed_calls=True)
    assert spark.read.parquet(f"{tmp_path}/batch_outcomes").filter("run_id = 'r2' and outcome = 'failed'").count() > 0


def counting(tmp_path, reply):
    """A scorer that notes every call it is asked for, in a file of its own."""
    noted = tmp_path / "noted"
    noted.mkdir()

    def score(frame):
        for row in frame.itertuples():
            (noted / f"{row.model}-{row.batch_index}-{uuid.uuid4().hex}").touch()
        return answer(frame, reply)

    def calls():
        return sorted((m, int(b)) for m, b, _ in (f.name.rsplit("-", 2) for f in noted.iterdir()))

    return from_batches(score), calls


def whole(model, batch, keys):
    return body([{"key": k, "score": 50, "reasoning": "r"} for k in keys]), None, None


def test_a_failed_model_is_not_asked_on(spark, postings, tmp_path):
    def reply(model, batch, keys):
        return (None, 503, None) if model == "g1" and batch == 6 else whole(model, batch, keys)

    scorer, calls = counting(tmp_path, reply)
    outcomes, events = grade(postings, MODELS[1:], {"offline": scorer}, "i", 0.0, 1)
    events.count()
    outcomes.count()
    assert STARTS[:4] == (0, 8, 72, 584)
    # The wave of batch 6 ends with batch 7; the other model is asked everything, nobody anything twice.
    assert calls() == sorted([("g1", b) for b in range(8)] + [("g2", b) for b in range(60)])
    rows = {(r.model, r.batch_index): r for r in outcomes.collect()}
    assert len(rows) == 120
    assert all(r.attempted == (m == "g2" or b <= 6) and r.asked == (m == "g2" or b < 8) for (m, b), r in rows.items())
    assert rows["g1", 30].outcome is None and rows["g1", 6].outcome == "failed"
    assert {r.model: r["count"] for r in events.groupBy("model").count().collect()} == {"g1": 6, "g2": 60}


def test_a_lost_job_asks_nothing_twice(spark, postings, tmp_path):
    broken = tmp_path / "broken"
    broken.touch()

    def reply(model, batch, keys):
        if batch == 13 and broken.exists():
            time.sleep(3)  # others end before
            raise RuntimeError("lost")
        return whole(model, batch, keys)

    scorer, calls = counting(tmp_path, reply)
    landing = Landing(str(tmp_path / "answers"), "r1")
    ask = lambda: grade(postings, MODELS[1:2], {"offline": scorer}, "i", 0.0, 4, landing=landing)
    with pytest.raises(PySparkException):
        ask()
    asked = calls()
    assert ("g1", 13) in asked and len(asked) > 5
    broken.unlink()
    _, events = ask()
    assert events.count() == 60
    again = Counter(calls())
    # Only calls whose task was lost are repeated: the one that broke and those that shared its task.
    assert set(again) == {("g1", b) for b in range(15)}
    repeated = [call for call, n in again.items() if n > 1]
    assert ("g1", 13) in repeated and len(repeated) <= 8
    _, events = ask()
    assert events.count() == 60 and Counter(calls()) == again  # a third attempt asks nothing


def test_answers_stay(spark, postings, tmp_path):
    config = replace(CONFIG, panel_enabled=False, models=MODELS[:2])
    out = grade_run(spark, config, lambda: postings, OFFLINE, NOW, str(tmp_path), "r1")
    answers = out["answers"].collect()
    assert len(answers) == 14 and {a.run_id for a in answers} == {"r1"} and {a.wave for a in answers} == {0, 1}
    assert json.loads(answers[0].response)["choices"] and answers[0].asked_at


def test_nobody_to_ask(spark, postings, tmp_path):
    """The reasons are recorded although the run can't go on."""
    config = replace(CONFIG, panel_enabled=False, models=(replace(MODELS[0], rpm=0), replace(MODELS[1], base_url="")), screening_model="")
    with pytest.raises(ValueError):
        grade_run(spark, config, lambda: postings, OFFLINE, NOW, str(tmp_path), "r1")
    rows = spark.read.parquet(f"{tmp_path}/refused_models").collect()
    assert sorted((r.model, r.reason) for r in rows) == [("g1", "missing base url"), ("screener", "missing tpm/rpm")]


def test_totals_count_events(spark):
    """An answer that serves two postings gives two events; an answer that serves none gives none."""
    outcomes = spark.createDataFrame([("m", True, "ok", 6), ("n", True, "failed", 0)], "model string, attempted boolean, outcome string, scores_parsed int")
    graded = spark.createDataFrame([("m",)] * 5, "model string")
    stored = spark.createDataFrame([("m",)] * 4, "model string")
    rows = {r.model: tuple(r)[1:] for r in run_totals(outcomes, graded, stored).collect()}
    assert rows == {"m": (5, 4, 0, 1), "n": (0, 0, 1, 1)}


def test_lost_events_are_an_error(spark, postings, tmp_path, monkeypatch):
    write = runs.append_run
    monkeypatch.setattr(runs, "append_run", lambda rows, path, run: write(
        rows.limit(3) if path.endswith("scoring_events") else rows, path, run))
    config = replace(CONFIG, panel_enabled=False, models=MODELS[:2])
    with pytest.raises(EventsLost, match="3 of 54"):
        grade_run(spark, config, lambda: postings, OFFLINE, NOW, str(tmp_path), "r1")


def test_funnel_of_a_run(spark, tmp_path):
    def lever(*texts):
        return json.dumps([{"text": t, "workplaceType": "remote", "createdAt": 1000 * i} for i, t in enumerate(texts)])

    landing = spark.createDataFrame(
        [("lever", "A", lever("dev", "ops", "dev two")), ("lever", "B", "{"), ("lever", "other", lever("dev"))],
        "provider string, company string, payload string")
    sources = spark.createDataFrame([("lever", "A"), ("lever", "B"), ("workday", "C")], "provider string, company string")
    config = replace(CONFIG, panel_enabled=False, models=MODELS[:2])
    out = grade_run(spark, config, Boards(landing, sources), OFFLINE, NOW, str(tmp_path), "r1")
    assert {r.step: r["rows"] for r in out["funnel"].collect()} == {
        "payloads": 2, "quarantined": 1, "fetched": 3, "unknown_provider": 1, "collected": 3, "matched": 2}
    assert out["events"].count() == 2 and out["jobs"].count() == 2


def test_funnel_of_a_panel_build(spark, postings, tmp_path):
    def some(frame):
        return answer(frame, lambda m, b, keys: whole(m, b, keys[:1]))

    out = grade_run(spark, CONFIG, lambda: postings, {"offline": from_batches(some)}, NOW, str(tmp_path), "r1")
    rows = {r.step: r["rows"] for r in out["funnel"].collect()}
    assert rows == {"collected": 60, "matched": 54, "panel": 12, "unscored": 27}


def test_a_build_gives_its_own_panel_and_damage_is_an_error(spark, postings, tmp_path):
    path = str(tmp_path / "panels")
    panels.build_panel(postings, replace(CONFIG, panel_seed=1), OFFLINE, NOW, path)
    earlier = panels.load_or_build(
        spark, replace(CONFIG, panel_seed=2, rebuild_panel=True), lambda: postings, OFFLINE, NOW.replace(hour=2), path)
    assert {r.panel_id for r in earlier.collect()} == {"panel-2-20260729T020000Z"}
    broken = str(tmp_path / "broken")
    spark.range(1).write.parquet(broken)
    with pytest.raises(PySparkException):
        panels.load_panel(spark, CONFIG, broken)


def test_run_from_documents_alone(spark, postings, tmp_path):
    settings = tmp_path / "settings"
    settings.mkdir()
    for name, document in {
        "sources.json": {"greenhouse": ["acme"]}, "filterKeywords.json": {},
        "models.json": [{"name": m.name, "deployment": m.deployment, "tpm": m.tpm, "rpm": m.rpm, "protocol": m.protocol, "baseURL": m.base_url}
                        for m in MODELS[:2]],
        "run.json": {"contributor_id": "me", "panel_enabled": False},
    }.items():
        (settings / name).write_text(json.dumps(document))
    (settings / "instructions.md").write_text("grade")
    out = grade_run(spark, load_run(spark, str(settings)), lambda: postings, OFFLINE, NOW, str(tmp_path / "out"), "r1")
    assert {r.model for r in out["calls"].select("model").distinct().collect()} == {m.name for m in MODELS[:2]}
    # The built-in models were asked for, too, and nobody here speaks their protocols.
    assert {r.model for r in out["refused"].collect()} == {name for name, *_ in BUILT_IN_MODELS}
