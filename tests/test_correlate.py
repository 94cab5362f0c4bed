import random

import pytest

from pyspark.sql import functions as F

from driftpanel.operators.correlate import batch_chunks, correlate, correlate_calls

JOBS = "b int, pos int, key string"
RESULTS = "b int, pos int, job_key string, emitted_score double, ev_score double, raw string"


def run(spark, jobs, results, in_row=256):
    events = correlate(
        spark.createDataFrame(jobs, JOBS), spark.createDataFrame(results, RESULTS), ["b"], [],
        ["emitted_score", "ev_score", "raw"], in_row,
    )
    return {(r.b, r.job_pos): (r.result_pos, r.emitted_score, r.ev_score, r.raw) for r in events.collect()}


def run_calls(spark, jobs, results):
    """The same batches as one row per call."""
    grouped = spark.createDataFrame(jobs, JOBS).groupBy("b").agg(
        F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("jobs")
    )
    answers = spark.createDataFrame(results, RESULTS).groupBy("b").agg(
        F.array_sort(F.collect_list(F.struct("pos", "job_key", "emitted_score", "ev_score", "raw"))).alias("items")
    )
    nothing = F.array().cast("array<struct<pos: int, job_key: string, emitted_score: double, ev_score: double, raw: string>>")
    calls = grouped.join(answers, "b", "left").withColumn("items", F.coalesce("items", nothing))
    events = correlate_calls(calls, ["b"], [], ["raw"])
    return {(r.b, r.job_pos): (r.result_pos, r.emitted_score, r.ev_score, r.raw) for r in events.collect()}


def by_hand(jobs, results):
    """One batch after the other, row by row."""
    out = {}
    for batch in {j[0] for j in jobs}:
        mine = sorted(r for r in results if r[0] == batch)
        free, open_jobs = {r[1] for r in mine}, []
        for _, pos, key in sorted(j for j in jobs if j[0] == batch):
            hit = next((r for r in mine if r[2] == key and key != ""), None)
            if hit is None:
                open_jobs.append(pos)
            else:
                free.discard(hit[1])
                out[batch, pos] = (hit[1], hit[3], hit[4], hit[5])
        rest = [r for r in mine if r[1] in free]
        for pos, r in zip(open_jobs, rest):
            out[batch, pos] = (r[1], -2.0, None, r[5])
    return out


@pytest.mark.parametrize("jobs,results,want", [
    ([(0, 0, "a"), (0, 1, "b")], [(0, 0, "a", 5.0, None, "x")], {(0, 0): (0, 5.0, None, "x")}),
    ([(0, 0, "a"), (0, 1, "b")], [(0, 0, "a", 5.0, None, "x"), (0, 1, "bogus", 99.0, 42.0, "y")],
     {(0, 0): (0, 5.0, None, "x"), (0, 1): (1, -2.0, None, "y")}),
    ([(0, 0, "x")], [(0, 0, "", 50.0, None, "z")], {(0, 0): (0, -2.0, None, "z")}),
    ([(0, 0, "j1"), (0, 1, "j2")], [(0, 0, "bad1", 1.0, None, "p"), (0, 1, "bad2", 1.0, None, "q")],
     {(0, 0): (0, -2.0, None, "p"), (0, 1): (1, -2.0, None, "q")}),
    ([(0, 0, "j1"), (0, 1, "j2")], [(0, 0, "bad", 1.0, None, "p")], {(0, 0): (0, -2.0, None, "p")}),
    ([(0, 0, "a"), (0, 1, "a")], [(0, 0, "a", 1.0, 2.0, "p"), (0, 1, "a", 3.0, None, "q")],
     {(0, 0): (0, 1.0, 2.0, "p"), (0, 1): (0, 1.0, 2.0, "p")}),
    ([(0, 0, "")], [(0, 0, "", 1.0, None, "p")], {(0, 0): (0, -2.0, None, "p")}),
])
def test_cases(spark, jobs, results, want):
    assert run(spark, jobs, results) == want == by_hand(jobs, results)
    assert run_calls(spark, jobs, results) == want


def test_random_batches(spark):
    rng = random.Random(7)
    jobs, results = [], []
    for batch in range(400):
        size = 60 if batch == 0 else rng.randrange(1, 7)
        keys = ["", "a", "b", "c", "d", "zz"]
        jobs += [(batch, i, rng.choice(keys)) for i in range(size)]
        results += [
            (batch, i, rng.choice(keys), float(rng.randrange(100)), rng.choice([None, 1.5]), f"r{i}")
            for i in range(rng.randrange(0, size + 2))
        ]
    wanted = by_hand(jobs, results)
    for in_row in (256, 16, 2):  # no batch, one batch, and most batches go beyond a row
        assert run(spark, jobs, results, in_row) == wanted
    assert run_calls(spark, jobs, results) == by_hand(jobs, results)


def test_one_shuffle_and_bounded_rows(spark):
    """Two scans and one shuffle gather both sides; a large batch is spread over rows."""
    jobs = spark.range(5000).selectExpr("0 as b", "cast(id as int) as pos", "'' as key")
    results = spark.range(5000).selectExpr("0 as b", "cast(id as int) as pos", "'' as job_key", "1.0D as emitted_score", "cast(null as double) as ev_score")
    chunks = batch_chunks(jobs, results, ["b"], [], [], 64)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Range (") == 2
    sizes = chunks.select(F.size("jobs").alias("j"), F.size("items").alias("i")).collect()
    assert len(sizes) == 79 and all(max(r.j, r.i) <= 64 for r in sizes)
    events = correlate(jobs, results, ["b"], [], [], 64)
    assert events.filter("job_pos = result_pos and emitted_score = -2").count() == 5000
    small = correlate(jobs.withColumn("b", F.col("pos")), results.withColumn("b", F.col("pos")), ["b"], [], [], 5000)
    assert "Exchange" not in small._jdf.queryExecution().executedPlan().toString()
