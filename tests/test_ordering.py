"""Sliced positions and look-backs against plain loops, with one very large group."""

import random
import time

import pytest
from pyspark.sql import functions as F

from driftpanel.operators.audit import attempted
from driftpanel.operators.batching import assign_batches
from driftpanel.operators.ordering import (
    position_in_group, position_overall, previous_value, sorted_slices, trailing_sum,
)


COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


@pytest.fixture(params=["false", "true"])
def merging(spark, request):
    """Small slices stay apart, or become one."""
    before = spark.conf.get(COALESCE)
    spark.conf.set(COALESCE, request.param)
    yield request.param == "true"
    spark.conf.set(COALESCE, before)


def _skewed(rng, n, groups=6):
    """A third of the rows in one group."""
    return [0 if rng.random() < 0.34 else rng.randrange(1, groups) for _ in range(n)]


def test_position_in_group(spark):
    rng = random.Random(1)
    groups = _skewed(rng, 600)
    rows = list(zip(groups, rng.sample(range(100000), 600)))
    df = spark.createDataFrame(rows, "g int, o bigint")
    got = {(r.g, r.o): r.k for r in position_in_group(df, ["g"], "o", "k", slice_rows=512).collect()}
    for g in set(groups):
        ordered = sorted(o for h, o in rows if h == g)
        assert [got[g, o] for o in ordered] == list(range(1, len(ordered) + 1))


def test_position_overall(spark):
    rng = random.Random(2)
    rows = [(str(k), i) for i, k in enumerate(_skewed(rng, 500))]
    df = spark.createDataFrame(rows, "s string, i bigint").repartition(7)
    got = {r.i: r.p for r in position_overall(df, ("s", "i"), "p").collect()}
    assert [got[i] for _, i in sorted(rows)] == list(range(500))


def test_position_overall_of_equal_keys_and_of_nothing(spark):
    same = spark.createDataFrame([("x",)] * 300, "s string").repartition(5)
    assert sorted(r.p for r in position_overall(same, ("s",), "p").collect()) == list(range(300))
    assert position_overall(same.limit(0), ("s",), "p").collect() == []


def test_trailing_sum(spark, merging):
    rng = random.Random(3)
    rows = [(g, rng.randrange(0, 4000), rng.randrange(10), i) for i, g in enumerate(_skewed(rng, 500))]
    rows += [(0, -50, 4, 1000), (0, -150, 5, 1001), (1, 0, 7, 1002), (1, 100, 7, 1003), (None, 5, 1, 1004), (None, 9, 2, 1005)]
    rows += [(2, 777, 3, 2000 + k) for k in range(200)]  # many at one moment
    df = spark.createDataFrame(rows, "g int, t bigint, v bigint, i bigint")
    for _ in range(2):
        got = {r.i: r.s for r in trailing_sum(df, ["g"], "t", "v", "s", 100).collect()}
        assert len(got) == len(rows)
        for g, t, _, i in rows:
            assert got[i] == sum(v for h, u, v, _ in rows if h == g and t - 100 < u <= t)
        df = df.filter("g = 0")  # one group over all slices
        rows = [r for r in rows if r[0] == 0]
    assert trailing_sum(df.limit(0), ["g"], "t", "v", "s", 100).isEmpty()


def test_trailing_sum_is_linear(spark):
    """Calls within one span cost no more than the same calls spread over many."""
    def seconds(width):
        df = spark.range(80_000).selectExpr("cast(id % 2 as int) as g", f"pmod(xxhash64(id), {width}) as t", "id % 7 as v")
        start = time.monotonic()
        sums = trailing_sum(df, ["g"], "t", "v", "s", 60_000_000)
        assert sums.agg(F.count("s")).first()[0] == 80_000
        return time.monotonic() - start

    seconds(86_400_000_000)
    assert seconds(60_000_000) < 3 * seconds(86_400_000_000) + 1


def test_previous_value(spark, merging):
    rng = random.Random(4)
    rows = [(g, rng.choice([rng.randrange(0, 5000), rng.randrange(50000, 50300)]), i) for i, g in enumerate(_skewed(rng, 400))]
    df = spark.createDataFrame(rows, "g int, t bigint, i bigint")
    got = {r.i: r.p for r in previous_value(df, ["g"], "t", ["i"], "p").collect()}
    for g in {r[0] for r in rows}:
        ordered = sorted((t, i) for h, t, i in rows if h == g)
        for (before, _), (_, i) in zip([(None, None), *ordered], ordered):
            assert got[i] == before


def test_slices_hold_equally_many_rows(spark, merging):
    """A group with nearly all rows, all within one moment's span, is spread all the same."""
    df = spark.range(40_000).selectExpr("if(id < 39000, 0, 1) as g", "id % 10000 as t")
    sizes = [r["count"] for r in sorted_slices(df, ["g"], ["t"]).groupBy("_part").count().collect()]
    assert sum(sizes) == 40_000 and (merging or len(sizes) == 4 and max(sizes) < 15_000)


def test_attempted(spark):
    rows = [("a", 0, False), ("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 0, False), ("b", 1, False)]
    df = spark.createDataFrame(rows, "model string, batch_index int, failed boolean")
    got = {(r.model, r.batch_index) for r in attempted(df, ["model"]).collect() if r.attempted}
    assert got == {("a", 0), ("a", 1), ("b", 0), ("b", 1)}


def test_batching_works_out_its_postings_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(n):
        seen.add(1)
        return f"k{n:03d}"

    rows = spark.range(200).select(F.udf(told, "string")("id").alias("stablekey"), F.lit(1).alias("posted_at"), F.lit("u").alias("url"))
    placed = assign_batches(rows, 7).collect()
    assert sorted((r["stablekey"], 7 * r["batch_index"] + r["pos"]) for r in placed) == [(f"k{n:03d}", n) for n in range(200)]
    assert seen.value == 200
