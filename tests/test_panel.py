"""The draw against a plain loop over lists, and the rules of bands and pools."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftpanel.config import BandTarget, DEFAULT_BANDS, DEFAULT_TARGETS, ScoreBand
from driftpanel.operators import panel

BANDS = (ScoreBand("low", 0, 40), ScoreBand("mid", 40, 80), ScoreBand("high", 80, 100))


def _hash(*parts):
    return hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()


def loop_draw(pool, bands, targets, size, cap, seed):
    """Takes one posting at a time, company after company."""
    order = [b.name for b in sorted(bands, key=lambda b: -b.min)]
    goal = {t.band: t for t in targets}
    chosen, taken = [], Counter()

    def take(phase, band, n):
        queues = {}
        for b, company, key in pool:
            if b == band and key not in {c[1] for c in chosen}:
                queues.setdefault(company, []).append(key)
        companies = sorted(queues, key=lambda c: (_hash(seed, phase, band, c), c))
        for company in companies:
            queues[company].sort(key=lambda k: (_hash(seed, phase, band, k), k))
        got = 0
        while got < n:
            before = got
            for company in companies:
                if got < n and queues[company] and not (0 < cap <= taken[company]):
                    chosen.append((band, queues[company].pop(0), company, phase))
                    taken[company] += 1
                    got += 1
            if got == before:
                break

    for band in order:
        if band in goal:
            take(1, band, goal[band].floor)
    for band in order:
        if band in goal:
            take(2, band, goal[band].target - sum(c[0] == band for c in chosen))
    for band in order:
        take(3, band, size - len(chosen))
    return [(key, band, phase) for band, key, _, phase in chosen[:size]]


def spark_draw(spark, pool, bands, targets, size, cap, seed):
    df = spark.createDataFrame(pool, "score_band string, company string, stablekey string").repartition(3)
    df = df.withColumn("screening_score", F.lit(1.0))
    drawn = panel.draw_panel(df, bands, targets, size, cap, seed)
    return [(r.stablekey, r.score_band, r.phase) for r in drawn.orderBy("seq").collect()]


def _pool(rng, n, companies=5):
    """A third of the postings belong to one company."""
    return [
        (rng.choice(["low", "mid", "high", "high"]), "c0" if rng.random() < 0.34 else f"c{rng.randrange(companies)}", f"k{i}")
        for i in range(n)
    ]


@pytest.mark.parametrize("trial", range(8))
def test_draw_equals_the_loop(spark, trial):
    rng = random.Random(trial)
    pool = _pool(rng, rng.choice([6, 25, 120, 400]), rng.choice([1, 4, 30]))
    targets = tuple(
        BandTarget(b.name, rng.randrange(6), rng.randrange(4)) for b in BANDS if rng.random() < 0.85
    )
    size, cap = rng.randrange(3, 18), rng.choice([0, 0, 1, 2])
    want = loop_draw(pool, BANDS, targets, size, cap, trial)
    assert spark_draw(spark, pool, BANDS, targets, size, cap, trial) == want


def test_same_seed_same_panel_other_seed_other_panel(spark):
    pool = _pool(random.Random(0), 200)
    targets = (BandTarget("low", 4), BandTarget("high", 6, 6))
    first = spark_draw(spark, pool, BANDS, targets, 10, 0, 42)
    assert spark_draw(spark, list(reversed(pool)), BANDS, targets, 10, 0, 42) == first
    assert spark_draw(spark, pool, BANDS, targets, 10, 0, 43) != first


def test_floor_holds_and_backfill_tops_up(spark):
    pool = [("low", "A", "l1"), ("low", "B", "l2")] + [("high", "ABCD"[i % 4], f"h{i}") for i in range(20)]
    drawn = spark_draw(spark, pool, BANDS, (BandTarget("low", 8), BandTarget("high", 6, 6)), 14, 0, 1)
    bands = Counter(band for _, band, _ in drawn)
    assert bands == {"low": 2, "high": 12}
    assert [p for _, _, p in drawn][:6] == [1] * 6


def test_company_cap(spark):
    pool = [("high", "A", f"k{i}") for i in range(20)]
    assert len(spark_draw(spark, pool, BANDS, (BandTarget("high", 10),), 10, 2, 1)) == 2


def test_round_robin_gives_everyone_a_turn(spark):
    pool = [("high", "A", "A1"), ("high", "A", "A2"), ("high", "B", "B1")]
    for seed in range(3):
        drawn = spark_draw(spark, pool, BANDS, (BandTarget("high", 2),), 2, 0, seed)
        assert {key[0] for key, _, _ in drawn} == {"A", "B"}


@pytest.mark.parametrize("score,want", [
    (0.0, "low"), (39.9, "low"), (40.0, "mid"), (79.9, "mid"), (80.0, "high"), (100.0, "high"), (150.0, None), (-1.0, None),
])
def test_band_edges(value_of, score, want):
    assert value_of(panel.band_of(F.col("s"), tuple(reversed(BANDS))), s=score) == want


def _postings(spark, rows):
    return spark.createDataFrame(rows, "stablekey string, key string, company string, posted_at bigint, url string")


def _scores(spark, rows):
    return spark.createDataFrame(rows, "key string, screening_score double")


def test_pool_keeps_the_newest_and_leaves_out_the_unscored(spark):
    postings = _postings(spark, [
        ("s1", "k-old", "A", 100, "u1"), ("s1", "k-new", "A", 200, "u2"), ("s2", "k2", "B", 50, "u3"),
    ])
    scores = _scores(spark, [("k-old", 10.0), ("k-new", 90.0)])
    pool = panel.banded_pool(postings, scores, BANDS).collect()
    assert [(r.stablekey, r.key, r.score_band) for r in pool] == [("s1", "k-new", "high")]
    assert [r.key for r in panel.unscored(postings, scores).collect()] == ["k2"]


def test_score_outside_all_bands_fails(spark):
    pool = panel.banded_pool(_postings(spark, [("s", "k", "A", 1, "u")]), _scores(spark, [("k", 150.0)]), BANDS)
    with pytest.raises(PySparkException, match="no score band"):
        pool.collect()


def test_reachable_is_bounded_by_the_panel_not_the_pool(spark):
    pool = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 997).cast("string"))).alias("company"),
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("stablekey"), F.lit("viable").alias("score_band"),
        F.lit(90.0).alias("screening_score"),
    )
    depth = 12
    assert panel.reachable(pool, 1, depth).count() <= 3 * depth * depth
    plan = panel.reachable(pool, 1, depth)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_default_targets_fill_the_default_panel():
    assert sum(t.target for t in DEFAULT_TARGETS) == 30
    assert {t.band for t in DEFAULT_TARGETS} == {b.name for b in DEFAULT_BANDS}


def test_a_large_capped_panel_leaves_the_session_as_it_was(spark):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    pool = [("high", f"c{i}", f"k{i}") for i in range(2500)]
    drawn = spark_draw(spark, pool, BANDS, (BandTarget("high", 1000, 500),), 2000, 1, 3)
    assert len({key for key, _, _ in drawn}) == 2000
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
