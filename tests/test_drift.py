"""Reports that must not lose the worst cases."""

from driftpanel.functions.quota import request_interval
from driftpanel.plans import drift
from pyspark.sql import functions as F


def test_a_model_without_events_is_in_the_loss_report(spark):
    events = spark.createDataFrame([("a", 5, 3.0), ("a", 5, -2.0)], "model string, batch_size int, emitted_score double")
    sent = spark.createDataFrame([("a", 5, 5, 4), ("b", 5, 10, 0)], "model string, batch_size int, jobs_sent int, scores_parsed int")
    rows = {r.model: (r.events, r.sentinels, r.dropped, r.sentinel_rate) for r in drift.loss_rates(events, sent).collect()}
    assert rows == {"a": (2, 1, 1, 0.5), "b": (0, 0, 10, None)}


def test_a_batch_size_without_scores_or_calls_stays(spark):
    ledger = spark.createDataFrame([(1, 50.0), (2, 60.0)], "batch_size int, score double")
    calls = spark.createDataFrame([(1, 10), (3, 30)], "batch_size int, tokens int")
    rows = {r.batch_size: (r.events, r.calls, r.derived_tokens_per_job) for r in drift.batch_size_effect(ledger, calls).collect()}
    assert rows == {1: (1, 1, 10.0), 2: (1, 0, None), 3: (0, 1, 10.0)}


def test_no_request_quota_has_no_interval(value_of):
    assert value_of(request_interval(F.col("r")), r=0) is None and value_of(request_interval(F.col("r")), r=60) == 2


def test_cost_by_kind(spark):
    """Unknown counts and missing prices stay apart from zero, and each kind has its own history of prices."""
    calls = spark.createDataFrame(
        [(1, "m", 10, 100, 50, 0, 7, 0), (2, "m", 20, 100, 50, 0, 7, 0), (3, "m", 20, None, None, None, 7, None), (4, "m", 20, 1, 0, 2, 0, 0),
         (5, "other", 20, 0, 0, 0, 0, 0)],
        "id int, model string, micros bigint, input_uncached bigint, cached_read bigint, cache_write bigint, output_tokens bigint, reasoning_tokens bigint")
    prices = spark.createDataFrame(
        [("m", "input_uncached", 0, 1.0), ("m", "input_uncached", 15, 2.0), ("m", "cached_read", 15, 0.5), ("m", "output_tokens", 0, 3.0)],
        "model string, kind string, effective_micros bigint, price double")
    lines = drift.cost_by_kind(calls, prices, ["id"])
    found = {(r.id, r.kind): r.cost for r in lines.collect()}
    assert len(found) == 25
    assert found[1, "input_uncached"] == 100 and found[2, "input_uncached"] == 200  # the price of its moment
    assert found[1, "cached_read"] is None and found[2, "cached_read"] == 25 and found[4, "cached_read"] == 0
    assert found[3, "input_uncached"] is None and found[3, "cache_write"] is None and found[4, "cache_write"] is None
    totals = {r.id: (r.known_cost, r.unknown_kinds, r.unpriced_kinds, r.cost) for r in drift.call_costs(lines, ["id"]).collect()}
    assert totals == {1: (121.0, 0, 1, None), 2: (246.0, 0, 0, 246.0), 3: (21.0, 4, 0, None), 4: (2.0, 0, 1, None), 5: (0.0, 0, 0, 0.0)}


def test_paired_drift_on_fixed_panels(spark):
    """Each posting is compared with itself, from its first day under the panel at hand."""
    panel = spark.createDataFrame([("p1", "a"), ("p1", "b"), ("p1", "never"), ("p2", "b"), ("p2", "b"), ("empty", "x")], "panel_id string, stablekey string")
    rows = [
        ("p1", "a", "m", "d1", 10.0), ("p1", "b", "m", "d1", 90.0), ("p1", "a", "m", "d2", 13.0), ("p1", "b", "m", "d2", 91.0),
        ("p1", "a", "m", "d3", 20.0), ("p1", "a", "m", "d3", 30.0), ("p1", "outside", "m", "d3", 0.0), ("p1", "b", "m", "d3", None),
        ("p2", "b", "m", "d4", 50.0), ("p2", "a", "m", "d4", 0.0), ("p2", "b", "m", "d5", 48.0), ("p1", "a", "other", "d2", 5.0),
        (None, "a", "m", "d1", 5.0),
    ]
    ledger = spark.createDataFrame(rows, "panel_id string, stablekey string, model string, day string, score double")
    found = {(r.panel_id, r.model, r.day): (r.panel_size, r.scored, r.first_seen, r.pairs, r.mean_diff, r.sd_diff, r.se_diff)
             for r in drift.panel_drift(ledger, panel).collect()}
    assert set(found) == {("p1", "m", "d1"), ("p1", "m", "d2"), ("p1", "m", "d3"), ("p1", "other", "d2"), ("p2", "m", "d4"), ("p2", "m", "d5")}
    assert found["p1", "m", "d1"] == (3, 2, 2, 0, None, None, None)
    size, scored, first, pairs, mean, sd, se = found["p1", "m", "d2"]
    assert (size, scored, first, pairs, mean) == (3, 2, 0, 2, 2.0) and abs(sd - 2 ** 0.5) < 1e-12 and abs(se - 1) < 1e-12
    assert found["p1", "m", "d3"] == (3, 1, 0, 1, 15.0, None, None)
    assert found["p2", "m", "d4"] == (1, 1, 1, 0, None, None, None) and found["p2", "m", "d5"][:5] == (1, 1, 0, 1, -2.0)
    # What a plain daily mean would call a drop of a panel's postings is none.
    assert drift.panel_drift(ledger.limit(0), panel).count() == 0
