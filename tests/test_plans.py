"""Properties of the physical plans that matter on large tables."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from driftpanel.operators.filters import filter_postings
from driftpanel.operators.latest import latest_scores
from driftpanel.queries import QUERIES
from driftpanel.queries.views import ledger, postings

LAZY = [
    "board_union_normalised", "cost_asof", "drift_by_day", "export_rows", "fresh_candidates", "latest_score_per_posting",
    "liveness_split", "rebuild_calls_from_events", "rolling_token_audit", "spacing_audit", "stop_after_failure", "correlate_results",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|MapInPandas", plan)


def test_latest_scores_folds_before_its_only_shuffle(spark):
    plan = plan_of(latest_scores(ledger(spark, SF_DIR)))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "partial_max_by" in plan and "Window" not in plan


def test_keys_read_only_what_they_need(spark):
    plan = plan_of(postings(spark, SF_DIR).select("stablekey"))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert scans and not any("o_totalprice" in scan or "c_name" in scan or "o_orderdate" in scan for scan in scans)


def test_filter_reaches_the_scan(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select(
        F.col("lang").alias("title"), F.col("source").alias("location"), (F.col("doc_id") > 5).alias("is_remote"), "doc_id"
    )
    plan = plan_of(filter_postings(rows, ["e"], []).select("doc_id"))
    assert "GreaterThan(doc_id,5)" in plan and "text:" not in plan


def test_payloads_are_parsed_once(spark):
    """A filter pushed below the decoding would parse every payload again."""
    plan = plan_of(QUERIES["board_union_normalised"](spark, SF_DIR))
    assert plan.count("from_json(MapType(") == plan.count("from_json(ArrayType(") == 1  # objects, and bare lists
