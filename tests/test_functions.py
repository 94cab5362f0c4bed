import json
import math

import pytest
from pyspark.sql import functions as F

from driftpanel.functions import keys, moments, pay, payload, quota, sweep
from driftpanel.functions.expected import expected_score
from driftpanel.functions.items import strict_items
from driftpanel.functions.usage import itemised_usage


@pytest.mark.parametrize("text,want", [
    ("a b\tc\n", "abc"),
    ("a b\u0085c　d e", "abcde"),
    ("", ""),
])
def test_strip_spaces_is_unicode_wide(value_of, text, want):
    assert value_of(keys.strip_spaces(F.col("t")), t=text) == want


def test_identity(value_of):
    made = F.struct(
        keys.stable_key(F.col("c"), F.col("t"), F.col("l")).alias("s"),
        keys.composite_key(keys.stable_key(F.col("c"), F.col("t"), F.col("l")), F.col("p")).alias("k"),
        keys.job_key(F.col("c"), F.col("t"), F.col("p")).alias("j"),
    )
    got = value_of(made, c="A Co", t="Dev Ops", l="New York", p=-5)
    assert (got.s, got.k, got.j) == ("ACoDevOpsNewYork", "ACoDevOpsNewYork#-5", "ACoDevOps-5")


@pytest.mark.parametrize("text,want", [
    ("2025-01-01T00:00:00Z", 1735689600),
    ("2025-01-01T02:00:00+02:00", 1735689600),
    ("2024-12-31T16:30:00.123456-07:30", 1735689600),
    ("2025-01-01", moments.NO_DATE_EPOCH),
    ("2025-01-01 00:00:00Z", moments.NO_DATE_EPOCH),
    ("2025-01-01T00:00:00", moments.NO_DATE_EPOCH),
    ("2025-02-30T00:00:00Z", moments.NO_DATE_EPOCH),
    ("soon", moments.NO_DATE_EPOCH),
    ("", moments.NO_DATE_EPOCH),
    (None, moments.NO_DATE_EPOCH),
])
def test_rfc3339(value_of, text, want):
    assert value_of(moments.rfc3339_epoch(F.col("t")), t=text) == want


@pytest.mark.parametrize("millis,want", [(1999, 1), (0, 0), (-1, -1), (-1000, -1), (9007199254740993000, 9007199254740993)])
def test_millis(value_of, millis, want):
    assert value_of(moments.millis_to_epoch(F.col("m")), m=millis) == want


@pytest.mark.parametrize("seconds,want", [(1735689600, "2025-01-01"), (-1, "1969-12-31"), (moments.NO_DATE_EPOCH, "0001-01-01")])
def test_epoch_date(value_of, seconds, want):
    assert value_of(moments.epoch_date(F.col("s")), s=seconds) == want


def test_payload_text_and_bytes(spark):
    row = spark.createDataFrame(
        [("k", "T<1>", "C&D", "", "é x", "u", "s", 5, True), ("k", "t", "c", "l", "d", "u", "s", 5, False)],
        "key string, title string, company string, location string, description string, url string, source string, "
        "posted_at bigint, is_remote boolean",
    )
    got = row.select(
        payload.job_payload().alias("j"), payload.html_safe_bytes(payload.job_payload()).alias("n"),
        payload.html_safe_json(payload.job_payload()).alias("safe"),
    ).collect()
    assert list(json.loads(got[0].j)) == [*payload.PAYLOAD_FIELDS, "is_remote"]
    assert "is_remote" not in got[1].j
    for r in got:
        assert r.n == len(r.safe.encode())
        assert json.loads(r.safe) == json.loads(r.j)
    assert "\\u003c1\\u003e" in got[0].safe and "\\u0026" in got[0].safe and "\\u2028" in got[0].safe


def test_chat_request(value_of):
    text = value_of(payload.chat_request(F.lit("m"), F.lit("be fair"), F.lit("msg"), F.lit(0.5), F.lit(True)))
    body = json.loads(text)
    assert body["model"] == "m" and body["temperature"] == 0.5 and body["logprobs"] and body["top_logprobs"] == 5
    assert [m["role"] for m in body["messages"]] == ["system", "user"]
    assert body["response_format"]["json_schema"]["schema"] == payload.SCORE_SCHEMA
    plain = json.loads(value_of(payload.chat_request(F.lit("m"), F.lit(""), F.lit(""), F.lit(1.0), F.lit(False))))
    assert "logprobs" not in plain and "top_logprobs" not in plain


def usage(prompt, completion, cached=None, reasoning=None):
    """A usage blob; a detail that is not given has no object."""
    blob = {"prompt_tokens": prompt, "completion_tokens": completion, "total_tokens": prompt + completion}
    if cached is not None:
        blob["prompt_tokens_details"] = {"cached_tokens": cached}
    if reasoning is not None:
        blob["completion_tokens_details"] = {"reasoning_tokens": reasoning}
    return json.dumps(blob)


@pytest.mark.parametrize("raw,want", [
    (usage(731, 212, cached=512, reasoning=180), (219, 512, None, 32, 180, 943.0)),
    (usage(731, 212, cached=0, reasoning=0), (731, 0, None, 212, 0, 943.0)),
    (usage(731, 212), (None, None, None, None, None, 943.0)),
    (usage(731, 212, cached=700), (31, 700, None, None, None, 943.0)),
    (usage(731, 212, reasoning=212), (None, None, None, 0, 212, 943.0)),
    ('{"prompt_tokens":8,"total_tokens":21,"prompt_tokens_details":{},"completion_tokens_details":null}', (8, 0, None, None, None, 21.0)),
    ('{"prompt_tokens":2.25,"total_tokens":21}', (None, None, None, None, None, 0.0)),
    ('{"total_tokens":"21"}', (None, None, None, None, None, 0.0)),
    ('{"total_tokens":21,"prompt_tokens_details":[]}', (None, None, None, None, None, 0.0)),
    ("", (None, None, None, None, None, 0.0)),
    ('{"total_tokens"', (None, None, None, None, None, 0.0)),
])
def test_usage(value_of, raw, want):
    got = value_of(itemised_usage(F.col("r")), r=raw)
    assert tuple(got)[:6] == want
    assert got.raw == (raw or None)


def item(**fields):
    return json.dumps(fields)


MALFORMED = (False, "", -2.0)


@pytest.mark.parametrize("raw,want", [
    (item(key="OsloBaker17", score=63.25, reasoning="bakes, but far away"), (True, "OsloBaker17", 63.25, "bakes, but far away")),
    (item(key="OsloBaker17", score=63), (True, "OsloBaker17", 63.0, "")),
    (item(key="OsloBaker17", score=None), (True, "OsloBaker17", 0.0, "")),
    (item(key="OsloBaker17"), (True, "OsloBaker17", 0.0, "")),
    (item(score=-4, extra=[1, {"key": 2}]), (True, "", -4.0, "")),
    (item(), (True, "", 0.0, "")),
    ("null", (True, "", 0.0, "")),
    # A field of another type spoils the item; its reasoning is kept if that is text.
    (item(key=["OsloBaker17"], score=63, reasoning="kept"), (*MALFORMED, "kept")),
    (item(key="OsloBaker17", score="63", reasoning="kept"), (*MALFORMED, "kept")),
    (item(key="OsloBaker17", score=True, reasoning="kept"), (*MALFORMED, "kept")),
    (item(key="OsloBaker17", score=63, reasoning={"why": "bakes"}), (*MALFORMED, "")),
    ("[63]", (*MALFORMED, "")),
    ("63", (*MALFORMED, "")),
    ('{"key":"OsloBaker17","score', (*MALFORMED, "")),
    # Names count in any case.
    (item(KEY="OsloBaker17", Score=63, rEASONING="bakes"), (True, "OsloBaker17", 63.0, "bakes")),
    (item(KEY="upper", key="lower", score=63), (True, "lower", 63.0, "")),
    (item(Key=17, Score=63), (*MALFORMED, "")),
])
def test_strict_item(value_of, raw, want):
    got = value_of(F.get(strict_items(F.array(F.try_parse_json("r"))), 0), r=raw)
    assert (got.well_formed, got.job_key, got.emitted_score, got.reasoning) == want


PREFIX = '{"key":"a","score":'
GOOD = [("75", math.log(0.7)), ("74", math.log(0.3))]


def _blob(*tokens):
    return json.dumps({"content": [
        {"token": t, "logprob": 0, "top_logprobs": [{"token": c, "logprob": p} for c, p in tops]} for t, tops in tokens
    ]})


@pytest.mark.parametrize("content,blob,key,want", [
    (PREFIX + "75}", _blob((PREFIX, []), ("75", GOOD), ("}", [])), "a", 74.7),
    (PREFIX + "75}", None, "a", None),
    (PREFIX + "75}", "[]", "a", None),
    (PREFIX + "75}", _blob((PREFIX, []), ("75", GOOD), ("}", [])), "nonexistent", None),
    (PREFIX + "75}", _blob((PREFIX, []), ("AB", []), ("}", [])), "a", None),
    (PREFIX + "75}", _blob((PREFIX, []), ("75", [("75", -0.1), ("seventy-four", -2)]), ("}", [])), "a", None),
    (PREFIX + "75}", _blob((PREFIX, []), ("75d", GOOD)), "a", None),
    (PREFIX + " 75}", _blob((PREFIX, []), (" ", []), (" ", []), (" 75", GOOD)), "a", 74.7),
    (PREFIX + "75}", _blob((PREFIX, []), ("75", [])), "a", None),
    (PREFIX + "75}", _blob((PREFIX + "75}", [])), "a", None),
    ('{"key":"é","score":75}', _blob(('{"key":"é","score":', []), ("75", GOOD)), "é", 74.7),
    ('[{"key":"b","score":1},' + PREFIX + "75}]",
     _blob(('[{"key":"b","score":', []), ("1", [("1", 0.0)]), ("},", []), (PREFIX, []), ("75", GOOD)), "a", 74.7),
])
def test_expected_score(value_of, content, blob, key, want):
    got = value_of(expected_score(F.col("c"), F.col("b"), F.col("k")), c=content, b=blob, k=key)
    assert got is None if want is None else got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("tpm,want", [(200000, 150000), (1000, 750), (1, 0)])
def test_token_budget(value_of, tpm, want):
    assert value_of(quota.token_budget(F.col("t")), t=tpm) == want


@pytest.mark.parametrize("rpm,want", [(12, 7), (100, 1), (45, 2)])
def test_request_interval(value_of, rpm, want):
    assert value_of(quota.request_interval(F.col("r")), r=rpm) == want


@pytest.mark.parametrize("status,kind,want,retry", [
    (None, None, "", False), (500, None, "http_5xx", True), (501, None, "http_5xx", False), (429, None, "http_4xx", False),
    (302, "timeout", "http_other", False), (None, "timeout", "timeout", False), (None, "canceled", "canceled", False),
    (None, "decode", "unknown", False),
])
def test_error_class(spark, status, kind, want, retry):
    row = spark.createDataFrame([(status, kind)], "s int, k string")
    got = row.select(quota.error_class(F.col("s"), F.col("k")), quota.is_retryable(F.col("s"))).first()
    assert tuple(got) == (want, retry)


@pytest.mark.parametrize("failed,parsed,want", [(True, 0, "failed"), (False, 1, "partial"), (False, 2, "ok"), (False, 3, "ok")])
def test_outcome(value_of, failed, parsed, want):
    assert value_of(quota.batch_outcome(F.col("f"), F.col("p"), F.lit(2)), f=failed, p=parsed) == want


def test_estimates(value_of):
    assert value_of(quota.token_estimate(F.col("b")), b=1750) == 4000.0
    assert value_of(quota.estimate_ratio(F.lit(10.0), F.col("a")), a=4.0) == 2.5
    assert value_of(quota.estimate_ratio(F.lit(10.0), F.col("a")), a=0.0) is None


def test_sweep(spark):
    from driftpanel.config import batch_size_of_day

    days = spark.range(-5, 60).select("id", sweep.batch_size_of_day(F.col("id")).alias("n")).collect()
    sizes = {r.id: r.n for r in days}
    assert [sizes[d] for d in range(5)] == [1, 10, 2, 5, 3]
    assert sizes[-5] == sizes[0] == 1
    assert {n: [sizes[d] for d in range(30)].count(n) for n in (1, 2, 3, 5, 10)} == dict.fromkeys((1, 2, 3, 5, 10), 6)
    assert all(batch_size_of_day(d) == n for d, n in sizes.items())


@pytest.mark.parametrize("start,now,want", [
    ("2026-07-21 23:59:00", "2026-07-22 00:01:00", 1), ("2026-07-21 00:00:00", "2026-07-21 23:59:59", 0),
    ("2026-07-21 00:00:00", "2026-07-16 12:00:00", -5),
])
def test_day_index(value_of, start, now, want):
    assert value_of(sweep.day_index(F.lit(start).cast("timestamp"), F.lit(now).cast("timestamp"))) == want


def test_batch_size_override(value_of):
    assert value_of(sweep.batch_size(F.lit(1), F.lit(7))) == 7
    assert value_of(sweep.batch_size(F.lit(None).cast("int"), F.lit(None).cast("int"))) == 1


def test_hash_seed_and_panel_name(value_of):
    moment = F.lit("2026-07-29T07:30:05-07:00").cast("timestamp")
    assert value_of(keys.derived_seed(moment)) == 20260729143005
    assert value_of(keys.panel_id(F.lit(42), moment)) == "panel-42-20260729T143005Z"
    assert value_of(keys.content_hash(F.lit(""))) == "e3b0c44298fc"


@pytest.mark.parametrize("label,want", [("per-year-salary", "year"), ("per-month-salary", "month"), ("per-hour-wage", "hour"), ("x", "x")])
def test_pay_period(value_of, label, want):
    assert value_of(pay.pay_period(F.col("p")), p=label) == want


def test_usage_in_any_case(value_of):
    blob = '{"PROMPT_TOKENS": 31, "Completion_Tokens": 12, "total_TOKENS": 43, "Prompt_Tokens_Details": {"CACHED_tokens": 8}, "completion_tokens_DETAILS": null}'
    u = value_of(itemised_usage(F.col("x")), x=blob)
    assert (u.input_uncached, u.cached_read, u.output_tokens, u.reasoning_tokens, u.total, u.raw) == (23, 8, None, None, 43.0, blob)
    broken = value_of(itemised_usage(F.col("x")), x='{"Prompt_Tokens": "31", "TOTAL_TOKENS": 5}')
    assert broken.total == 0 and broken.input_uncached is None and broken.raw is not None
