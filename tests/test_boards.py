import json

import pytest

from driftpanel.functions.moments import NO_DATE_EPOCH
from driftpanel.operators.filters import filter_postings, keyword_match, valid_scores
from driftpanel.sources import boards, settings
from pyspark.sql import functions as F

GREENHOUSE = {"title": "Go  Dev", "content": "<p>x</p>", "absolute_url": "u1", "updated_at": "2025-01-01T00:00:00Z",
              "location": {"name": "Remote, US"}, "pay_input_ranges": [{"min_cents": 1, "title": "t"}]}
ASHBY = {"title": "Dev", "location": "Oslo", "isListed": True, "isRemote": True, "descriptionHtml": "d", "jobUrl": "u2",
         "publishedAt": "2025-01-01T00:00:00+00:00"}
LEVER = {"id": "1", "text": "Dev", "hostedUrl": "u3", "workplaceType": "remote", "createdAt": 1735689600999,
         "descriptionPlain": "d", "categories": {"location": "Bonn"}}


def landing(spark, *rows):
    return spark.createDataFrame(
        [(p, c, body if isinstance(body, str) else json.dumps(body)) for p, c, body in rows],
        "provider string, company string, payload string",
    )


def decode(spark, *rows):
    return boards.postings_of(boards.parse_payloads(landing(spark, *rows))).collect()


def test_three_shapes(spark):
    got = {r.source: r for r in decode(
        spark, ("greenhouse", "A Co", {"jobs": [GREENHOUSE]}), ("ashby", "B", {"jobs": [ASHBY]}), ("lever", "C", [LEVER]),
    )}
    g, a, v = got["greenhouse:A Co"], got["ashby"], got["lever:C"]
    assert (g.key, g.title, g.location, g.posted_at, g.is_remote) == ("ACoGoDev1735689600", "Go  Dev", "Remote, US", 1735689600, True)
    assert (a.company, a.url, a.posted_at, a.is_remote) == ("B", "u2", 1735689600, True)
    assert (v.location, v.posted_at, v.is_remote, v.stablekey) == ("Bonn", 1735689600, True, "CDevBonn")


def in_case(value, change):
    """The same document with other cases of every name."""
    if isinstance(value, dict):
        return {change(k): in_case(v, change) for k, v in value.items()}
    return [in_case(v, change) for v in value] if isinstance(value, list) else value


@pytest.mark.parametrize("change", [str.upper, str.lower, str.title, str.swapcase])
def test_names_in_any_case(spark, change):
    rows = [("greenhouse", "A Co", {"jobs": [GREENHOUSE]}), ("ashby", "B", {"jobs": [ASHBY]}), ("lever", "C", [LEVER])]
    changed = [(p, c, in_case(body, change)) for p, c, body in rows]
    key = lambda r: r.source
    assert sorted(decode(spark, *changed), key=key) == sorted(decode(spark, *rows), key=key)
    wrong = [("greenhouse", "A", {change("jobs"): [{change("title"): 7}]}), ("ashby", "B", {change("jobs"): {}}),
             ("lever", "C", [{change("categories"): {change("team"): 1}}]),
             ("greenhouse", "D", {"jobs": [{change("pay_input_ranges"): [{change("max_cents"): "1"}]}]})]
    assert boards.quarantined(boards.parse_payloads(landing(spark, *wrong))).count() == len(wrong)


def test_the_last_list_counts(spark):
    body = json.dumps({"jobs": [{"title": "first"}]})[:-1] + ', "JOBS": [{"title": "second"}, {"title": "third"}]}'
    assert [r.title for r in decode(spark, ("greenhouse", "A", body))] == ["second", "third"]


def test_missing_and_null_fields(spark):
    g, = decode(spark, ("greenhouse", "A", {"jobs": [{"title": None, "location": None}]}))
    assert (g.title, g.location, g.description, g.posted_at, g.is_remote) == ("", "", "", NO_DATE_EPOCH, False)
    v, = decode(spark, ("lever", "A", [{}]))
    assert (v.posted_at, v.is_remote, v.key) == (0, False, "A0")
    assert decode(spark, ("ashby", "A", {"jobs": [{"title": "t"}]})) == []
    a, = decode(spark, ("ashby", "A", {"jobs": [{"isListed": True, "publishedAt": "yesterday"}]}))
    assert a.posted_at == NO_DATE_EPOCH


def test_remote_rules(spark):
    jobs = [dict(GREENHOUSE, location={"name": "Oslo"}, content=c) for c in ("fully REMOTE", "on site")]
    assert [r.is_remote for r in decode(spark, ("greenhouse", "A", {"jobs": jobs}))] == [True, False]
    kinds = [dict(LEVER, workplaceType=w) for w in ("remote", "Remote", "hybrid")]
    assert [r.is_remote for r in decode(spark, ("lever", "A", kinds))] == [True, False, False]


@pytest.mark.parametrize("provider,body", [
    ("greenhouse", '{"jobs":[{"title":'), ("greenhouse", {"jobs": [dict(GREENHOUSE, title=7)]}),
    ("greenhouse", {"jobs": [dict(GREENHOUSE, location="Oslo")]}), ("greenhouse", {"jobs": {}}), ("greenhouse", [GREENHOUSE]),
    ("greenhouse", {"jobs": [dict(GREENHOUSE, pay_input_ranges=[{"min_cents": "1"}])]}),
    ("ashby", {"jobs": [ASHBY, dict(ASHBY, isListed="yes")]}), ("lever", {"jobs": [LEVER]}),
    ("lever", [dict(LEVER, createdAt="1735689600999")]), ("lever", [dict(LEVER, createdAt=1.5)]), ("lever", [LEVER, 7]),
    ("lever", ""),
])
def test_bad_payloads_lose_only_their_company(spark, provider, body):
    parsed = boards.parse_payloads(landing(spark, (provider, "bad", body), ("ashby", "fine", {"jobs": [ASHBY]})))
    assert [r.company for r in boards.postings_of(parsed).collect()] == ["fine"]
    assert [r.company for r in boards.quarantined(parsed).collect()] == ["bad"]
    assert [tuple(r) for r in boards.fetched_counts(parsed).collect()] == [("ashby", "fine", 1)]


@pytest.mark.parametrize("provider,body", [("greenhouse", {}), ("greenhouse", "null"), ("ashby", {"jobs": None}), ("lever", []), ("lever", "null")])
def test_empty_payloads_are_fine(spark, provider, body):
    parsed = boards.parse_payloads(landing(spark, (provider, "A", body)))
    assert boards.quarantined(parsed).count() == 0 and boards.postings_of(parsed).count() == 0


def test_unlisted_postings_count_as_fetched(spark):
    parsed = boards.parse_payloads(landing(spark, ("ashby", "A", {"jobs": [ASHBY, dict(ASHBY, isListed=False)]})))
    assert boards.fetched_counts(parsed).first().fetched == 2 and boards.postings_of(parsed).count() == 1


def test_collect_keeps_duplicates_and_skips_what_is_not_configured(spark):
    rows = landing(spark, ("lever", "A", [LEVER, LEVER]), ("lever", "B", [LEVER]), ("workday", "A", [LEVER]))
    sources = spark.createDataFrame([("lever", "A"), ("lever", "A"), ("workday", "A")], "provider string, company string")
    assert [r.company for r in boards.collect_boards(rows, sources).collect()] == ["A", "A"]


def test_landing_folder(spark, tmp_path):
    folder = tmp_path / "provider=lever" / "company=A"
    folder.mkdir(parents=True)
    (folder / "1.json").write_text(json.dumps([LEVER], indent=2))
    rows = boards.read_landing(spark, str(tmp_path))
    assert [r.source for r in boards.postings_of(boards.parse_payloads(rows)).collect()] == ["lever:A"]


@pytest.mark.parametrize("text,include,exclude,want", [
    ("Senior Go Dev", ["go"], [], True), ("Senior Go Dev", ["GO"], ["senior"], False), ("Dev", [], [], True),
    ("Dev", [], ["dev"], False), ("Dev", ["qa"], [], False), ("Dev", [""], [], True), ("Dev", [], [""], False),
    ("C++ Dev", ["c++"], [], True), ("Dev", ["d.v"], [], False),
])
def test_keywords(value_of, text, include, exclude, want):
    assert value_of(keyword_match(F.col("t"), include, exclude), t=text) is want


def test_filter_looks_at_title_and_location_of_remote_postings(spark):
    rows = spark.createDataFrame(
        [("go dev", "Oslo", True), ("dev", "Go City", True), ("go dev", "Oslo", False)], "title string, location string, is_remote boolean"
    )
    assert filter_postings(rows, ["go"], []).count() == 2
    assert filter_postings(rows, ["dev oslo"], []).count() == 1


def test_valid_scores(spark):
    rows = spark.createDataFrame([(0.0,), (-2.0,), (5.0,)], "emitted_score double")
    assert valid_scores(rows).count() == 2


def _document(spark, tmp_path, text):
    path = tmp_path / "doc.json"
    path.write_text(text)
    return settings.read_text(spark, str(path))


def test_sources_document(spark, tmp_path):
    doc = _document(spark, tmp_path, '{\n "lever": ["a", "b"],\n "workday": ["c"], "ashby": []\n}')
    sources = settings.source_companies(doc)
    assert {tuple(r) for r in settings.known_sources(sources).collect()} == {("lever", "a"), ("lever", "b")}
    assert [tuple(r) for r in settings.unknown_providers(sources).collect()] == [("workday", 1)]


def test_keyword_document(spark, tmp_path):
    row = settings.keyword_lists(_document(spark, tmp_path, '{"include":["a"]}')).first()
    assert (row.include, row.exclude) == (["a"], [])


def test_bad_settings_fail(spark, tmp_path):
    with pytest.raises(Exception):
        settings.keyword_lists(_document(spark, tmp_path, '{"include":')).collect()


def test_model_catalogue(spark, tmp_path):
    doc = _document(spark, tmp_path, '[{"name":"m","tpm":5,"baseURL":"b"},{"name":"gemini-3.5-flash-lite"}]')
    rows = settings.model_catalogue(doc).collect()
    assert len(rows) == 17 and (rows[0].name, rows[0].tpm, rows[0].rpm, rows[0].base_url) == ("m", 5, 0, "b")
    assert sum(r.name == "gemini-3.5-flash-lite" for r in rows) == 2
