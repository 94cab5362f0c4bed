from dataclasses import replace
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from driftpanel import config as C
from driftpanel.config import BandTarget, ModelConfig, RunConfig, ScoreBand

BASE = RunConfig(
    sources={"greenhouse": ["acme", "globex"], "lever": ["initech"]},
    include=["golang", "remote"], exclude=["senior"], screening_model="gpt-5.4-mini",
    bands=(ScoreBand("reject", 0, 40), ScoreBand("viable", 80, 100)),
    targets=(BandTarget("reject", 4, 0), BandTarget("viable", 8, 8)), panel_size=30,
)


def test_config_id_pinned():
    assert BASE.config_id == "config-b35d986f6ef0"


def test_config_id_ignores_order():
    turned = replace(
        BASE, sources={"lever": ["initech"], "greenhouse": ["globex", "acme"]}, include=["remote", "golang"],
        bands=tuple(reversed(BASE.bands)), targets=tuple(reversed(BASE.targets)),
    )
    assert turned.config_id == BASE.config_id


@pytest.mark.parametrize("change", [
    {"sources": {"greenhouse": ["acme"]}}, {"include": ["golang"], "exclude": []}, {"screening_model": "other"},
    {"bands": (*BASE.bands, ScoreBand("mid", 40, 80))}, {"targets": (*BASE.targets, BandTarget("mid", 18, 0))},
    {"panel_size": 20},
])
def test_config_id_follows_every_field(change):
    assert replace(BASE, **change).config_id != BASE.config_id


@pytest.mark.parametrize("config", [
    BASE, replace(BASE, include=["<b>& "], exclude=[], bands=(ScoreBand("half", 0.5, 40.25),), targets=()),
    replace(BASE, sources={"lever": []}, bands=()),
])
def test_config_id_column_agrees(value_of, config):
    def array(items, kind):
        return F.array(*items).cast(f"array<{kind}>")

    sources = F.create_map(*[
        part for name, companies in config.sources.items()
        for part in (F.lit(name), array([F.lit(c) for c in companies], "string"))
    ])
    column = C.config_id_column(
        sources, array([F.lit(w) for w in config.include], "string"), array([F.lit(w) for w in config.exclude], "string"),
        F.lit(config.screening_model),
        array([F.struct(F.lit(b.name), F.lit(float(b.min)), F.lit(float(b.max))) for b in config.bands],
              "struct<name: string, min: double, max: double>"),
        array([F.struct(F.lit(t.band), F.lit(t.target), F.lit(t.floor)) for t in config.targets],
              "struct<band: string, target: int, floor: int>"),
        F.lit(config.panel_size),
    )
    assert value_of(column) == config.config_id


def test_instructions_version_is_a_content_hash():
    assert RunConfig(instructions="score candidates strictly on technical fit").instructions_version == "235f9150e288"
    assert RunConfig(instructions="a").instructions_version != RunConfig(instructions="b").instructions_version


@pytest.mark.parametrize("broken", [
    {"run_mode": "floor"}, {"contributor_id": ""}, {"batch_size_override": 0}, {"panel_size": 0},
])
def test_refused_runs(broken):
    good = RunConfig(contributor_id="c")
    good.validate()
    with pytest.raises(ValueError):
        replace(good, **broken).validate()


def test_batch_size_of_a_run():
    now = datetime(2026, 7, 22, 0, 5, tzinfo=timezone.utc)
    assert RunConfig(batch_size_override=4).batch_size(now) == 4
    assert RunConfig().batch_size(now) == 1
    assert RunConfig(sweep_start=date(2026, 7, 21)).batch_size(now) == 10
    assert RunConfig(sweep_start=date(2026, 8, 21)).batch_size(now) == 1


def test_seed():
    now = datetime(2026, 7, 29, 14, 30, 5, tzinfo=timezone.utc)
    assert RunConfig(panel_seed=5).seed(now) == 5
    assert RunConfig().seed(now) == 20260729143005


def test_screener_and_graders():
    models = (ModelConfig("a"), ModelConfig("s"), ModelConfig("b"))
    run = RunConfig(models=models, screening_model="s")
    assert run.screener().name == "s"
    assert [m.name for m in run.graders()] == ["a", "b"]
    for name in ("", "absent"):
        with pytest.raises(ValueError):
            RunConfig(models=models, screening_model=name).screener()


def test_band_overrides():
    assert C.parse_bands("") == C.DEFAULT_BANDS and C.parse_targets("") == C.DEFAULT_TARGETS
    assert C.parse_bands('[{"name":"x","min":1,"max":2}]') == (ScoreBand("x", 1, 2),)
    assert C.parse_targets('[{"band":"x","target":3}]') == (BandTarget("x", 3, 0),)
    with pytest.raises(ValueError):
        C.parse_bands("{nope")
