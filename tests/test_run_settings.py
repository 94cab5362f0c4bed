"""Runs from settings documents, and all that can be wrong with these."""

import json
from dataclasses import fields
from datetime import date

import pytest

from driftpanel.config import DEFAULT_BANDS, DEFAULT_TARGETS, RunConfig
from driftpanel.sources.run_settings import RUN, Fault, SettingsRefused, config_of, load_run
from driftpanel.sources.settings import BUILT_IN_MODELS, MODEL_COLUMNS, model_catalogue

LEAST = {
    "sources.json": json.dumps({"greenhouse": ["acme", "bolt"], "workday": ["corp"]}),
    "filterKeywords.json": json.dumps({"include": ["baker"], "EXCLUDE": ["night"]}),
    "instructions.md": "Grade each posting.\n",
    "run.json": json.dumps({"contributor_id": "c", "screening_model": "s", "Sweep_Start": "2026-07-21", "temperature": 0, "panel_seed": None}),
    "models.json": json.dumps([{"name": "s", "tpm": 10, "BaseURL": "https://s.example"}, {"NAME": "g", "wantLogprobs": True}]),
}


def test_run_from_a_folder(spark, tmp_path):
    for name, text in {**LEAST, "notes.txt": "not a setting", "empty.json": ""}.items():
        (tmp_path / name).write_text(text)
    config = load_run(spark, str(tmp_path))
    assert config.sources == {"greenhouse": ["acme", "bolt"], "workday": ["corp"]}
    assert (config.include, config.exclude, config.instructions) == (["baker"], ["night"], "Grade each posting.\n")
    assert (config.bands, config.targets) == (DEFAULT_BANDS, DEFAULT_TARGETS)
    assert (config.contributor_id, config.sweep_start, config.temperature, config.panel_seed) == ("c", date(2026, 7, 21), 0, 0)
    assert config.screener().base_url == "https://s.example" and config.screener().tpm == 10
    assert [m.name for m in config.graders()] == ["g", *[name for name, *_ in BUILT_IN_MODELS]]
    # The same models as the table form reads from the same document.
    rows = spark.createDataFrame([(json.dumps([{"name": "s", "tpm": 10, "baseURL": "https://s.example"}, {"name": "g", "wantLogprobs": True}]),)], "document string")
    assert sorted(tuple(getattr(m, c) for c in MODEL_COLUMNS) for m in config.models) == sorted(map(tuple, model_catalogue(rows).collect()))


def test_own_bands_and_targets():
    config = config_of({**LEAST, "bands.json": '[{"name": "low", "max": 50}, {"name": "high", "min": 50, "max": 100.5}]',
                        "targets.json": '[{"band": "high", "target": 3, "floor": 1}]'})
    assert [(b.name, b.min, b.max) for b in config.bands] == [("low", 0, 50), ("high", 50, 100.5)]
    assert [(t.band, t.target, t.floor) for t in config.targets] == [("high", 3, 1)]


def test_all_faults_at_once():
    broken = {
        "sources.json": '{"greenhouse": "acme", "lever": ["x", 1], "ashby": null}',
        "instructions.md": " \n",
        "models.json": '[{"name": "s", "tpm": "many"}, 7, {"rpm": true}]',
        "bands.json": '[{"name": "b", "min": 9, "max": 3}]',
        "targets.json": '[{"band": "viable", "target": 2, "floor": 5}]',
        "run.json": '{"panel_size": 0, "sweep_start": "July", "speed": 3, "screening_model": "none"}',
    }
    with pytest.raises(SettingsRefused) as refused:
        config_of(broken)
    assert set(refused.value.faults) >= {
        Fault("filterKeywords.json", "", "is missing"),
        Fault("sources.json", "greenhouse", "is not a list of strings"),
        Fault("sources.json", "lever", "is not a list of strings"),
        Fault("instructions.md", "", "is empty"),
        Fault("models.json", "[0].tpm", "can't be 'many'"),
        Fault("models.json", "[1]", "is not an object"),
        Fault("models.json", "[2].rpm", "can't be True"),
        Fault("models.json", "[2].name", "is missing"),
        Fault("bands.json", "[0]", "ends at 3, before it begins at 9"),
        Fault("targets.json", "[0].band", "there is no band 'viable'"),
        Fault("targets.json", "[0].floor", "5 of 2 can't be kept"),
        Fault("run.json", "sweep_start", "is not a day: 'July'"),
        Fault("run.json", "speed", "is not a setting"),
        Fault("run.json", "", "the contributor id is missing"),
        Fault("run.json", "", "screening model 'none' is not configured"),
    }
    assert all(f.document in str(refused.value) for f in refused.value.faults)


@pytest.mark.parametrize("document", ["[]", "{", "3", ""])
def test_documents_of_another_shape(document):
    with pytest.raises(SettingsRefused) as refused:
        config_of({**LEAST, "sources.json": document})
    assert {f.document for f in refused.value.faults} == {"sources.json"}


def test_screeners():
    """A stored panel needs none; one that is named must exist, and a rebuild needs one."""
    said = lambda **single: {**LEAST, "run.json": json.dumps({"contributor_id": "c", **single})}
    assert config_of(said(active_panel_id="p")).active_panel_id == "p" and config_of(said()).screening_model == ""
    for single in ({"rebuild_panel": True}, {"screening_model": "t"}):
        with pytest.raises(SettingsRefused):
            config_of(said(**single))


def test_values_are_those_of_a_run():
    assert set(RUN) <= {f.name for f in fields(RunConfig)}
