"""A folder of settings documents to a validated run.

`sources.json`, `filterKeywords.json` and `instructions.md` must be there; `models.json`,
`bands.json`, `targets.json` and `run.json` (single values of a run, by their names in
RunConfig) may be. All documents are read before anything is refused, and everything that
is wrong with any of them is reported at once. Names of fields match in any case. The
built-in models come after the configured ones. Sources of providers without a decoder
stay in the settings: a run skips and counts them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import SparkSession, functions as F

from driftpanel.config import BandTarget, ModelConfig, RunConfig, ScoreBand
from driftpanel.sources.settings import BUILT_IN_MODELS, PROVIDER_ADDRESSES

REQUIRED = ("sources.json", "filterKeywords.json", "instructions.md")
OPTIONAL = ("models.json", "bands.json", "targets.json", "run.json")

NUMBER = (int, float)
MODEL = {"name": str, "deployment": str, "wantLogprobs": bool, "tpm": int, "rpm": int, "protocol": str, "baseURL": str, "authScope": str}
BAND = {"name": str, "min": NUMBER, "max": NUMBER}
TARGET = {"band": str, "target": int, "floor": int}
RUN = {
    "contributor_id": str, "run_mode": str, "rescore_every_run": bool, "delete_aged": bool, "temperature": NUMBER,
    "batch_size_override": int, "sweep_start": date, "panel_enabled": bool, "panel_size": int, "screening_model": str,
    "panel_seed": int, "max_per_company": int, "active_panel_id": str, "rebuild_panel": bool,
}
# Models' fields as RunConfig names them.
PYTHON_NAMES = {"wantLogprobs": "want_logprobs", "baseURL": "base_url", "authScope": "auth_scope"}


@dataclass(frozen=True)
class Fault:
    document: str
    place: str
    reason: str


class SettingsRefused(ValueError):
    """What is wrong with the documents, all of it."""

    def __init__(self, faults: list[Fault]) -> None:
        self.faults = faults
        super().__init__("\n".join(f"{f.document}{f.place and ' ' + f.place}: {f.reason}" for f in faults))


def documents_in(spark: SparkSession, folder: str) -> dict[str, str]:
    """The settings documents of a folder, local or in an object store; other files aren't read."""
    files = spark.read.text(folder, wholetext=True).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value"))
    return {r["name"]: r["value"] for r in files.filter(F.col("name").isin(*REQUIRED, *OPTIONAL)).collect()}


class Reading:
    """Reads documents and notes what is wrong with them."""

    def __init__(self, documents: dict[str, str]) -> None:
        self.documents = documents
        self.faults = [Fault(name, "", "is missing") for name in REQUIRED if name not in documents]

    def fault(self, document: str, place: str, reason: str) -> None:
        self.faults.append(Fault(document, place, reason))

    def json_of(self, name: str, kind: type, empty: Any) -> Any:
        if not self.documents.get(name, "").strip():
            if name in REQUIRED and name in self.documents:
                self.fault(name, "", "is empty")
            return empty
        try:
            found = json.loads(self.documents[name])
        except ValueError as error:
            self.fault(name, "", f"is not JSON: {error}")
            return empty
        if not isinstance(found, kind):
            self.fault(name, "", f"holds {type(found).__name__}, not {kind.__name__}")
            return empty
        return found

    def strings(self, name: str, place: str, value: Any) -> list[str]:
        if value is None:
            return []
        if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
            self.fault(name, place, "is not a list of strings")
            return []
        return value

    def typed(self, name: str, place: str, members: dict, shape: dict) -> dict:
        """The members that have their field's type; null counts as not given."""
        exact = {field.lower(): field for field in shape}
        out = {}
        for given, value in members.items():
            field = exact.get(given.lower())
            here = f"{place}.{given}".lstrip(".")
            if field is None:
                self.fault(name, here, "is not a setting")
            elif value is None:
                continue
            elif shape[field] is date:
                try:
                    out[field] = date.fromisoformat(value)
                except (TypeError, ValueError):
                    self.fault(name, here, f"is not a day: {value!r}")
            # true is an int to Python, not to JSON.
            elif not isinstance(value, shape[field]) or (isinstance(value, bool) and shape[field] is not bool):
                self.fault(name, here, f"can't be {value!r}")
            else:
                out[field] = value
        return out

    def rows(self, name: str, shape: dict, make: Callable) -> list:
        out = []
        for k, row in enumerate(self.json_of(name, list, [])):
            if not isinstance(row, dict):
                self.fault(name, f"[{k}]", "is not an object")
                continue
            found = self.typed(name, f"[{k}]", row, shape)
            out.append((k, make(found)))
        return out


def built_in() -> list[ModelConfig]:
    return [ModelConfig(name, name, False, tpm, rpm, protocol, PROVIDER_ADDRESSES[protocol]) for name, protocol, tpm, rpm in BUILT_IN_MODELS]


def model_of(found: dict) -> ModelConfig:
    return ModelConfig(**{"name": "", **{PYTHON_NAMES.get(field, field): value for field, value in found.items()}})


def config_of(documents: dict[str, str]) -> RunConfig:
    """The run that the documents describe; SettingsRefused with all faults if they don't."""
    read = Reading(documents)
    sources = {provider: read.strings("sources.json", provider, companies)
               for provider, companies in read.json_of("sources.json", dict, {}).items()}
    words = {}
    for given, value in read.json_of("filterKeywords.json", dict, {}).items():
        if given.lower() in ("include", "exclude"):
            words[given.lower()] = read.strings("filterKeywords.json", given, value)
    models = read.rows("models.json", MODEL, model_of)
    bands = read.rows("bands.json", BAND, lambda b: ScoreBand(b.get("name", ""), b.get("min", 0), b.get("max", 0)))
    targets = read.rows("targets.json", TARGET, lambda t: BandTarget(t.get("band", ""), t.get("target", 0), t.get("floor", 0)))
    single = read.typed("run.json", "", read.json_of("run.json", dict, {}), RUN)
    if "instructions.md" in documents and not documents["instructions.md"].strip():
        read.fault("instructions.md", "", "is empty")

    for k, model in models:
        if not model.name:
            read.fault("models.json", f"[{k}].name", "is missing")
    for k, band in bands:
        if not band.min < band.max:
            read.fault("bands.json", f"[{k}]", f"ends at {band.max}, before it begins at {band.min}")
    defaults = RunConfig()
    known = {band.name for band in ([b for _, b in bands] or defaults.bands)}
    for k, target in targets:
        if target.band not in known:
            read.fault("targets.json", f"[{k}].band", f"there is no band {target.band!r}")
        if not 0 <= target.floor <= target.target:
            read.fault("targets.json", f"[{k}].floor", f"{target.floor} of {target.target} can't be kept")
    config = RunConfig(
        sources=sources, include=words.get("include", []), exclude=words.get("exclude", []), models=(*(m for _, m in models), *built_in()),
        instructions=documents.get("instructions.md", ""), bands=tuple(b for _, b in bands) or defaults.bands,
        targets=tuple(t for _, t in targets) or defaults.targets, **single)
    # Whether a panel must be built at all is known only where panels are stored.
    builds = config.screening_model or (config.panel_enabled and config.rebuild_panel)
    for check in (config.validate, *([config.screener] if builds else [])):
        try:
            check()
        except ValueError as error:
            read.fault("run.json", "", str(error))
    if read.faults:
        raise SettingsRefused(read.faults)
    return config


def load_run(spark: SparkSession, folder: str) -> RunConfig:
    return config_of(documents_in(spark, folder))
