"""Settings of a run."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, functions as F

from driftpanel.functions.keys import HASH_CHARS, content_hash
from driftpanel.functions.payload import html_safe_json
from driftpanel.functions.sweep import SWEEP_SIZES


@dataclass(frozen=True)
class ScoreBand:
    name: str
    min: float
    max: float


@dataclass(frozen=True)
class BandTarget:
    band: str
    target: int
    floor: int = 0


@dataclass(frozen=True)
class ModelConfig:
    name: str
    deployment: str = ""
    want_logprobs: bool = False
    tpm: int = 0
    rpm: int = 0
    protocol: str = ""
    base_url: str = ""
    auth_scope: str = ""


# Default bands and targets of the 0-100 score range. Fixed values.
DEFAULT_BANDS = (
    ScoreBand("reject", 0, 40),
    ScoreBand("borderline_low", 40, 60),
    ScoreBand("borderline_high", 60, 80),
    ScoreBand("viable", 80, 100),
)
DEFAULT_TARGETS = (
    BandTarget("reject", 4, 0),
    BandTarget("borderline_low", 8, 0),
    BandTarget("borderline_high", 10, 0),
    BandTarget("viable", 8, 8),
)
DEFAULT_PANEL_SIZE = 30
SCREENING_BATCH_SIZE = 2
SCREENING_TEMPERATURE = 0.0
MAIN_MODE = "main"


def parse_bands(document: str) -> tuple[ScoreBand, ...]:
    """Bands from an override; an empty document means the defaults."""
    if not document:
        return DEFAULT_BANDS
    return tuple(ScoreBand(b.get("name", ""), b.get("min", 0), b.get("max", 0)) for b in json.loads(document))


def parse_targets(document: str) -> tuple[BandTarget, ...]:
    if not document:
        return DEFAULT_TARGETS
    return tuple(
        BandTarget(t.get("band", ""), t.get("target", 0), t.get("floor", 0)) for t in json.loads(document)
    )


@dataclass(frozen=True)
class RunConfig:
    sources: Mapping[str, Sequence[str]] = field(default_factory=dict)
    include: Sequence[str] = ()
    exclude: Sequence[str] = ()
    models: Sequence[ModelConfig] = ()
    instructions: str = ""
    contributor_id: str = ""
    run_mode: str = MAIN_MODE
    rescore_every_run: bool = True
    delete_aged: bool = False
    temperature: float = 1.0
    batch_size_override: int | None = None
    sweep_start: date | None = None
    panel_enabled: bool = True
    panel_size: int = DEFAULT_PANEL_SIZE
    screening_model: str = ""
    bands: Sequence[ScoreBand] = DEFAULT_BANDS
    targets: Sequence[BandTarget] = DEFAULT_TARGETS
    panel_seed: int = 0
    max_per_company: int = 0
    active_panel_id: str = ""
    rebuild_panel: bool = False

    def validate(self) -> None:
        """Refuses a run that would write mislabelled rows."""
        if self.run_mode != MAIN_MODE:
            raise ValueError(f"run mode {self.run_mode!r} is not available, only {MAIN_MODE!r}")
        if not self.contributor_id:
            raise ValueError("the contributor id is missing")
        if self.batch_size_override is not None and self.batch_size_override <= 0:
            raise ValueError("the batch size must be positive")
        if self.panel_size <= 0:
            raise ValueError("the panel size must be positive")

    def batch_size(self, now: datetime) -> int:
        if self.batch_size_override is not None:
            return self.batch_size_override
        if self.sweep_start is None:
            return batch_size_of_day(0)
        return batch_size_of_day((now.date() - self.sweep_start).days)

    def seed(self, now: datetime) -> int:
        """The configured seed, or the moment of the build as digits."""
        return self.panel_seed or int(now.strftime("%Y%m%d%H%M%S"))

    def screener(self) -> ModelConfig:
        if not self.screening_model:
            raise ValueError("a panel build needs a screening model")
        for model in self.models:
            if model.name == self.screening_model:
                return model
        raise ValueError(f"screening model {self.screening_model!r} is not configured")

    def graders(self) -> list[ModelConfig]:
        """Every model but the screener, which never grades."""
        return [model for model in self.models if model.name != self.screening_model]

    @property
    def instructions_version(self) -> str:
        return short_hash(self.instructions)

    @property
    def config_id(self) -> str:
        return config_id(self)


def batch_size_of_day(day: int) -> int:
    day = max(day, 0)
    shift = day // len(SWEEP_SIZES) % len(SWEEP_SIZES)
    turned = SWEEP_SIZES[shift:] + SWEEP_SIZES[:shift]
    place = day % len(SWEEP_SIZES)
    return turned[place // 2] if place % 2 == 0 else turned[-(place // 2) - 1]


def short_hash(content: str) -> str:
    return hashlib.sha256(content.encode()).hexdigest()[:HASH_CHARS]


def _plain(number: float):
    return int(number) if float(number).is_integer() else number


def config_id(config: RunConfig) -> str:
    """Hash of the settings that make two runs comparable; order does not count."""
    document = {
        "sources": {name: sorted(config.sources[name]) or None for name in sorted(config.sources)},
        "filter_rules": {"include": sorted(config.include) or None, "exclude": sorted(config.exclude) or None},
        "screening_model": config.screening_model,
        "score_bands": [
            {"name": b.name, "min": _plain(b.min), "max": _plain(b.max)}
            for b in sorted(config.bands, key=lambda b: b.min)
        ] or None,
        "band_targets": [asdict(t) for t in sorted(config.targets, key=lambda t: t.band)] or None,
        "panel_size": config.panel_size,
    }
    text = json.dumps(document, separators=(",", ":"), ensure_ascii=False)
    for char in "<>&\u2028\u2029":
        text = text.replace(char, f"\\u{ord(char):04x}")
    return "config-" + short_hash(text)


def config_id_column(sources: Column, include: Column, exclude: Column, screening_model: Column,
                     bands: Column, targets: Column, panel_size: Column) -> Column:
    """``config_id`` of many configurations at once, one per row.

    ``sources`` is a map of arrays, ``bands`` and ``targets`` arrays of structs.
    """

    def filled(items: Column) -> Column:
        return F.when(F.size(items) > 0, items)

    def number(value: Column) -> Column:
        """Shortest decimal text, so that 40.0 reads 40."""
        return F.regexp_replace(value.cast("decimal(30,12)").cast("string"), r"\.?0+$", "")

    def quoted(text: Column) -> Column:
        return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")

    def band(b: Column) -> Column:
        return F.concat(
            F.lit('{"name":'), quoted(b["name"]), F.lit(',"min":'), number(b["min"]),
            F.lit(',"max":'), number(b["max"]), F.lit("}"),
        )

    by_min = F.array_sort(bands, lambda a, b: F.when(a["min"] < b["min"], -1).when(a["min"] > b["min"], 1).otherwise(0))
    by_band = F.array_sort(targets, lambda a, b: F.when(a["band"] < b["band"], -1).when(a["band"] > b["band"], 1).otherwise(0))
    keep_nulls = {"ignoreNullFields": "false"}
    sorted_sources = F.map_from_entries(
        F.transform(
            F.array_sort(F.map_entries(sources)),
            lambda e: F.struct(e["key"].alias("key"), filled(F.array_sort(e["value"])).alias("value")),
        )
    )
    rules = F.struct(
        filled(F.array_sort(include)).alias("include"), filled(F.array_sort(exclude)).alias("exclude")
    )
    band_text = F.when(
        F.size(bands) > 0,
        F.concat(F.lit("["), F.array_join(F.transform(by_min, band), ","), F.lit("]")),
    ).otherwise("null")
    document = F.concat(
        F.lit('{"sources":'), F.to_json(sorted_sources, keep_nulls),
        F.lit(',"filter_rules":'), F.to_json(rules, keep_nulls),
        F.lit(',"screening_model":'), quoted(screening_model),
        F.lit(',"score_bands":'), band_text,
        F.lit(',"band_targets":'), F.coalesce(F.to_json(filled(by_band), keep_nulls), F.lit("null")),
        F.lit(',"panel_size":'), panel_size.cast("string"), F.lit("}"),
    )
    return F.concat(F.lit("config-"), content_hash(html_safe_json(document)))
