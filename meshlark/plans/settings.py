"""Settings of an analysis: checked values, and strict JSON profiles."""

from __future__ import annotations

import json
import math
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

PROFILE_VERSION = 1


def rule(default: Any, kind: type, low: float | None = None, above: float | None = None, high: float | None = None, choices: tuple[str, ...] = (), optional: bool = False) -> Any:
    """A field with the values it may have."""
    return field(default=default, metadata={"kind": kind, "low": low, "above": above, "high": high, "choices": choices, "optional": optional})


def _check_value(name: str, value: Any, m: dict) -> None:
    if value is None:
        if not m["optional"]:
            raise ValueError(f"{name} is required")
        return
    wanted = (int, float) if m["kind"] is float else m["kind"]
    # a flag is no number
    if not isinstance(value, wanted) or (isinstance(value, bool) and m["kind"] is not bool):
        raise TypeError(f"{name} is a {m['kind'].__name__}, not {value!r}")
    if m["choices"] and value not in m["choices"]:
        raise ValueError(f"{name} is one of {', '.join(m['choices'])}, not {value!r}")
    if m["kind"] in (int, float):
        if not math.isfinite(value):
            raise ValueError(f"{name} is finite")
        if (m["low"] is not None and value < m["low"]) or (m["above"] is not None and value <= m["above"]) or (m["high"] is not None and value > m["high"]):
            raise ValueError(f"{name} is out of range: {value!r}")


class Checked:
    """Checks every field by its rule, then what concerns several fields."""

    def check(self, prefix: str = "") -> None:
        for f in fields(self):  # type: ignore[arg-type]
            value = getattr(self, f.name)
            if isinstance(value, Checked):
                value.check(f"{prefix}{f.name}.")
            elif "kind" in f.metadata:
                _check_value(prefix + f.name, value, f.metadata)
        self.check_together(prefix)

    def check_together(self, prefix: str) -> None:
        pass


@dataclass
class Filters(Checked):
    """Bounds of component areas (inclusive), and whether border components go."""

    min_area: int | None = rule(None, int, low=1, optional=True)
    max_area: int | None = rule(None, int, low=1, optional=True)
    exclude_border: bool = rule(False, bool)

    def check_together(self, prefix: str) -> None:
        if self.min_area and self.max_area and self.max_area < self.min_area:
            raise ValueError(f"{prefix}max_area is at least min_area")


@dataclass
class Band(Checked):
    """Windowed, band-limited spectrum; frequencies in cycles a pixel."""

    enabled: bool = rule(False, bool)
    window: str = rule("hann", str, choices=("none", "hann", "hamming", "blackman"))
    low: float | None = rule(None, float, low=0, high=math.sqrt(0.5), optional=True)
    high: float | None = rule(None, float, low=0, high=math.sqrt(0.5), optional=True)
    top_pairs: int = rule(5, int, low=1)
    radial_width: float | None = rule(None, float, above=0, optional=True)

    def check_together(self, prefix: str) -> None:
        if self.enabled and (self.low is None or self.high is None or self.high <= self.low):
            raise ValueError(f"{prefix}low and {prefix}high are increasing when the band is enabled")


@dataclass
class Bootstrap(Checked):
    enabled: bool = rule(False, bool)
    replicates: int = rule(1000, int, low=1)
    block: int = rule(100, int, low=1)
    level: float = rule(0.95, float, above=0, high=1 - 1e-9)
    seed: int = rule(0, int, low=0)


@dataclass
class Structure(Checked):
    enabled: bool = rule(False, bool)
    max_spacings: float = rule(15.0, float, above=0)
    bin_spacings: float = rule(0.25, float, above=0)

    def check_together(self, prefix: str) -> None:
        if self.bin_spacings > self.max_spacings:
            raise ValueError(f"{prefix}bin_spacings is at most max_spacings")


@dataclass
class Velocity(Checked):
    """A region of interest carried by velocity fields (a table field, x, y, u, v)."""

    enabled: bool = rule(False, bool)
    path: str | None = rule(None, str, optional=True)
    polygon: tuple = ((800.0, 800.0), (800.0, 1000.0), (1000.0, 1000.0), (1000.0, 800.0))
    method: str = rule("bilinear", str, choices=("bilinear", "inverse_distance", "nearest"))

    def check_together(self, prefix: str) -> None:
        self.polygon = tuple((float(x), float(y)) for x, y in self.polygon)
        if len(self.polygon) < 3 or not all(math.isfinite(c) for v in self.polygon for c in v):
            raise ValueError(f"{prefix}polygon has at least three finite vertices")
        if self.enabled and self.path is None:
            raise ValueError(f"{prefix}path is required when velocity fields are enabled")


@dataclass
class Outputs(Checked):
    """Which tables are made; a table that is not wanted is never computed."""

    metrics: bool = rule(True, bool)
    extended_metrics: bool = rule(True, bool)
    regions: bool = rule(True, bool)
    pixels: bool = rule(True, bool)
    row_bins: bool = rule(True, bool)
    quality: bool = rule(True, bool)
    statistics: bool = rule(True, bool)
    harmonic: bool = rule(True, bool)
    bootstrap: bool = rule(True, bool)
    fourier_bins: bool = rule(True, bool)
    fourier_spectrum: bool = rule(True, bool)
    band_tables: bool = rule(True, bool)
    band_spectrum: bool = rule(True, bool)
    structure: bool = rule(True, bool)
    roi: bool = rule(True, bool)

    def check_together(self, prefix: str) -> None:
        if not any(getattr(self, f.name) for f in fields(self)):
            raise ValueError(f"{prefix[:-1] or 'outputs'} leave nothing to be made")


#: The tables of each output.
TABLES = {
    "metrics": ("frame_metrics",),
    "extended_metrics": ("frame_metrics_extended",),
    "regions": ("regions",),
    "pixels": ("order_pixels",),
    "row_bins": ("row_bins",),
    "quality": ("segmentation_qc",),
    "statistics": ("spatial_statistics",),
    "harmonic": ("spatial_statistics_harmonic",),
    "bootstrap": ("spatial_block_bootstrap",),
    "fourier_bins": ("fourier_bins",),
    "fourier_spectrum": ("fourier_spectrum",),
    "band_tables": ("fourier_v2_pairs", "fourier_v2_radial", "fourier_v2_metrics"),
    "band_spectrum": ("fourier_v2_spectrum",),
    "structure": ("g6_correlation", "structure_metrics"),
    "roi": ("roi_boundaries", "roi_statistics"),
}


@dataclass
class Settings(Checked):
    folder: str = rule("", str)
    output: str | None = rule(None, str, optional=True)
    pattern: str = rule("*T{timepoint:04d}*.npy", str)
    start: int = rule(0, int, low=0)
    end: int | None = rule(None, int, low=0, optional=True)
    strict_missing: bool = rule(False, bool)
    n_fold: int = rule(6, int, low=1)
    neighbours: int = rule(6, int, low=0)
    include_self: bool = rule(False, bool)
    periodic: bool = rule(True, bool)
    exclude_boundary: bool = rule(True, bool)
    vertical_shift: int = rule(0, int)
    background: tuple = (0.0, 2.0)
    rectangle: tuple | None = None
    top_bins: int = rule(10, int, low=1)
    bin_size: int = rule(25, int, low=1)
    minutes: float = rule(0.5, float, above=0)
    resume: bool = rule(False, bool)
    step_frames: int = rule(64, int, low=1)
    outputs: Outputs = field(default_factory=Outputs)
    filters: Filters = field(default_factory=Filters)
    band: Band = field(default_factory=Band)
    bootstrap: Bootstrap = field(default_factory=Bootstrap)
    structure: Structure = field(default_factory=Structure)
    velocity: Velocity = field(default_factory=Velocity)

    def check_together(self, prefix: str) -> None:
        if not self.folder:
            raise ValueError("folder is required")
        if self.end is not None and self.end < self.start:
            raise ValueError("end is at least start")
        if "{timepoint" not in self.pattern:
            raise ValueError("pattern has a {timepoint} field")
        if not self.background or any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) for x in self.background):
            raise ValueError("background has finite numbers")
        if self.rectangle is not None:
            self.rectangle = tuple(self.rectangle)
            if len(self.rectangle) != 4 or any(isinstance(x, bool) or not isinstance(x, int) for x in self.rectangle):
                raise TypeError("rectangle has four whole numbers x1, x2, y1, y2")
            x1, x2, y1, y2 = self.rectangle
            if min(x1, y1) < 0 or x2 <= x1 or y2 <= y1:
                raise ValueError("rectangle has increasing bounds from zero on")
        if self.band.enabled and self.rectangle is None:
            raise ValueError("rectangle is required when the band is enabled")
        if self.resume and self.velocity.enabled:
            raise ValueError("a run with velocity fields can't be resumed")


_PATHS = {"folder", "output", "velocity.path"}


def _fill(kind: type, data: dict, prefix: str, base: Path | None) -> Any:
    if not isinstance(data, dict):
        raise TypeError(f"{prefix or 'the profile'} is an object")
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(data) - set(known)):
        raise ValueError(f"unknown settings: {', '.join(prefix + x for x in unknown)}")
    made = {}
    for name, value in data.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else None  # type: ignore[misc]
        if is_dataclass(default):
            value = _fill(type(default), value, f"{prefix}{name}.", base)
        elif prefix + name in _PATHS and isinstance(value, str) and base is not None and not os.path.isabs(value) and "://" not in value:
            value = str(base / value)
        elif isinstance(value, list):
            value = tuple(tuple(x) if isinstance(x, list) else x for x in value)
        made[name] = value
    return kind(**made)


def load_profile(path: str | Path) -> Settings:
    """Settings from a JSON profile; relative paths are relative to the profile, unknown names are rejected."""
    path = Path(path)
    data = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(data, dict) or set(data) != {"version", "analysis"} or data["version"] != PROFILE_VERSION:
        raise ValueError(f"a profile has version {PROFILE_VERSION} and analysis")
    settings = _fill(Settings, data["analysis"], "", path.parent.resolve())
    settings.check()
    return settings


def merged(settings: Settings, changes: dict) -> Settings:
    """Settings with some replaced; groups are replaced name by name, one level deep."""
    data = asdict(settings)
    for name, value in changes.items():
        data[name] = data[name] | value if isinstance(value, dict) and isinstance(data.get(name), dict) else value
    out = _fill(Settings, data, "", None)
    out.check()
    return out


def canonical(settings: Settings) -> str:
    """One text for equal settings: sorted names, no spaces; whether to resume, and in which steps, doesn't matter."""
    return json.dumps(asdict(settings) | {"resume": False, "output": None, "step_frames": None}, sort_keys=True, separators=(",", ":"), allow_nan=False)


def write_text(path: str | Path, text: str) -> None:
    """All or nothing: written beside the target, then moved over it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.{os.getpid()}.tmp")
    beside.write_text(text, encoding="utf-8")
    os.replace(beside, path)


def write_profile(settings: Settings, path: str | Path) -> None:
    settings.check()
    write_text(path, json.dumps({"version": PROFILE_VERSION, "analysis": asdict(settings)}, indent=2, allow_nan=False) + "\n")
