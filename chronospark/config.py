"""Configuration: a TOML file over defaults, checked."""

from __future__ import annotations

import tomllib
import zoneinfo
from copy import deepcopy
from typing import Any

# Sections, names and defaults of the configuration.
DEFAULTS: dict[str, dict[str, Any]] = {
    "analysis": {"recursive": True, "follow_symlinks": False, "snapshot_mode": "always", "threads": 0, "timezone": ""},
    "limits": {"max_files": 100_000, "max_recursion_depth": 64, "max_evidence_file_size_bytes": 32 << 30, "max_snapshot_total_bytes": 1 << 40, "max_events": 50_000_000, "max_issues": 100_000, "max_issues_per_evidence": 10_000, "max_findings": 1_000_000, "max_correlation_matches_per_rule": 100_000, "max_correlation_window_seconds": 86_400, "max_yara_scan_file_size_bytes": 1 << 30, "max_rule_files": 100_000, "max_rule_file_size_bytes": 16 << 20, "max_memory_bytes": 2 << 30},
    "sigma": {"enabled": True, "rule_dirs": ["./rules/sigma"]},
    "yara": {"enabled": True, "mode": "suspicious", "rule_dirs": ["./rules/yara"]},
    "correlation": {"enabled": True, "rule_dirs": ["./rules/correlation"]},
    "output": {"format": "text", "overwrite": False, "include_provenance": True},
    "strict": {"parser": False, "rules": False, "limits": False},
}


class ConfigError(ValueError):
    pass


def load(source: str) -> dict[str, dict[str, Any]]:
    try:
        given = tomllib.loads(source)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    out = deepcopy(DEFAULTS)
    for section, values in given.items():
        if section not in out or not isinstance(values, dict) or set(values) - set(out[section]):
            raise ConfigError(f"unknown entry in {section}")
        for k, v in values.items():
            if type(v) is not type(out[section][k]):
                raise ConfigError(f"{section}.{k}")
            out[section][k] = v
    if any(v < 1 for v in out["limits"].values()):
        raise ConfigError("limits must be at least 1")
    if out["analysis"]["snapshot_mode"] != "always":
        raise ConfigError("snapshot_mode must be always")
    if out["yara"]["mode"] not in ("all", "suspicious", "explicit"):
        raise ConfigError("yara.mode")
    if (zone := out["analysis"]["timezone"]) and zone not in zoneinfo.available_timezones():
        raise ConfigError(f"timezone {zone!r}")
    return out
