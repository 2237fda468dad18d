"""Settings: plain data with defaults, read from one YAML file as a whole."""

from __future__ import annotations

import fnmatch
import os
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Settings:
    """Thresholds and catalogues. A file replaces the defaults of the names it has."""

    apply_threshold: float = 0.90
    discovery_threshold: float = 0.95
    similarity_threshold: float = 0.85
    allow_cent_scale: bool = False
    hamming_threshold: float = 12.5
    establish_count: int = 5
    establish_confidence: float = 0.95
    degradation_threshold: float = 0.85
    degradation_window: int = 10
    rediscovery_attempts: int = 3
    quality_threshold: float = 0.5
    batch_size: int = 50
    region_buffer: int = 5
    label_share: float = 0.70
    label_reach: float = 0.05
    min_label_score: float = 0.72
    family_threshold: float = 0.55
    provider_confidence: float = 0.75
    providers: dict = field(default_factory=dict)
    field_mapping: dict = field(default_factory=lambda: {"quantity": "qty", "amount": "total", "rate": "unit_price"})


def config_path(given: str | None = None, env: str = "LEDGERLOOM_CONFIG") -> str | None:
    """The file to read: the given one, else the environment's, else ./config.yaml if it is there."""
    if given or os.environ.get(env):
        return given or os.environ[env]
    return "config.yaml" if os.path.exists("config.yaml") else None


def load(path: str | None) -> Settings:
    """Settings from a flat YAML file; names it does not know are an error."""
    if path is None:
        return Settings()
    import yaml

    with open(path, encoding="utf-8") as f:
        told = yaml.safe_load(f) or {}
    known = {f.name for f in fields(Settings)}
    if unknown := sorted(set(told) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return Settings(**told)


def machine_profile(profiles: list[dict], machine: dict) -> str | None:
    """The first profile whose rules the machine meets: equal names, patterns of the model, ranges of memory and cores."""
    for rule in profiles:
        named = all(rule[k] == machine.get(k) for k in ("system", "architecture") if k in rule)
        model = not rule.get("model_name_patterns") or any(fnmatch.fnmatch(machine.get("model_name", ""), p) for p in rule["model_name_patterns"])
        ranged = all(rule.get(f"min_{k}", 0) <= machine.get(k, 0) <= rule.get(f"max_{k}", float("inf")) for k in ("memory_gb", "cpu_count") if f"min_{k}" in rule or f"max_{k}" in rule)
        if named and model and ranged:
            return rule["profile"]
    return None




#: What must be in the environment, and under which names.
REQUIRED = {"database_url": "LEDGERLOOM_DATABASE_URL"}
OPTIONAL = {"queue_url": "LEDGERLOOM_QUEUE_URL", "workspace": "LEDGERLOOM_WORKSPACE", "config": "LEDGERLOOM_CONFIG"}


def environment(env: dict[str, str] | None = None, required: dict[str, str] | None = None) -> dict[str, str]:
    """The settings that the environment gives; an error names every required one that is missing or blank."""
    env = dict(os.environ) if env is None else env
    needed = REQUIRED if required is None else required
    if missing := sorted(name for name in needed.values() if not env.get(name, "").strip()):
        raise ValueError(f"missing from the environment: {', '.join(missing)}")
    return {k: env[name].strip() for k, name in {**OPTIONAL, **needed}.items() if env.get(name, "").strip()}
