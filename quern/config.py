"""Settings of the engine, with a strict TOML overlay."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass, replace
from datetime import timedelta
from pathlib import Path
from typing import Any

#: The enumerations of the data model.
TIERS = ("short", "long", "permanent")
JOB_STATUSES = ("pending", "running", "done", "failed")
LOG_LEVELS = ("error", "warn", "notice", "info")
OWNER_KINDS = ("memory", "search")
NODE_KINDS = ("search", "url", "scrape", "fact")

_UNITS = {"h": "hours", "m": "minutes", "s": "seconds", "ms": "milliseconds"}


def duration(text: str | timedelta) -> timedelta:
    """A duration written like ``240h``, ``1m30s`` or ``500ms``."""
    if isinstance(text, timedelta):
        return text
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text.strip():
        raise ValueError(f"not a duration: {text!r}")
    return sum((timedelta(**{_UNITS[unit]: float(number)}) for number, unit in parts), timedelta())


@dataclass(frozen=True)
class Tiers:
    short_ttl: timedelta = timedelta(hours=240)
    long_ttl: timedelta = timedelta(hours=1080)
    promote_after_hits: int = 3
    cleanup_interval: timedelta = timedelta(hours=1)


@dataclass(frozen=True)
class Memory:
    similarity_threshold: float = 0.85
    upsert_threshold: float = 0.95
    top_k: int = 8
    gate3_enabled: bool = True
    remember_default: str = "short"


@dataclass(frozen=True)
class Retention:
    raw_max_age: timedelta = timedelta(hours=48)
    raw_keep_last: int = 10
    trim_raw: bool = True


@dataclass(frozen=True)
class Jobs:
    stale_after: timedelta = timedelta(minutes=30)
    max_attempts: int = 5
    poll: timedelta = timedelta(seconds=1)


@dataclass(frozen=True)
class Observability:
    projection_sample_cap: int = 2000
    causality_max_urls: int = 200
    job_timing_sample: int = 200


@dataclass(frozen=True)
class Scrape:
    max_urls: int = 25
    total_timeout: timedelta = timedelta(seconds=120)
    snippet_chars: int = 2000
    min_text_chars: int = 500
    max_body_bytes: int = 5 * 1024 * 1024
    max_domains: int = 8
    distill_max_bytes: int = 8000


@dataclass(frozen=True)
class Logs:
    buffer: int = 4096
    batch: int = 128
    flush: timedelta = timedelta(milliseconds=500)


@dataclass(frozen=True)
class Settings:
    tiers: Tiers = field(default_factory=Tiers)
    memory: Memory = field(default_factory=Memory)
    retention: Retention = field(default_factory=Retention)
    jobs: Jobs = field(default_factory=Jobs)
    observability: Observability = field(default_factory=Observability)
    scrape: Scrape = field(default_factory=Scrape)
    logs: Logs = field(default_factory=Logs)


def overlay(base: Any, values: dict[str, Any], path: str = "") -> Any:
    """``base`` with ``values`` laid over it; an unknown key is an error."""
    known = {f.name for f in fields(base)}
    changes = {}
    for key, value in values.items():
        if key not in known:
            raise KeyError(f"unknown setting {path}{key}")
        old = getattr(base, key)
        if is_dataclass(old):
            changes[key] = overlay(old, value, f"{path}{key}.")
        else:
            changes[key] = duration(value) if isinstance(old, timedelta) else type(old)(value)
    return replace(base, **changes)


def load(path: str | Path | None = None, default: str | Path = "quern.toml") -> Settings:
    """Defaults under the file at ``path``; a missing default file is fine, a missing explicit one is not."""
    if path is None and not Path(default).exists():
        return Settings()
    return overlay(Settings(), tomllib.loads(Path(path or default).read_text()))
