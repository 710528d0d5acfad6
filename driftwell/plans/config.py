"""Job configuration from YAML: unknown keys and values out of range are errors."""

from __future__ import annotations

import dataclasses
import typing
from dataclasses import dataclass, field

from driftwell.operators.checks import require


# The fields' names are the keys of configuration files.


@dataclass(frozen=True)
class Job:
    name: str = ""


@dataclass(frozen=True)
class ArtifactStore:
    type: str = ""
    path: str = ""


@dataclass(frozen=True)
class Runtime:
    artifact_store: ArtifactStore = field(default_factory=ArtifactStore)


@dataclass(frozen=True)
class Endpoint:
    type: str = ""
    address: str = ""
    collection: str = ""
    dsn: str = ""
    table: str = ""
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Filters:
    enabled: bool = False


@dataclass(frozen=True)
class Query:
    top_k: int = 0
    expand_k: int = 0
    sample_size: int = 0
    filters: Filters = field(default_factory=Filters)


@dataclass(frozen=True)
class Boundary:
    rank_before_k: int = 0
    delta: float = 0.0


@dataclass(frozen=True)
class Fingerprint:
    boundary: Boundary = field(default_factory=Boundary)
    weights: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Report:
    formats: tuple = ()


@dataclass(frozen=True)
class Config:
    job: Job = field(default_factory=Job)
    runtime: Runtime = field(default_factory=Runtime)
    source: Endpoint = field(default_factory=Endpoint)
    target: Endpoint = field(default_factory=Endpoint)
    query: Query = field(default_factory=Query)
    fingerprint: Fingerprint = field(default_factory=Fingerprint)
    report: Report = field(default_factory=Report)


def _made(kind: type, value, where: str):
    """``value`` as ``kind``, whatever is missing by its default."""
    if dataclasses.is_dataclass(kind):
        require(value is None or isinstance(value, dict), f"{where or 'the document'} must be a mapping")
        hints = typing.get_type_hints(kind)
        for key in value or {}:
            require(key in hints, f"unknown key {where + '.' if where else ''}{key}")
        return kind(**{k: _made(hints[k], v, f"{where}.{k}".lstrip(".")) for k, v in (value or {}).items()})
    if value is None:
        return kind()
    if kind is tuple:
        require(isinstance(value, list), f"{where} must be a list")
        return tuple(value)
    right = isinstance(value, kind) and (kind is bool or not isinstance(value, bool))
    right = right or (kind is float and isinstance(value, int) and not isinstance(value, bool))
    require(right, f"{where} must be {kind.__name__}")
    return kind(value)


def check(c: Config) -> Config:
    require(bool(c.job.name), "job.name must not be empty")
    require(bool(c.source.type), "source.type must not be empty")
    require(bool(c.target.type), "target.type must not be empty")
    require(c.runtime.artifact_store.type in ("", "local", "memory"), f"runtime.artifact_store.type {c.runtime.artifact_store.type!r} is not known")
    require(c.query.top_k > 0, "query.top_k must be above 0")
    require(c.query.expand_k >= c.query.top_k, "query.expand_k must be at least query.top_k")
    require(c.query.sample_size > 0, "query.sample_size must be above 0")
    require(c.fingerprint.boundary.rank_before_k >= 0, "fingerprint.boundary.rank_before_k must not be negative")
    require(c.fingerprint.boundary.delta >= 0, "fingerprint.boundary.delta must not be negative")
    weights = c.fingerprint.weights
    require(bool(weights), "fingerprint.weights must not be empty")
    for name, w in weights.items():
        require(isinstance(w, (int, float)) and w >= 0, f"fingerprint.weights.{name} must not be negative")
    require(sum(weights.values()) > 0, "fingerprint.weights must add up to more than 0")
    for f in c.report.formats:
        require(f in ("json", "markdown"), f"report format {f!r} is not known")
    return c


def parse(text: str) -> Config:
    import yaml

    return check(_made(Config, yaml.safe_load(text), ""))


def load(path: str) -> Config:
    try:
        with open(path, encoding="utf-8") as f:
            return parse(f.read())
    except (OSError, ValueError) as error:
        raise ValueError(f"configuration {path!r}: {error}") from error
