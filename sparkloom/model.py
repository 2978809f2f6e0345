"""A pipeline definition: nodes joined by edges between named ports."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

DEFAULT_IN, DEFAULT_OUT = "input-0", "output-0"
#: Columns that carry what a record has beside its fields.
RECORD_ID, RECORD_TIME, RECORD_HEADERS, RECORD_ORDER = "_id", "_ts_ms", "_headers", "_seq"
RESERVED = (RECORD_ID, RECORD_TIME, RECORD_HEADERS, RECORD_ORDER)
#: Field of a text record.
MESSAGE = "_message"


class ConfigError(ValueError):
    """A pipeline or an operator's configuration that cannot be run."""


@dataclass(frozen=True)
class Node:
    id: str
    operator: str
    type: str = "UNKNOWN"
    name: str = ""
    config: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    source_port: str = DEFAULT_OUT
    target_port: str = DEFAULT_IN
    id: str = ""


@dataclass(frozen=True)
class Pipeline:
    id: str
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...]

    @staticmethod
    def parse(definition: str | dict[str, Any]) -> Pipeline:
        """From JSON text or its object; unknown properties are ignored."""
        raw = json.loads(definition) if isinstance(definition, str) else definition
        nodes = tuple(Node(str(n.get("id") or ""), str(n.get("operator") or "").upper(), str(n.get("type") or "UNKNOWN").upper(), str(n.get("name") or ""), dict(n.get("config") or {})) for n in raw.get("nodes") or [])
        edges = tuple(Edge(str(e.get("sourceNodeId") or ""), str(e.get("targetNodeId") or ""), e.get("sourcePortId") or DEFAULT_OUT, e.get("targetPortId") or DEFAULT_IN, str(e.get("id") or "")) for e in raw.get("edges") or [])
        return Pipeline(str(raw.get("pipelineId") or ""), nodes, edges)

    @staticmethod
    def load(path: str) -> Pipeline:
        return Pipeline.parse(Path(path).read_text())


def choice(config: dict[str, Any], key: str, allowed: tuple[str, ...], default: str | None = None) -> str:
    """An upper-cased option out of ``allowed``."""
    value = str(config.get(key) or default or "").upper()
    if value not in allowed:
        raise ConfigError(f"{key} must be one of {', '.join(allowed)}; it is {value or 'missing'}")
    return value


def text(config: dict[str, Any], key: str) -> str:
    """An option that must be there."""
    value = config.get(key)
    if value is None or not str(value).strip():
        raise ConfigError(f"{key} is required")
    return str(value).strip()


def number(config: dict[str, Any], key: str, default: int | None = None, least: int | None = None) -> int:
    value = config.get(key, default)
    try:
        value = int(value)
    except (TypeError, ValueError):
        raise ConfigError(f"{key} must be an integer") from None
    if least is not None and value < least:
        raise ConfigError(f"{key} must be at least {least}")
    return value


def flag(config: dict[str, Any], key: str, default: bool = False) -> bool:
    value = config.get(key, default)
    return value if isinstance(value, bool) else str(value).strip().lower() == "true"


def names(config: dict[str, Any], key: str, required: bool = False) -> list[str]:
    """A list given as a JSON array or as comma-separated text."""
    value = config.get(key) or []
    found = [str(x).strip() for x in (value.split(",") if isinstance(value, str) else value)]
    found = [x for x in found if x]
    if required and not found:
        raise ConfigError(f"{key} is required")
    return found
