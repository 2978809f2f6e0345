"""Checks of a pipeline before anything runs."""

from __future__ import annotations

from collections import Counter

from sparkloom.functions.expression import parse
from sparkloom.model import DEFAULT_IN, DEFAULT_OUT, ConfigError, Node, Pipeline
from sparkloom.operators import REGISTRY
from sparkloom.plans.planner import topological
from sparkloom.sinks import SINKS
from sparkloom.sources import SOURCES


class ValidationError(ConfigError):
    """Why a pipeline cannot run."""


def kind_of(node: Node) -> str:
    for kind, known in (("SOURCE", SOURCES), ("SINK", SINKS), ("TRANSFORM", REGISTRY)):
        if node.operator in known:
            return kind
    raise ValidationError(f"node {node.id}: operator {node.operator or 'missing'} is not supported")


def out_ports(node: Node) -> set[str] | None:
    """Output ports of a node; None allows any."""
    if node.operator in SINKS:
        return set()
    if node.operator == "ROUTE":
        return None
    return {"FILTER": {"true", "false"}, "DATA_QUALITY": {DEFAULT_OUT, "dirty"}}.get(node.operator, {DEFAULT_OUT})


def in_ports(node: Node) -> set[str]:
    if node.operator in SOURCES:
        return set()
    return {"left", "right"} if node.operator == "STREAM_JOIN" else {DEFAULT_IN}


def _structure(p: Pipeline, whole: bool) -> None:
    if not p.nodes:
        raise ValidationError("a pipeline needs nodes")
    for what, ids in (("node", [n.id for n in p.nodes]), ("edge", [e.id for e in p.edges if e.id])):
        if "" in ids:
            raise ValidationError(f"every {what} needs an id")
        twice = [i for i, n in Counter(ids).items() if n > 1]
        if twice:
            raise ValidationError(f"{what} ids are not unique: {', '.join(twice)}")
    by = {n.id: n for n in p.nodes}
    kinds = {n.id: kind_of(n) for n in p.nodes}
    if whole:
        for kind in ("SOURCE", "SINK"):
            if kind not in kinds.values():
                raise ValidationError(f"a pipeline needs a {kind.lower()}")
        if not p.edges:
            raise ValidationError("a pipeline needs edges")
    for e in p.edges:
        for end in (e.source, e.target):
            if end not in by:
                raise ValidationError(f"edge {e.id}: there is no node {end or 'without id'}")
        if kinds[e.source] == "SINK":
            raise ValidationError(f"sink {e.source} has outputs")
        ports = out_ports(by[e.source])
        if ports is not None and e.source_port not in ports:
            raise ValidationError(f"{by[e.source].operator} {e.source} has no output port {e.source_port}")
        if e.target_port not in in_ports(by[e.target]):
            raise ValidationError(f"{by[e.target].operator} {e.target} has no input port {e.target_port}")
    for n in p.nodes:
        if n.operator == "STREAM_JOIN" and (whole or any(e.target == n.id for e in p.edges)):
            missing = {"left", "right"} - {e.target_port for e in p.edges if e.target == n.id}
            if missing:
                raise ValidationError(f"STREAM_JOIN {n.id} lacks input {', '.join(sorted(missing))}")
    topological(p)
    if whole:
        ahead = _reached({n for n, k in kinds.items() if k == "SOURCE"}, [(e.source, e.target) for e in p.edges])
        back = _reached({n for n, k in kinds.items() if k == "SINK"}, [(e.target, e.source) for e in p.edges])
        stray = [n.id for n in p.nodes if n.id not in ahead & back]
        if stray:
            raise ValidationError(f"not on a path from a source to a sink: {', '.join(stray)}")


def _reached(start: set[str], steps: list[tuple[str, str]]) -> set[str]:
    seen, front = set(start), set(start)
    while front:
        front = {b for a, b in steps if a in front} - seen
        seen |= front
    return seen


def _expressions(node: Node) -> list[str]:
    c = node.config
    if node.operator == "FILTER":
        return [str(c.get("condition") or "")]
    if node.operator == "EVAL":
        return [str(c.get("expression") or "")]
    if node.operator == "ROUTE":
        return [str(r.get("condition") or "") for r in c.get("routes") or []]
    if node.operator == "CASE_WHEN":
        cases = c.get("cases") or []
        return [str(x.get("condition") or x.get("when") or "") for x in cases] + [str(x["expression"]) for x in cases if x.get("expression")] + ([str(c["defaultExpression"])] if c.get("defaultExpression") else [])
    return []


def validate(pipeline: Pipeline, mode: str = "run") -> None:
    """``save`` checks what is there; ``run`` also that it is complete; ``preview`` also the samples."""
    _structure(pipeline, mode != "save")
    for node in pipeline.nodes:
        for source in _expressions(node):
            try:
                parse(source)
            except ConfigError as e:
                raise ValidationError(f"node {node.id}: {e}") from None
        if mode == "preview" and node.operator in SOURCES:
            samples = node.config.get("sampleData")
            if samples is not None and not (isinstance(samples, list) and all(isinstance(s, str) for s in samples)):
                raise ValidationError(f"node {node.id}: sampleData must be an array of strings")
