"""What every operator is: a function of input ports, its configuration and a context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.model import DEFAULT_IN, DEFAULT_OUT, RECORD_ORDER, RECORD_TIME
from sparkloom.paths import column

Ports = dict[str, DataFrame]
Operator = Callable[[Ports, dict[str, Any], "Context"], Ports]


@dataclass
class Context:
    """What a run offers to operators: the node's id and registered Python functions."""

    node_id: str = ""
    functions: dict[str, Callable] = field(default_factory=dict)


REGISTRY: dict[str, Operator] = {}


def operator(name: str) -> Callable[[Operator], Operator]:
    def add(f: Operator) -> Operator:
        REGISTRY[name] = f
        return f

    return add


def single(inputs: Ports) -> DataFrame:
    return inputs[DEFAULT_IN]


def out(df: DataFrame) -> Ports:
    return {DEFAULT_OUT: df}


def order_key(df: DataFrame, config: dict[str, Any]) -> Column:
    """What stands for the order of arrival: ``orderBy``, else the record's order and time, else all columns."""
    wanted = config.get("orderBy")
    chosen = [wanted] if isinstance(wanted, str) else list(wanted or [])
    if not chosen:
        chosen = [c for c in (RECORD_TIME, RECORD_ORDER) if c in df.columns]
    if not chosen:
        return F.struct(*[F.to_json(F.struct(*[column(c) for c in df.columns])).alias("all")])
    return F.struct(*[column(c) for c in chosen])


def is_streaming(df: DataFrame) -> bool:
    return df.isStreaming
