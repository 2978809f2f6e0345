"""Order of nodes, and the DataFrames on their ports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkloom.model import ConfigError, Node, Pipeline
from sparkloom.paths import Field, as_text, column


def topological(pipeline: Pipeline) -> list[Node]:
    """Nodes so that each follows what it reads; ``ConfigError`` where there is a cycle."""
    by = {n.id: n for n in pipeline.nodes}
    waiting = {n.id: sum(e.target == n.id for e in pipeline.edges) for n in pipeline.nodes}
    ready, out = [n.id for n in pipeline.nodes if not waiting[n.id]], []
    while ready:
        at = ready.pop(0)
        out.append(by[at])
        for e in pipeline.edges:
            if e.source == at:
                waiting[e.target] -= 1
                if not waiting[e.target]:
                    ready.append(e.target)
    if len(out) < len(by):
        raise ConfigError("the pipeline has a cycle")
    return out


def union(parts: list[DataFrame]) -> DataFrame:
    """All records of several outputs; fields that one lacks are null there.

    A field of different types becomes text, as records have no common schema;
    numbers of different types alone stay numbers, of the widest type.
    """
    if len(parts) == 1:
        return parts[0]
    types: dict[str, dict[str, T.DataType]] = {}
    for df in parts:
        for f in df.schema.fields:
            types.setdefault(f.name, {})[f.dataType.simpleString()] = f.dataType
    mixed = {n for n, t in types.items() if len(t) > 1 and not all(isinstance(x, T.NumericType) for x in t.values())}
    aligned = []
    for df in parts:
        for f in df.schema.fields:
            if f.name in mixed:
                df = df.withColumn(f.name, as_text(Field(column(f.name), f.dataType)))
        aligned.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)
