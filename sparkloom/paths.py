"""Field paths over DataFrame schemas.

A path names a top-level column as it stands (dots included) or, failing that,
descends structs (and maps with text keys) at its dots.  Missing and null are
the same thing here: a field is found when the schema has it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Field(NamedTuple):
    column: Column
    type: T.DataType


def column(name: str) -> Column:
    """A top-level column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def lookup(schema: T.StructType, path: str) -> Field | None:
    if not path or not path.strip():
        return None
    if path in schema.names:
        return Field(column(path), schema[path].dataType)
    parts = path.split(".")
    if "" in parts or parts[0] not in schema.names:
        return None
    found = Field(column(parts[0]), schema[parts[0]].dataType)
    for part in parts[1:]:
        if isinstance(found.type, T.StructType) and part in found.type.names:
            found = Field(found.column.getField(part), found.type[part].dataType)
        elif isinstance(found.type, T.MapType) and isinstance(found.type.keyType, T.StringType):
            found = Field(F.try_element_at(found.column, F.lit(part)), found.type.valueType)
        else:
            return None
    return found


def value_at(df: DataFrame, path: str) -> Column:
    """The field, or null where the schema has none."""
    found = lookup(df.schema, path)
    return found.column if found else F.lit(None)


def _set_in(base: Column | None, kind: T.DataType | None, parts: list[str], value: Column) -> Column:
    if not parts:
        return value
    kept = [(f.name, f.dataType) for f in kind.fields] if isinstance(kind, T.StructType) else []
    inner = dict(kept).get(parts[0])
    child = _set_in(base.getField(parts[0]) if inner is not None else None, inner, parts[1:], value)
    fields = [child.alias(n) if n == parts[0] else base.getField(n).alias(n) for n, _ in kept]
    return F.struct(*fields, *([] if inner is not None else [child.alias(parts[0])]))


def assign(df: DataFrame, path: str, value: Column) -> DataFrame:
    """Writes a field; a dotted path creates structs, and replaces what is no struct on its way."""
    parts = path.split(".")
    if len(parts) == 1:
        return df.withColumn(path, value)
    kind = df.schema[parts[0]].dataType if parts[0] in df.columns else None
    return df.withColumn(parts[0], _set_in(column(parts[0]) if kind is not None else None, kind, parts[1:], value))


def _without(base: Column, kind: T.StructType, parts: list[str]) -> Column | None:
    """The struct without a field; None if nothing is left of it."""
    fields = []
    for f in kind.fields:
        inner: Column | None = base.getField(f.name)
        if f.name == parts[0]:
            inner = _without(inner, f.dataType, parts[1:]) if len(parts) > 1 and isinstance(f.dataType, T.StructType) else (None if len(parts) == 1 else inner)
        if inner is not None:
            fields.append(inner.alias(f.name))
    return F.when(base.isNotNull(), F.struct(*fields)) if fields else None


def remove(df: DataFrame, path: str) -> DataFrame:
    """Drops a field, and the structs that it leaves empty."""
    if path in df.columns:
        return df.drop(column(path))
    parts = path.split(".")
    if len(parts) == 1 or "" in parts or lookup(df.schema, path) is None:
        return df
    kind = df.schema[parts[0]].dataType
    if not isinstance(kind, T.StructType):
        return df
    left = _without(column(parts[0]), kind, parts[1:])
    return df.drop(column(parts[0])) if left is None else df.withColumn(parts[0], left)


def as_text(field: Field) -> Column:
    """A value as text: structs, arrays and maps as JSON."""
    if isinstance(field.type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(field.column, {"ignoreNullFields": "false"})
    return field.column.cast("string")
