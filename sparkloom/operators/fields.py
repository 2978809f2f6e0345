"""Operators that change fields of a record."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.expression import compile_expression, condition
from sparkloom.model import ConfigError, choice, flag, names, number, text
from sparkloom.operators.base import Context, Ports, operator, out, single
from sparkloom.paths import Field, as_text, assign, column, lookup, remove

_REFERENCE = re.compile(r"\$\{([^}]*)\}")


def _top(df: DataFrame, name: str) -> Field | None:
    return Field(column(name), df.schema[name].dataType) if name in df.columns else None


@operator("PUT")
def put(inputs: Ports, config: dict, ctx: Context) -> Ports:
    """Writes a literal, a copy of a field (``${f}`` alone), or a template of fields."""
    df, target, value = single(inputs), text(config, "field"), str(config.get("value", ""))
    whole = _REFERENCE.fullmatch(value)
    if whole:
        found = _top(df, whole[1].strip())
        return out(assign(df, target, found.column if found else F.lit(None)))
    parts: list[Column] = []
    for i, piece in enumerate(_REFERENCE.split(value)):
        found = _top(df, piece.strip()) if i % 2 else None
        parts.append(F.lit(piece) if i % 2 == 0 else F.coalesce(as_text(found), F.lit("null")) if found else F.lit("null"))
    return out(assign(df, target, F.concat(*parts)))


@operator("PRUNE")
def prune(inputs: Ports, config: dict, ctx: Context) -> Ports:
    df = single(inputs)
    for path in names(config, "fields", required=True):
        df = remove(df, path)
    return out(df)


@operator("RENAME")
def rename(inputs: Ports, config: dict, ctx: Context) -> Ports:
    df, mapping = single(inputs), config.get("mapping")
    if not isinstance(mapping, dict) or not mapping:
        raise ConfigError("mapping is required")
    for source, target in mapping.items():
        found = lookup(df.schema, source)
        if found is None:
            continue
        # The value waits in a column of its own while its old place goes.
        held = df.withColumn("_moved", found.column)
        df = assign(remove(held, source), target, F.col("_moved")).drop("_moved")
    return out(df)


@operator("FLATTEN")
def flatten(inputs: Ports, config: dict, ctx: Context) -> Ports:
    df, source = single(inputs), text(config, "sourceField")
    prefix, delimiter = str(config.get("targetPrefix") or ""), str(config.get("delimiter", "_"))
    if not delimiter.strip():
        raise ConfigError("delimiter must not be blank")
    found = lookup(df.schema, source)
    if found is None or not isinstance(found.type, T.StructType):
        return out(df)
    leaves: list[tuple[str, Column]] = []

    def walk(kind: T.StructType, base: Column, path: list[str]) -> None:
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, base.getField(f.name), [*path, f.name])
            else:
                leaves.append((delimiter.join([*path, f.name]), base.getField(f.name)))

    walk(found.type, found.column, [prefix] if prefix else [])
    held = df.select("*", *[c.alias(f"_leaf_{i}") for i, (_, c) in enumerate(leaves)])
    if flag(config, "removeSourceField"):
        held = remove(held, source)
    for i, (name, _) in enumerate(leaves):
        held = assign(held, name, F.col(f"_leaf_{i}"))
    return out(held.drop(*[f"_leaf_{i}" for i in range(len(leaves))]))


@operator("EXPLODE")
def explode(inputs: Ports, config: dict, ctx: Context) -> Ports:
    df, source, target = single(inputs), text(config, "sourceField"), text(config, "targetField")
    keep, found = flag(config, "keepEmpty"), lookup(df.schema, source)
    if found is None:
        return out(df if keep else df.limit(0))
    if not isinstance(found.type, T.ArrayType):
        return out(assign(df, target, found.column))
    items = df.select("*", (F.explode_outer if keep else F.explode)(found.column).alias("_item"))
    return out(assign(items, target, F.col("_item")).drop("_item"))


def cast_to(found: Field, target: str) -> Column:
    """The value in the target type, or null where it is none.  Whole numbers beyond the type's range wrap around."""
    word = F.trim(as_text(found))
    if target == "STRING":
        return as_text(found)
    if target in ("DOUBLE", "FLOAT"):
        return word.try_cast(target.lower())
    if target == "BOOLEAN":
        return F.when(word.isNotNull(), F.lower(word).isin("true", "1"))
    kind, half = ("int", 1 << 31) if target in ("INT", "INTEGER") else ("bigint", 1 << 63)
    big = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    around = lambda x: F.pmod(x + big(half), big(2 * half)) - big(half)
    truncated = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).try_cast("decimal(38,0)")
    # Exponents and numbers beyond the decimal's range go through double.
    whole = F.coalesce(truncated(word.try_cast("decimal(38,18)")), truncated(word.try_cast("double")))
    # Beyond 35 digits the sum would leave the decimal's range; such numbers have no value here.
    return F.when(F.abs(whole) < big(10**35), around(whole)).try_cast(kind)


@operator("CAST")
def cast(inputs: Ports, config: dict, ctx: Context) -> Ports:
    """Casts a field.  What cannot be cast keeps the output field's old value if that has the target type."""
    df, source = single(inputs), text(config, "inputField")
    target = str(config.get("outputField") or source).strip()
    kind = choice(config, "targetType", ("STRING", "INT", "INTEGER", "LONG", "DOUBLE", "FLOAT", "BOOLEAN"), "STRING")
    found = lookup(df.schema, source)
    if found is None:
        return out(df)
    value, old = cast_to(found, kind), lookup(df.schema, target)
    type_ = df.select(value.alias("v")).schema["v"].dataType
    return out(assign(df, target, F.coalesce(value, old.column) if old and old.type == type_ else value))


def _kept(df: DataFrame, target: str, type_: T.DataType) -> Column:
    old = lookup(df.schema, target)
    return old.column.try_cast(type_) if old and not isinstance(old.type, (T.StructType, T.ArrayType, T.MapType)) else (old.column if old and old.type == type_ else F.lit(None).cast(type_))


@operator("CASE_WHEN")
def case_when(inputs: Ports, config: dict, ctx: Context) -> Ports:
    df, target, cases = single(inputs), text(config, "targetField"), config.get("cases")
    if not isinstance(cases, list) or not cases:
        raise ConfigError("cases is required")

    def literal(value: object) -> Column:
        if isinstance(value, (list, dict)):
            return F.from_json(F.lit(json.dumps(value)), F.schema_of_json(F.lit(json.dumps(value))))
        return F.lit(value)

    branches: list[tuple[Column, Column]] = []
    for case in cases:
        test = condition(str(case.get("condition") or case.get("when") or ""), df.schema)
        if case.get("expression"):
            c = compile_expression(str(case["expression"]), df.schema)
            branches.append((test & c.ok, c.value))
        else:
            branches.append((test, literal(case.get("value"))))
    mode = str(config.get("defaultMode") or "").upper()
    rest: Column | None = None
    if mode == "EXPRESSION" or (not mode and config.get("defaultExpression")):
        c = compile_expression(text(config, "defaultExpression"), df.schema)
        rest = F.when(c.ok, c.value).otherwise(F.raise_error(F.lit("the default expression of CASE_WHEN failed")))
    elif mode == "VALUE" or (not mode and "defaultValue" in config):
        rest = literal(config.get("defaultValue"))
    elif mode not in ("", "NONE"):
        raise ConfigError("defaultMode must be one of NONE, VALUE, EXPRESSION")
    types = [df.select(v.alias("v")).schema["v"].dataType for v in [*(b[1] for b in branches), *([rest] if rest is not None else [])]]
    typed = [t for t in types if not isinstance(t, T.NullType)]
    joint = typed[0] if typed and all(t == typed[0] for t in typed) else T.DoubleType() if typed and all(isinstance(t, T.NumericType) for t in typed) else T.StringType()
    chosen = F.when(branches[0][0], branches[0][1].cast(joint))
    for test, value in branches[1:]:
        chosen = chosen.when(test, value.cast(joint))
    return out(assign(df, target, chosen.otherwise(rest.cast(joint) if rest is not None else _kept(df, target, joint))))


@operator("EVAL")
def evaluate(inputs: Ports, config: dict, ctx: Context) -> Ports:
    df, target = single(inputs), text(config, "targetField")
    mode = choice(config, "outputMode", ("OVERWRITE", "WRITE_IF_ABSENT"), "OVERWRITE")
    strategy = choice(config, "errorStrategy", ("KEEP_ORIGINAL", "PUT_NULL", "DISCARD", "FAIL"), "KEEP_ORIGINAL")
    c = compile_expression(text(config, "expression"), df.schema)
    held = df.withColumn("_ok", c.ok).withColumn("_value", c.value)
    if strategy == "DISCARD":
        held = held.where("_ok")
    if strategy == "FAIL":
        held = held.withColumn("_value", F.when(F.col("_ok"), F.col("_value")).otherwise(F.raise_error(F.lit(f"EVAL failed in {ctx.node_id}"))))
    if mode == "WRITE_IF_ABSENT" and lookup(df.schema, target) is not None:
        # The check must run even where nothing is written.
        return out((held.where(F.col("_value").isNotNull() | F.col("_value").isNull()) if strategy == "FAIL" else held).drop("_ok", "_value"))
    type_ = held.schema["_value"].dataType
    else_ = F.lit(None).cast(type_) if strategy == "PUT_NULL" else _kept(df, target, type_)
    value = F.col("_value") if strategy == "FAIL" else F.when(F.col("_ok"), F.col("_value")).otherwise(else_)
    return out(assign(held, target, value).drop("_ok", "_value"))


_DERIVED = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second, "WEEK": F.weekofyear, "QUARTER": F.quarter, "DAY_OF_YEAR": F.dayofyear}


@operator("TIME_DERIVE")
def time_derive(inputs: Ports, config: dict, ctx: Context) -> Ports:
    """Parts and formats of a time; local parts are those of the output zone.

    Instants are computed in UTC, whatever the session's zone.
    """
    df, found = single(inputs), lookup(single(inputs).schema, text(config, "sourceField"))
    form = choice(config, "sourceFormat", ("AUTO", "ISO", "EPOCH_MILLIS", "EPOCH_SECONDS", "PATTERN"), "AUTO")
    strategy = choice(config, "parseErrorStrategy", ("KEEP_ORIGINAL", "SET_NULL", "FAIL"), "KEEP_ORIGINAL")
    source_zone, zone = str(config.get("sourceTimeZone") or "UTC"), str(config.get("outputTimeZone") or "UTC")
    derivations = config.get("derivations") or []
    if not derivations:
        raise ConfigError("derivations is required")
    instant = _instant(found, form, config, source_zone) if found else F.lit(None).cast("timestamp")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), _utc_clock(instant))
    df = df.withColumn("_instant", instant).withColumn("_local", local)
    if strategy == "FAIL":
        df = df.withColumn("_instant", F.coalesce(F.col("_instant"), F.raise_error(F.lit("time cannot be parsed")).cast("timestamp")))
    for d in derivations:
        kind, target = choice(d, "type", (*_DERIVED, "DATE", "DATETIME", "DAY_OF_WEEK", "EPOCH_MILLIS", "EPOCH_SECONDS", "FORMAT")), text(d, "outputField")
        at = F.col("_local")
        if kind in _DERIVED:
            value = _DERIVED[kind](at)
        elif kind == "DATE":
            value = F.date_format(at, "yyyy-MM-dd")
        elif kind == "DATETIME":
            value = F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), r"(?::00)?\.000$", "")
            value = F.when((F.second(at) == 0) | ~value.rlike(r"T\d\d:\d\d$"), value).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"))
        elif kind == "DAY_OF_WEEK":
            value = F.weekday(at) + 1
        elif kind == "FORMAT":
            value = F.date_format(at, text(d, "pattern"))
        else:
            value = F.unix_millis("_instant") if kind == "EPOCH_MILLIS" else F.unix_seconds("_instant")
        if strategy == "KEEP_ORIGINAL":
            type_ = df.select(value.alias("v")).schema["v"].dataType
            value = F.when(F.col("_instant").isNotNull(), value).otherwise(_kept(df, target, type_))
        if strategy == "FAIL":
            value = F.when(F.col("_instant").isNotNull(), value)
        df = assign(df, target, value)
    return out(df.drop("_instant", "_local"))


def _utc_clock(instant: Column) -> Column:
    """The instant's clock time in UTC, as a timestamp without zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def _instant(found: Field, form: str, config: dict, source_zone: str) -> Column:
    if isinstance(found.type, T.TimestampType):
        return found.column
    if isinstance(found.type, T.TimestampNTZType):
        return _from_clock(found.column, source_zone)
    epoch = (lambda v: F.timestamp_seconds(v)) if form == "EPOCH_SECONDS" else (lambda v: F.timestamp_millis(v.cast("bigint")))
    if isinstance(found.type, T.NumericType):
        return epoch(found.column.cast("bigint"))
    word = F.trim(as_text(found))
    count = word.try_cast("bigint")
    if form in ("EPOCH_MILLIS", "EPOCH_SECONDS"):
        return epoch(count)
    if form == "PATTERN":
        return _from_clock(F.try_to_timestamp(word, F.lit(text(config, "sourcePattern"))).cast("timestamp_ntz"), source_zone)
    iso = F.when(word.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(word))
    return F.coalesce(iso, epoch(count))


def _from_clock(clock: Column, zone: str) -> Column:
    """The instant at which clocks in ``zone`` show a time."""
    return F.convert_timezone(F.lit(zone), F.current_timezone(), clock).cast("timestamp")


@operator("MASK_HASH")
def mask_hash(inputs: Ports, config: dict, ctx: Context) -> Ports:
    df, rules = single(inputs), config.get("rules")
    if not isinstance(rules, list) or not rules:
        raise ConfigError("rules is required")
    for rule in rules:
        source = text(rule, "sourceField")
        target = str(rule.get("targetField") or source).strip()
        found = lookup(df.schema, source)
        action = choice(rule, "action", ("MASK", "HASH"))
        if found is None:
            continue
        v = as_text(found)
        if action == "HASH":
            algorithm = str(rule.get("algorithm") or "SHA256").upper().replace("-", "")
            salted = F.concat(F.lit(str(rule.get("salt") or "")), v)
            hashes = {"SHA256": lambda: F.sha2(salted, 256), "SHA512": lambda: F.sha2(salted, 512), "MD5": lambda: F.md5(salted)}
            if algorithm not in hashes:
                raise ConfigError("algorithm must be one of SHA256, SHA512, MD5")
            value = hashes[algorithm]()
        else:
            first, last = number(rule, "keepFirst", 3, 0), number(rule, "keepLast", 4, 0)
            n = F.length(v)
            head = F.least(F.lit(first), n)
            tail = F.least(F.lit(last), n - head)
            value = F.concat(F.substring(v, F.lit(1), head), F.repeat(F.lit(str(rule.get("maskChar") or "*")), n - head - tail), F.right(v, tail))
        old = lookup(df.schema, target)
        df = assign(df, target, F.coalesce(value, as_text(old)) if old else value)
    return out(df)
