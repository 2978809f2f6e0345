"""Operators that deal records to ports: filter, route, data quality."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.expression import condition
from sparkloom.model import DEFAULT_OUT, ConfigError, choice, flag, names, text
from sparkloom.operators.base import Context, Ports, operator, single
from sparkloom.paths import as_text, assign, lookup


@operator("FILTER")
def filter_(inputs: Ports, config: dict, ctx: Context) -> Ports:
    """True records on port ``true``; false, null and failed ones on ``false``."""
    df = single(inputs)
    test = condition(text(config, "condition"), df.schema)
    return {"true": df.where(test), "false": df.where(~test)}


@operator("ROUTE")
def route(inputs: Ports, config: dict, ctx: Context) -> Ports:
    df, routes = single(inputs), config.get("routes")
    if not isinstance(routes, list) or not routes:
        raise ConfigError("routes is required")
    mode = choice(config, "matchMode", ("FIRST_MATCH", "ALL_MATCHES"), "FIRST_MATCH")
    ports = [text(r, "portId") for r in routes]
    if len(set(ports)) < len(ports) or not all(re.fullmatch(r"[A-Za-z0-9_-]+", p) for p in ports):
        raise ConfigError("portId must be unique and made of letters, digits, _ and -")
    tests = [condition(text(r, "condition"), df.schema) for r in routes]
    out: Ports = {}
    for i, (port, test) in enumerate(zip(ports, tests, strict=True)):
        earlier = tests[:i] if mode == "FIRST_MATCH" else []
        out[port] = df.where(reduce(lambda a, b: a & ~b, earlier, test))
    if flag(config, "includeUnmatched", True):
        out[str(config.get("unmatchedPort") or "unmatched")] = df.where(~reduce(lambda a, b: a | b, tests))
    return out


def _violations(df: DataFrame, rule: dict) -> list[Column]:
    """For each message of a rule a column: the message where it is violated, else null."""
    name, kind = text(rule, "field"), choice(rule, "ruleType", ("NOT_NULL", "TYPE", "RANGE", "LENGTH", "ENUM", "REGEX"))
    found, custom = lookup(df.schema, name), rule.get("customMessage") or rule.get("message")
    say = lambda test, message: F.when(test, F.lit(str(custom) if custom else f"{name} {message}"))
    if found is None:
        return [say(F.lit(True), "is required")] if kind == "NOT_NULL" else []
    word = as_text(found)
    blank = found.column.isNull() | (F.trim(word) == "" if isinstance(found.type, T.StringType) else F.lit(False))
    if kind == "NOT_NULL":
        return [say(blank, "is required")]
    value = F.trim(word).try_cast("double")
    if kind == "TYPE":
        wanted = choice(rule, "expectedType" if rule.get("expectedType") else "type", ("STRING", "NUMBER", "DOUBLE", "INTEGER", "LONG", "BOOLEAN", "ARRAY", "OBJECT"))
        right = {
            "STRING": lambda: F.lit(isinstance(found.type, T.StringType)),
            "BOOLEAN": lambda: F.lit(True) if isinstance(found.type, T.BooleanType) else F.lower(F.trim(word)).isin("true", "false") if isinstance(found.type, T.StringType) else F.lit(False),
            "ARRAY": lambda: F.lit(isinstance(found.type, T.ArrayType)),
            "OBJECT": lambda: F.lit(isinstance(found.type, (T.StructType, T.MapType))),
            "INTEGER": lambda: F.coalesce(F.abs(value - F.rint(value)) < 1e-7, F.lit(False)),
        }
        right |= {"LONG": right["INTEGER"], "NUMBER": value.isNotNull, "DOUBLE": value.isNotNull}
        return [say(~blank & ~right[wanted](), f"must be {wanted}")]
    if kind == "RANGE":
        if rule.get("min") is None and rule.get("max") is None:
            raise ConfigError("RANGE needs min or max")
        out = [say(~blank & value.isNull(), "must be numeric")]
        if rule.get("min") is not None:
            out.append(say(~blank & (value < float(rule["min"])), f"must be >= {rule['min']}"))
        if rule.get("max") is not None:
            out.append(say(~blank & (value > float(rule["max"])), f"must be <= {rule['max']}"))
        return out
    if kind == "LENGTH":
        out = []
        if rule.get("minLength") is not None:
            out.append(say(~blank & (F.length(word) < int(rule["minLength"])), f"length must be >= {rule['minLength']}"))
        if rule.get("maxLength") is not None:
            out.append(say(~blank & (F.length(word) > int(rule["maxLength"])), f"length must be <= {rule['maxLength']}"))
        if not out:
            raise ConfigError("LENGTH needs minLength or maxLength")
        return out
    if kind == "ENUM":
        return [say(~blank & ~word.isin(*names(rule, "enumValues", required=True)), "is not an allowed value")]
    pattern = text(rule, "pattern")
    return [say(~blank & ~word.rlike(rf"\A(?:{pattern})\z"), "does not match the pattern")]


@operator("DATA_QUALITY")
def data_quality(inputs: Ports, config: dict, ctx: Context) -> Ports:
    df, rules = single(inputs), config.get("rules")
    if not isinstance(rules, list) or not rules:
        raise ConfigError("rules is required")
    mode = choice(config, "mode", ("DIRTY_PORT", "MARK_ERROR", "DISCARD", "FAIL"), "DIRTY_PORT")
    target = str(config.get("errorField") or "_quality_errors")
    messages = [m for r in rules for m in _violations(df, r)]
    errors = F.filter(F.array(*messages), lambda m: m.isNotNull()) if messages else F.array().cast("array<string>")
    held = df.withColumn("_errors", errors)
    clean = held.where(F.size("_errors") == 0).drop("_errors")
    if mode == "DISCARD":
        return {DEFAULT_OUT: clean}
    if mode == "FAIL":
        failed = F.raise_error(F.concat(F.lit("data quality: "), F.concat_ws("; ", "_errors"))).cast("boolean")
        return {DEFAULT_OUT: held.where(F.when(F.size("_errors") == 0, True).otherwise(failed)).drop("_errors")}
    if mode == "MARK_ERROR":
        return {DEFAULT_OUT: assign(held, target, F.when(F.size("_errors") > 0, F.col("_errors"))).drop("_errors")}
    dirty = held.where(F.size("_errors") > 0)
    return {DEFAULT_OUT: clean, "dirty": assign(dirty, target, F.col("_errors")).drop("_errors")}
