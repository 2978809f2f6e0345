"""Joins: static lookups, and the interval join of two streams."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.model import DEFAULT_OUT, RECORD_TIME, RESERVED, ConfigError, choice, flag, number, text
from sparkloom.operators.base import Context, Ports, operator, out, single
from sparkloom.paths import as_text, assign, column, lookup, value_at

#: Entries up to which a lookup is a literal map in the plan, and up to which it is broadcast.
MAP_ENTRIES, BROADCAST_ENTRIES = 200, 100_000


def _entries(config: dict) -> list[dict]:
    entries = config.get("entries")
    if isinstance(entries, str):
        entries = json.loads(entries)
    if not isinstance(entries, list) or not entries:
        raise ConfigError("entries is required")
    keys = [str(e.get("key") if e.get("key") is not None else "").strip() for e in entries]
    if "" in keys or len(set(keys)) < len(keys):
        raise ConfigError("keys of entries must be unique and not blank")
    return [{**e, "key": k} for e, k in zip(entries, keys, strict=True)]


def _looked_up(df: DataFrame, source: str, keys: list[str], values: list[str], schema: str) -> DataFrame:
    """``df`` with ``_hit`` (a struct ``v`` of the schema, null if there is none); values are JSON text."""
    found = lookup(df.schema, source)
    key = as_text(found) if found else F.lit(None).cast("string")
    parse = lambda c: F.from_json(c, f"struct<v:{schema}>")
    if len(keys) <= MAP_ENTRIES:
        table = F.create_map(*[F.lit(x) for pair in zip(keys, values, strict=True) for x in pair])
        return df.withColumn("_hit", parse(F.try_element_at(table, key)))
    side = df.sparkSession.createDataFrame(list(zip(keys, values, strict=True)), "_key string, _json string")
    side = side.select("_key", parse(F.col("_json")).alias("_hit"))
    return df.withColumn("_key", key).join(F.broadcast(side) if len(keys) <= BROADCAST_ENTRIES else side, "_key", "left").drop("_key")


def _settle(df: DataFrame, target: str, config: dict, node: str) -> DataFrame:
    """Writes the hit, and treats misses as ``missingStrategy`` says."""
    strategy = choice(config, "missingStrategy", ("KEEP_ORIGINAL", "PUT_NULL", "DISCARD", "FAIL"), "KEEP_ORIGINAL")
    hit = F.col("_hit").isNotNull()
    if strategy == "DISCARD":
        df = df.where(hit)
    if strategy == "FAIL":
        df = df.where(F.when(hit, True).otherwise(F.raise_error(F.lit(f"no lookup entry in {node}")).cast("boolean")))
    old = lookup(df.drop("_hit").schema, target)
    if old is not None and not flag(config, "overwriteTargetField", True):
        return df.drop("_hit")
    value = F.col("_hit.v")
    if old is not None and strategy == "KEEP_ORIGINAL":
        same = old.type == df.select(value.alias("v")).schema["v"].dataType
        value = F.when(hit, value).otherwise(old.column if same else as_text(old).cast("string") if isinstance(df.select(value.alias("v")).schema["v"].dataType, T.StringType) else F.lit(None))
    return assign(df, target, value).drop("_hit")


@operator("LOOKUP_ENRICH")
def lookup_enrich(inputs: Ports, config: dict, ctx: Context) -> Ports:
    """One value for a key.  Entries of several value types give one text column."""
    df, entries = single(inputs), _entries(config)
    target = text(config, "targetField")
    kinds = {str(e.get("valueType") or "STRING").upper() for e in entries}
    if not kinds <= {"STRING", "NUMBER", "BOOLEAN", "JSON"}:
        raise ConfigError("valueType must be one of STRING, NUMBER, BOOLEAN, JSON")

    def typed(e: dict) -> object:
        kind, value = str(e.get("valueType") or "STRING").upper(), e.get("value")
        if kind == "NUMBER":
            x = float(value)
            return int(x) if x.is_integer() and "." not in str(value) else x
        if kind == "BOOLEAN":
            return str(value).strip().lower() == "true"
        return (json.loads(value) if isinstance(value, str) else value) if kind == "JSON" else str(value)

    values = [typed(e) for e in entries]
    if len(kinds) > 1:
        schema, values = "string", [v if isinstance(v, str) else json.dumps(v) for v in values]
    elif kinds == {"NUMBER"}:
        schema = "bigint" if all(isinstance(v, int) for v in values) else "double"
    else:
        schema = {"STRING": "string", "BOOLEAN": "boolean"}.get(*kinds) or _json_type(df, values)
    hits = _looked_up(df, text(config, "sourceField"), [e["key"] for e in entries], [json.dumps({"v": v}) for v in values], schema)
    return out(_settle(hits, target, config, ctx.node_id))


def _json_type(df: DataFrame, values: list) -> str:
    """One type for JSON values, from all of them together."""
    found = df.sparkSession.range(1).select(F.schema_of_json(F.lit(json.dumps(values)))).collect()[0][0]
    return found[len("ARRAY<") : -1] if found.startswith("ARRAY<") else "string"


@operator("LOOKUP_JOIN")
def lookup_join(inputs: Ports, config: dict, ctx: Context) -> Ports:
    """Joins a static dimension; the match is a struct at the target."""
    df, entries = single(inputs), _entries(config)
    kind = choice(config, "joinType", ("LEFT", "INNER"), "LEFT")
    rows = [e.get("value") if isinstance(e.get("value"), dict) else e.get("fields") or {k: v for k, v in e.items() if k != "key"} for e in entries]
    hits = _looked_up(df, text(config, "sourceField"), [e["key"] for e in entries], [json.dumps({"v": r}) for r in rows], _json_type(df, rows))
    if kind == "INNER":
        return out(_settle(hits.where(F.col("_hit").isNotNull()), text(config, "targetField"), config, ctx.node_id))
    strategy = str(config.get("missingStrategy") or "KEEP_ORIGINAL")
    return out(_settle(hits, text(config, "targetField"), {**config, "missingStrategy": strategy}, ctx.node_id))


_UNITS = {"MILLISECONDS": 1, "SECONDS": 1000, "MINUTES": 60_000, "HOURS": 3_600_000}


def _stream_time(df: DataFrame, mode: str, path: object) -> Column:
    """Event time of the join as a timestamp; records without one count as arriving now."""
    found = lookup(df.schema, str(path)) if path else None
    if found is not None:
        if isinstance(found.type, (T.TimestampType, T.TimestampNTZType)):
            return found.column.cast("timestamp")
        return F.timestamp_millis(found.column.cast("bigint"))
    if mode == "EVENT_TIME" and RECORD_TIME in df.columns:
        return F.timestamp_millis(F.col(RECORD_TIME))
    return F.current_timestamp()


@operator("STREAM_JOIN")
def stream_join(inputs: Ports, config: dict, ctx: Context) -> Ports:
    """Pairs with equal keys (as text) and ``left - before <= right <= left + after``.

    In batch both sides are dealt to time buckets, so a hot key is spread over its
    time; in a stream watermarks bound the state.
    """
    left, right = inputs["left"], inputs["right"]
    target = text(config, "targetField")
    kind = choice(config, "joinType", ("LEFT", "INNER"), "LEFT")
    mode = choice(config, "timeMode", ("PROCESSING_TIME", "EVENT_TIME"), "PROCESSING_TIME")
    unit = _UNITS[choice(config, "timeUnit", tuple(_UNITS), "SECONDS")]
    before, after = (number(config, k, 0, 0) * unit for k in ("windowBefore", "windowAfter"))
    if not before + after:
        raise ConfigError("windowBefore and windowAfter must not both be 0")
    delay = number(config, "watermarkDelay", 30, 0) * unit
    key = lambda df, path: F.nullif(F.trim(value_at(df, path).cast("string")), F.lit(""))
    fields = [c for c in right.columns if c not in RESERVED]
    l = left.withColumn("_lk", key(left, text(config, "leftKeyField"))).withColumn("_lt", _stream_time(left, mode, config.get("leftTimeField")))
    r = right.select(key(right, text(config, "rightKeyField")).alias("_rk"), _stream_time(right, mode, config.get("rightTimeField")).alias("_rt"), F.struct(*[column(c) for c in fields]).alias("_right"))
    r = r.where(F.col("_rk").isNotNull())
    near = (F.col("_rt") >= F.col("_lt") - F.expr(f"INTERVAL {before} MILLISECONDS")) & (F.col("_rt") <= F.col("_lt") + F.expr(f"INTERVAL {after} MILLISECONDS"))
    equal = F.col("_lk") == F.col("_rk")
    if left.isStreaming or right.isStreaming:
        l, r = l.withWatermark("_lt", f"{delay} milliseconds"), r.withWatermark("_rt", f"{delay} milliseconds")
        pairs = l.join(r, equal & near, "inner" if kind == "INNER" else "leftOuter")
    else:
        # A left row is in one bucket of time, and a right row in all buckets (two at most) whose left rows it may meet.
        size, millis = before + after, lambda c: F.unix_millis(c)
        l = l.withColumn("_lb", F.floor(millis("_lt") / size))
        r = r.where(F.col("_rt").isNotNull()).withColumn("_rb", F.explode(F.sequence(F.floor((millis("_rt") - after) / size), F.floor((millis("_rt") + before) / size))))
        pairs = l.join(r, equal & (F.col("_lb") == F.col("_rb")) & near, "inner" if kind == "INNER" else "left").drop("_lb", "_rb")
    old = lookup(left.schema, target)
    if RECORD_TIME in left.columns:
        pairs = pairs.withColumn(RECORD_TIME, F.greatest(F.col(RECORD_TIME), F.unix_millis("_rt")))
    if old is None or flag(config, "overwriteTargetField"):
        value = F.col("_right")
        if old is not None and str(config.get("missingStrategy") or "KEEP_ORIGINAL").upper() == "KEEP_ORIGINAL" and old.type == pairs.schema["_right"].dataType:
            value = F.coalesce(value, old.column)
        pairs = assign(pairs, target, value)
    return {DEFAULT_OUT: pairs.drop("_lk", "_lt", "_rk", "_rt", "_right")}
