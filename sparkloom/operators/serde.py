"""Operators that parse and write text inside a field: deserialize, serialize, grok."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.grok import captures, expand
from sparkloom.model import MESSAGE, ConfigError, choice, names, text
from sparkloom.operators.base import Context, Ports, operator, out, single
from sparkloom.paths import Field, as_text, assign, column, lookup


def json_schema(df: DataFrame, source: Column, config: dict) -> T.DataType | str:
    """The declared schema of JSON text, else one inferred from the rows (batch) or the samples."""
    if config.get("schema"):
        return config["schema"]
    samples = config.get("schemaSamples")
    if samples:
        return df.sparkSession.range(1).select(F.schema_of_json(F.lit(samples[0])).alias("s")).collect()[0]["s"]
    if df.isStreaming:
        raise ConfigError("parsing JSON in a stream needs a schema or schemaSamples")
    return _inferred(df, source)


def _is_object(source: Column) -> Column:
    return F.try_parse_json(source).isNotNull() & F.ltrim(source).startswith("{")


def _inferred(df: DataFrame, source: Column) -> str:
    """One pass in which every row's schema is merged."""
    kind = df.select(F.schema_of_variant_agg(F.try_parse_json(F.when(_is_object(source), source))).alias("s")).collect()[0]["s"]
    return re.sub(r"\bOBJECT<", "STRUCT<", kind) if kind and kind.startswith("OBJECT<") else "STRUCT<>"


@operator("DESERIALIZE")
def deserialize(inputs: Ports, config: dict, ctx: Context) -> Ports:
    df, source, target = single(inputs), text(config, "field"), text(config, "targetField")
    form = choice(config, "format", ("JSON", "KV", "CSV", "XML"), "JSON")
    if source not in df.columns or not isinstance(df.schema[source].dataType, T.StringType):
        return out(df)
    raw, wanted = column(source), names(config, "fieldNames")
    delimiter = str(config.get("delimiter") or ",")
    if form == "JSON":
        schema = json_schema(df, raw, config)
        if schema == "STRUCT<>":
            return out(df)
        value = F.when(_is_object(raw), F.from_json(raw, schema))
    elif form == "CSV":
        if not wanted:
            raise ConfigError("fieldNames is required")
        parts = F.split(raw, re.escape(delimiter), -1)
        value = F.when(F.size(parts) == len(wanted), F.struct(*[F.trim(parts[i]).alias(n) for i, n in enumerate(wanted)]))
    elif form == "KV":
        pair = F.when(raw.contains("&"), F.lit("&")).otherwise(F.lit(delimiter))
        pairs = F.transform(F.split(raw, F.concat(F.lit("\\Q"), pair, F.lit("\\E")), -1), lambda p: F.split(p, "=", 2))
        good = F.forall(pairs, lambda p: (F.size(p) == 2) & (F.trim(p[0]) != "") & (F.trim(F.try_element_at(p, F.lit(2))) != ""))
        entries = F.transform(pairs, lambda p: F.struct(F.trim(p[0]).alias("k"), F.trim(F.try_element_at(p, F.lit(2))).alias("v")))
        last = lambda name: F.try_element_at(F.filter(entries, lambda e: e["k"] == name), F.lit(-1))["v"]
        value = F.when(good, F.struct(*[last(n).alias(n) for n in wanted]) if wanted else F.map_from_entries(F.transform(F.array_distinct(F.transform(entries, lambda e: e["k"])), lambda k: F.struct(k, F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]))))
    else:
        flat = raw.rlike(r"(?s)\A\s*<([A-Za-z_][\w.-]*)>\s*(?:<([A-Za-z_][\w.-]*)>[^<]*</\2>\s*)*</\1>\s*\z")
        tags = F.regexp_extract_all(raw, F.lit(r"<([A-Za-z_][\w.-]*)>[^<]*</\1>"), F.lit(1))
        texts = F.regexp_extract_all(raw, F.lit(r"<([A-Za-z_][\w.-]*)>([^<]*)</\1>"), F.lit(2))
        plain = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
        entries = F.arrays_zip(tags.alias("k"), F.transform(texts, plain).alias("v"))
        at = lambda name: F.try_element_at(F.filter(entries, lambda e: e["k"] == name), F.lit(-1))["v"]
        value = F.when(flat & (F.size(tags) > 0), F.struct(*[at(n).alias(n) for n in wanted]) if wanted else F.map_from_arrays(F.array_distinct(tags), F.transform(F.array_distinct(tags), lambda t: F.element_at(F.filter(entries, lambda e: e["k"] == t), -1)["v"])))
    return out(assign(df, target, value))


def _escape(word: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        word = F.replace(word, F.lit(raw), F.lit(entity))
    return word


@operator("SERIALIZE")
def serialize(inputs: Ports, config: dict, ctx: Context) -> Ports:
    df, target = single(inputs), text(config, "targetField")
    form, sources = choice(config, "format", ("JSON", "KV", "CSV", "XML"), "JSON"), names(config, "sourceFields", required=True)
    delimiter = str(config.get("delimiter") or ",")
    fields = [(n, Field(column(n), df.schema[n].dataType)) for n in sources if n in df.columns]
    if not fields:
        return out(df)
    if form == "JSON":
        return out(assign(df, target, F.to_json(F.struct(*[f.column.alias(n) for n, f in fields]), {"ignoreNullFields": "false"})))
    root = "root"
    if len(sources) == 1 and isinstance(fields[0][1].type, T.StructType):
        root, base = fields[0]
        fields = [(f.name, Field(base.column.getField(f.name), f.dataType)) for f in base.type.fields]
    word = lambda f: F.coalesce(as_text(f), F.lit("null"))
    if form == "KV":
        value = F.concat_ws("&", *[F.concat(F.lit(f"{n}="), word(f)) for n, f in fields])
    elif form == "CSV":
        value = F.concat_ws(delimiter, *[word(f) for _, f in fields])
    else:
        value = F.concat(F.lit(f"<{root}>"), *[F.concat(F.lit(f"<{n}>"), _escape(word(f)), F.lit(f"</{n}>")) for n, f in fields], F.lit(f"</{root}>"))
    return out(assign(df, target, value))


@operator("GROK")
def grok(inputs: Ports, config: dict, ctx: Context) -> Ports:
    """Captures of the first match, as strings below ``outputField``; no match changes nothing."""
    df, container = single(inputs), text(config, "outputField")
    found = lookup(df.schema, str(config.get("inputField") or MESSAGE))
    pattern = text(config, "pattern")
    regex, groups = expand(pattern) if "%{" in pattern else (pattern, captures(pattern))
    if not groups:
        raise ConfigError("the pattern has no named group")
    if found is None:
        return out(df)
    word = as_text(found)
    matched = word.rlike(regex)
    for name, index in groups:
        path = f"{container}.{name}"
        old = lookup(df.schema, path)
        # An optional group that took no part gives an empty string in Spark; it counts as no capture.
        value = F.when(matched, F.nullif(F.regexp_extract(word, regex, index), F.lit("")))
        df = assign(df, path, F.coalesce(value, as_text(old)) if old else value)
    return out(df)
