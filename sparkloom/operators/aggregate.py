"""Windowed aggregation and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.model import RECORD_HEADERS, RECORD_ID, RECORD_TIME, ConfigError, choice, names, number, text
from sparkloom.operators.base import Context, Ports, operator, order_key, out, single
from sparkloom.operators.joins import _UNITS
from sparkloom.paths import Field, as_text, column, lookup
from sparkloom.storage import stage

FUNCTIONS = ("COUNT", "SUM", "AVG", "MIN", "MAX", "COUNT_DISTINCT", "FIRST_VALUE", "LAST_VALUE", "TOP_N", "COLLECT_LIST", "COLLECT_SET")


def numeric(field: Field) -> Column:
    """The value as a double; null where it is no number."""
    if isinstance(field.type, T.NumericType):
        return field.column.cast("double")
    return F.trim(as_text(field)).try_cast("double")


def event_time(df: DataFrame, config: dict, fallback: bool = True) -> Column:
    """Event time of records: numbers and numeric text count the unit, other text is ISO or ``yyyy-mm-dd hh:mm:ss``."""
    found = lookup(df.schema, str(config.get("eventTimeField") or ""))
    unit = 1000 if str(config.get("eventTimeUnit") or "MILLISECONDS").upper() == "SECONDS" else 1
    own = F.timestamp_millis(F.col(RECORD_TIME)) if RECORD_TIME in df.columns and (fallback or not config.get("eventTimeField")) else F.lit(None).cast("timestamp")
    if found is None:
        return own
    if isinstance(found.type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.coalesce(found.column.cast("timestamp"), own)
    word = F.trim(as_text(found))
    millis = F.timestamp_millis((word.try_cast("double") * unit).cast("bigint"))
    return F.coalesce(millis, F.try_to_timestamp(word), own)


def _ordered(value: Column, order: Column) -> Column:
    """Values in order of arrival, without nulls."""
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(F.array_sort(pairs), lambda p: p["v"])


def _top(field: Field, by: Field, order: Column, limit: int, ascending: bool) -> Column:
    """The first values by a sort value, numbers before text by number; ties in order of arrival."""
    key = F.coalesce(as_text(by), as_text(field))
    number_ = key.try_cast("double")
    entry = F.struct(number_.alias("n"), key.alias("s"), order.alias("o"), field.column.alias("v"))

    def compare(a: Column, b: Column) -> Column:
        both = a["n"].isNotNull() & b["n"].isNotNull()
        less, more = F.when(both, a["n"] < b["n"]).otherwise(a["s"] < b["s"]), F.when(both, a["n"] > b["n"]).otherwise(a["s"] > b["s"])
        sign = 1 if ascending else -1
        return F.when(less, -sign).when(more, sign).when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)

    kept = F.collect_list(F.when(field.column.isNotNull(), entry))
    return F.transform(F.slice(F.array_sort(kept, compare), 1, limit), lambda e: e["v"])


def metric(df: DataFrame, spec: dict, order: Column) -> Column:
    """One aggregation as a Column."""
    function = choice(spec, "function", FUNCTIONS)
    if function == "COUNT":
        return F.count(F.lit(1))
    path = text(spec, "field")
    field = lookup(df.schema, path) or Field(F.lit(None).cast("string"), T.StringType())
    if function in ("SUM", "AVG", "MIN", "MAX"):
        x = numeric(field)
        return {"SUM": lambda: F.coalesce(F.sum(x), F.lit(0.0)), "AVG": lambda: F.avg(x), "MIN": lambda: F.min(x), "MAX": lambda: F.max(x)}[function]()
    if function == "COUNT_DISTINCT":
        return F.size(F.collect_set(field.column)).cast("long") if df.isStreaming else F.count_distinct(field.column)
    if function in ("FIRST_VALUE", "LAST_VALUE"):
        pick = F.min_by if function == "FIRST_VALUE" else F.max_by
        return pick(field.column, F.when(field.column.isNotNull(), order))
    if function == "TOP_N":
        limit = number(spec, "limit", spec.get("topNSize") or 10, 1)
        by = lookup(df.schema, str(spec.get("sortField") or path)) or field
        return _top(field, by, order, limit, choice(spec, "sortDirection", ("ASC", "DESC"), "DESC") == "ASC")
    values = _ordered(field.column, order)
    return values if function == "COLLECT_LIST" else F.array_distinct(values)


def numbered(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """``df`` with ``_n``: the number of a row within its key, from 0, in the given order.

    Rows are sorted by key and order over all partitions; numbers come from row
    positions and the sizes of partitions, so a key of any size is spread.
    """
    keyed = df.withColumn("_key", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))).withColumn("_order", order)
    placed = stage(keyed.repartitionByRange("_key", "_order").sortWithinPartitions("_key", "_order").withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("p")).agg((F.max(within) + 1).alias("n")).orderBy("p").collect()  # one row a partition
    start, upto = [], 0
    for r in sizes:
        start += [F.lit(r["p"]), F.lit(upto)]
        upto += r["n"]
    total = F.element_at(F.create_map(*start), part) + within if start else F.lit(0)
    rows = placed.withColumn("_row", total)
    firsts = rows.groupBy("_key").agg(F.min("_row").alias("_first")).withColumnRenamed("_key", "_of")
    joined = rows.join(firsts, rows["_key"].eqNullSafe(firsts["_of"]))
    return joined.withColumn("_n", F.col("_row") - F.col("_first")).drop("_key", "_order", "_at", "_row", "_first", "_of")


@operator("AGGREGATE")
def aggregate(inputs: Ports, config: dict, ctx: Context) -> Ports:
    df = single(inputs)
    mode = choice(config, "mode", ("GLOBAL", "GROUPED"), "GROUPED" if config.get("groupBy") else "GLOBAL")
    window = choice(config, "windowType", ("TUMBLING_TIME", "SLIDING_TIME", "COUNT"), "TUMBLING_TIME")
    time_mode = choice(config, "timeMode", ("PROCESSING_TIME", "EVENT_TIME"), "PROCESSING_TIME")
    output = choice(config, "outputMode", ("NESTED", "FLAT"), "NESTED")
    groups = names(config, "groupBy", required=True) if mode == "GROUPED" else []
    specs = config.get("aggregations")
    if not isinstance(specs, list) or not specs:
        raise ConfigError("aggregations is required")
    outputs = [text(s, "outputField") for s in specs]
    if len(set(outputs)) < len(outputs):
        raise ConfigError("outputField must be unique")
    order = order_key(df, config)
    metrics = [metric(df, s, order).alias(f"_m{i}") for i, s in enumerate(specs)]
    keys = [(lookup(df.schema, g) or Field(F.lit(None).cast("string"), T.StringType())).column for g in groups]
    named = [k.alias(f"_g{i}") for i, k in enumerate(keys)]
    if window == "COUNT":
        size = number(config, "countWindowSize", 100, 1)
        if df.isStreaming:
            from sparkloom.streaming.stateful import count_window_metrics

            found = count_window_metrics(df, named, size, specs, _window_inputs(df, specs), _metric_types(df, named, specs, config))
        else:
            rows = numbered(df, keys, order)
            found = rows.groupBy(F.floor(F.col("_n") / size).alias("_w"), *named).agg(F.count(F.lit(1)).alias("_rows"), *metrics).where(F.col("_rows") == size)
        about = [F.lit("COUNT").alias("type"), F.lit(size).cast("long").alias("size")]
        flat = [F.lit("COUNT").alias("windowType"), F.lit(size).cast("long").alias("windowSize")]
    else:
        unit = _UNITS[choice(config, "timeUnit", tuple(_UNITS), "SECONDS")]
        size, slide = number(config, "windowSize", 60, 1) * unit, number(config, "windowSlide", 10, 1) * unit
        if window == "SLIDING_TIME" and slide > size:
            raise ConfigError("windowSlide must not exceed windowSize")
        at = event_time(df, config) if time_mode == "EVENT_TIME" else F.current_timestamp()
        timed = df.withColumn("_time", at)
        if df.isStreaming:
            timed = timed.withWatermark("_time", f"{number(config, 'watermarkDelay', 30, 0) * unit} milliseconds")
        w = F.window("_time", f"{size} milliseconds", f"{slide} milliseconds" if window == "SLIDING_TIME" else None)
        found = timed.groupBy(w.alias("_w"), *named).agg(*metrics)
        start, end = F.unix_millis("_w.start"), F.unix_millis("_w.end")
        about = [F.lit(window).alias("type"), F.lit(time_mode).alias("timeMode"), start.alias("start"), end.alias("end")]
        flat = [F.lit(window).alias("windowType"), start.alias(str(config.get("windowStartField") or "windowStart")), end.alias(str(config.get("windowEndField") or "windowEnd"))]
    identity = _identity(ctx.node_id, window, len(groups))
    of_group = [F.col(f"_g{i}").alias(g) for i, g in enumerate(groups)]
    of_metric = [F.col(f"_m{i}").alias(o) for i, o in enumerate(outputs)]
    if output == "FLAT":
        taken = set(outputs)
        return out(found.select(*[c for c, n in zip([*flat, *of_group], [*_flat_names(config, window), *groups], strict=True) if n not in taken], *of_metric, *identity))
    none = F.create_map().cast("map<string,string>")
    return out(found.select(F.struct(*about).alias("window"), (F.struct(*of_group) if groups else none).alias("group"), F.struct(*of_metric).alias("metrics"), *identity))


def _identity(node: str, window: str, groups: int) -> list[Column]:
    """Id, time and headers of a window's record; windows of a time have an id that a second run repeats."""
    if window == "COUNT":
        id_ = F.concat(F.lit(f"aggregate:{node}:count:"), F.expr("uuid()"))
    else:
        group = F.base64(F.to_json(F.struct(*[F.col(f"_g{i}") for i in range(groups)]), {"ignoreNullFields": "false"}).cast("binary")) if groups else F.lit("global")
        id_ = F.concat_ws(":", F.lit(f"aggregate:{node}"), F.unix_millis("_w.start").cast("string"), F.unix_millis("_w.end").cast("string"), group)
    headers = F.create_map(*[F.lit(x) for pair in (("operator", "AGGREGATE"), ("nodeId", node), ("windowType", window)) for x in pair])
    return [id_.alias(RECORD_ID), F.unix_millis(F.current_timestamp()).alias(RECORD_TIME), headers.alias(RECORD_HEADERS)]


def _window_inputs(df: DataFrame, specs: list[dict]) -> list[Column]:
    """For each aggregation the value it reads, and what TOP_N sorts by: all that the state of a count window keeps."""
    out = []
    for i, spec in enumerate(specs):
        path = str(spec.get("field") or "")
        field = lookup(df.schema, path) or Field(F.lit(None).cast("string"), T.StringType())
        numbers = str(spec["function"]).upper() in ("SUM", "AVG", "MIN", "MAX")
        by = lookup(df.schema, str(spec.get("sortField") or path)) or field
        out += [(numeric(field) if numbers else field.column).alias(f"_v{i}"), F.coalesce(as_text(by), as_text(field)).alias(f"_s{i}")]
    return out


def _metric_types(df: DataFrame, named: list[Column], specs: list[dict], config: dict) -> T.StructType:
    """Groups and metrics as a batch of such records has them."""
    empty = df.sparkSession.createDataFrame([], df.schema)
    metrics = [metric(empty, s, order_key(empty, config)).alias(f"_m{i}") for i, s in enumerate(specs)]
    return empty.groupBy(*named).agg(*metrics).schema


def _flat_names(config: dict, window: str) -> list[str]:
    if window == "COUNT":
        return ["windowType", "windowSize"]
    return ["windowType", str(config.get("windowStartField") or "windowStart"), str(config.get("windowEndField") or "windowEnd")]


@operator("DEDUPLICATE")
def deduplicate(inputs: Ports, config: dict, ctx: Context) -> Ports:
    """One record a key (and event-time window).

    A batch is one processing-time span, so a TTL never ends in it; streams go
    through ``sparkloom.streaming`` where Spark has no built-in form.
    """
    df, paths = single(inputs), names(config, "keyFields", required=True)
    mode = choice(config, "timeMode", ("PROCESSING_TIME", "EVENT_TIME"), "PROCESSING_TIME")
    keep = choice(config, "keepStrategy", ("FIRST", "LAST", "EVENT_TIME_LATEST"), "FIRST")
    if mode == "PROCESSING_TIME" and keep == "EVENT_TIME_LATEST":
        raise ConfigError("EVENT_TIME_LATEST needs timeMode EVENT_TIME")
    keys = [(lookup(df.schema, p) or Field(F.lit(None), T.NullType())).column for p in paths]
    if mode == "PROCESSING_TIME":
        ttl = number(config, "ttlSeconds", None, 1)
        if df.isStreaming:
            from sparkloom.streaming.stateful import deduplicate_stream

            return out(deduplicate_stream(df, keys, ttl, keep))
        groups, rows = [k.alias(f"_k{i}") for i, k in enumerate(keys)], df
    else:
        size = number(config, "windowSeconds", None, 1)
        rows = df.withColumn("_time", event_time(df, config, fallback=False)).where(F.col("_time").isNotNull())
        if df.isStreaming:
            rows = rows.withWatermark("_time", f"{number(config, 'watermarkDelaySeconds', 0, 0)} seconds")
        groups = [F.window("_time", f"{size} seconds").alias("_w"), *[k.alias(f"_k{i}") for i, k in enumerate(keys)]]
    order = order_key(df, config)
    whole = F.struct(*[column(c) for c in df.columns])
    if keep == "EVENT_TIME_LATEST":
        # Of equal latest times the first arrival wins.
        latest = rows.groupBy(*groups).agg(F.min_by(whole, F.struct(-F.unix_micros("_time"), order)).alias("_row"))
    else:
        latest = rows.groupBy(*groups).agg((F.min_by if keep == "FIRST" else F.max_by)(whole, order).alias("_row"))
    return out(latest.select("_row.*"))

