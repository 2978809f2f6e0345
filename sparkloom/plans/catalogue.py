"""Queries over the driver's tables, one or more for each pipeline operator, and their SQL.

A query is a pipeline's middle: the operators are applied to whole tables, and
structs and arrays are flattened at the end so that results can be compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.model import DEFAULT_IN, DEFAULT_OUT, RESERVED
from sparkloom.operators import REGISTRY, Context
from sparkloom.plans.planner import union
from sparkloom.sinks import files as write_files
from sparkloom.sources import files as read_files
from sparkloom.storage import shared_folder
from sparkloom.streaming.stateful import stateful_streams

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apply(df: DataFrame | dict[str, DataFrame], operator: str, config: dict[str, Any], port: str = DEFAULT_OUT, **functions: Callable) -> DataFrame:
    inputs = df if isinstance(df, dict) else {DEFAULT_IN: df}
    return REGISTRY[operator](inputs, config, Context(operator.lower(), functions))[port]


@query("SELECT event_id, event_type || '-' || user_id AS tag, event_type AS kind, 'fixed' AS label FROM events")
def put_template(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events")
    for field, value in (("tag", "${event_type}-${user_id}"), ("kind", "${event_type}"), ("label", "fixed")):
        df = apply(df, "PUT", {"field": field, "value": value})
    return df.select("event_id", "tag", "kind", "label")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def prune_orders(spark: SparkSession, sf: str) -> DataFrame:
    return apply(table(spark, sf, "orders"), "PRUNE", {"fields": ["o_orderdate", "o_orderpriority"]})


@query("SELECT o_orderkey AS id, o_custkey, o_orderstatus AS status, o_totalprice FROM orders")
def rename_orders(spark: SparkSession, sf: str) -> DataFrame:
    df = apply(table(spark, sf, "orders"), "RENAME", {"mapping": {"o_orderkey": "id", "o_orderstatus": "status"}})
    return df.select("id", "o_custkey", "status", "o_totalprice")


_LINE = "l_orderkey, l_linenumber, l_quantity, l_returnflag"


@query(f"SELECT {_LINE} FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'")
def filter_true(spark: SparkSession, sf: str) -> DataFrame:
    return apply(table(spark, sf, "lineitem"), "FILTER", {"condition": "l_quantity > 25 and l_returnflag == 'R'"}, "true").select(*_LINE.split(", "))


@query(f"SELECT {_LINE} FROM lineitem WHERE coalesce(NOT (l_quantity > 25 AND l_returnflag = 'R'), true)")
def filter_false(spark: SparkSession, sf: str) -> DataFrame:
    return apply(table(spark, sf, "lineitem"), "FILTER", {"condition": "l_quantity > 25 and l_returnflag == 'R'"}, "false").select(*_LINE.split(", "))


_ROUTES = [{"portId": "large", "condition": "o_totalprice >= 100000"}, {"portId": "open", "condition": "o_orderstatus == 'O'"}]


def _routed(spark: SparkSession, sf: str, mode: str, ports: tuple[str, ...]) -> DataFrame:
    routes = REGISTRY["ROUTE"]({DEFAULT_IN: table(spark, sf, "orders")}, {"routes": _ROUTES, "matchMode": mode}, Context("route"))
    return union([routes[p].select("o_orderkey", F.lit(p).alias("port")) for p in ports])


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 100000 THEN 'large' ELSE 'open' END AS port FROM orders WHERE o_totalprice >= 100000 OR o_orderstatus = 'O'")
def route_first(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf, "FIRST_MATCH", ("large", "open"))


@query("SELECT o_orderkey, 'large' AS port FROM orders WHERE o_totalprice >= 100000 UNION ALL SELECT o_orderkey, 'open' FROM orders WHERE o_orderstatus = 'O'")
def route_all(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf, "ALL_MATCHES", ("large", "open"))


@query("SELECT o_orderkey, 'unmatched' AS port FROM orders WHERE NOT (o_totalprice >= 100000 OR o_orderstatus = 'O')")
def route_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf, "FIRST_MATCH", ("unmatched",))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 200000 AND o_orderstatus = 'F' THEN 'large_done' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'other' END AS order_class FROM orders")
def case_when_orders(spark: SparkSession, sf: str) -> DataFrame:
    cases = [{"condition": "o_totalprice >= 200000 and o_orderstatus == 'F'", "value": "large_done"}, {"condition": "o_orderstatus == 'F'", "value": "done"}]
    return apply(table(spark, sf, "orders"), "CASE_WHEN", {"targetField": "order_class", "cases": cases, "defaultMode": "VALUE", "defaultValue": "other"}).select("o_orderkey", "order_class")


@query("SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS whole FROM orders")
def cast_int_truncate(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").withColumn("price", F.col("o_totalprice").cast("string"))
    return apply(df, "CAST", {"inputField": "price", "outputField": "whole", "targetType": "LONG"}).select("o_orderkey", "whole")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem")
def eval_revenue(spark: SparkSession, sf: str) -> DataFrame:
    df = apply(table(spark, sf, "lineitem"), "EVAL", {"targetField": "revenue", "expression": "l_extendedprice * (1 - l_discount)"})
    return df.select("l_orderkey", "l_linenumber", F.round("revenue", 4).alias("revenue"))


@query("SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN 100 // (user_id % 3) END AS ratio FROM events")
def eval_put_null(spark: SparkSession, sf: str) -> DataFrame:
    return apply(table(spark, sf, "events"), "EVAL", {"targetField": "ratio", "expression": "100 / (user_id % 3)", "errorStrategy": "PUT_NULL"}).select("event_id", "ratio")


_DERIVE = [("DATE", "d"), ("YEAR", "y"), ("MONTH", "m"), ("DAY", "dd"), ("HOUR", "h"), ("MINUTE", "mi"), ("SECOND", "s"), ("WEEK", "w"), ("QUARTER", "q"), ("DAY_OF_WEEK", "dow"), ("DAY_OF_YEAR", "doy"), ("EPOCH_MILLIS", "ms"), ("EPOCH_SECONDS", "es")]


@query(
    "SELECT event_id, strftime(ts, '%Y-%m-%d') AS d, year(ts)::INT AS y, month(ts)::INT AS m, day(ts)::INT AS dd, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s, week(ts)::INT AS w, quarter(ts)::INT AS q,"
    " isodow(ts)::INT AS dow, dayofyear(ts)::INT AS doy, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 AS es, strftime(ts, '%Y%m%d%H') AS f FROM events"
)
def time_derive_events(spark: SparkSession, sf: str) -> DataFrame:
    derivations = [{"type": t, "outputField": f} for t, f in _DERIVE] + [{"type": "FORMAT", "pattern": "yyyyMMddHH", "outputField": "f"}]
    df = apply(table(spark, sf, "events"), "TIME_DERIVE", {"sourceField": "ts", "derivations": derivations})
    return df.select("event_id", *[f for _, f in _DERIVE], "f")


@query("SELECT c_custkey, left(c_name, 3) || repeat('*', length(c_name) - 7) || right(c_name, 4) AS masked FROM customer")
def mask_customer(spark: SparkSession, sf: str) -> DataFrame:
    return apply(table(spark, sf, "customer"), "MASK_HASH", {"rules": [{"sourceField": "c_name", "targetField": "masked", "action": "MASK"}]}).select("c_custkey", "masked")


@query("SELECT c_custkey, sha256('salt-' || c_name) AS h256, md5(c_name) AS h5 FROM customer")
def hash_customer(spark: SparkSession, sf: str) -> DataFrame:
    rules = [{"sourceField": "c_name", "targetField": "h256", "action": "HASH", "algorithm": "SHA-256", "salt": "salt-"}, {"sourceField": "c_name", "targetField": "h5", "action": "HASH", "algorithm": "MD5"}]
    return apply(table(spark, sf, "customer"), "MASK_HASH", {"rules": rules}).select("c_custkey", "h256", "h5")


_RULES = [
    {"field": "l_quantity", "ruleType": "RANGE", "min": 5, "max": 45},
    {"field": "l_returnflag", "ruleType": "ENUM", "enumValues": ["A", "N"], "customMessage": "flag"},
    {"field": "l_shipdate", "ruleType": "NOT_NULL"},
]
_BAD = "concat_ws(';', CASE WHEN l_quantity < 5 THEN 'l_quantity must be >= 5' END, CASE WHEN l_quantity > 45 THEN 'l_quantity must be <= 45' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag' END)"


def _quality(spark: SparkSession, sf: str, mode: str, port: str) -> DataFrame:
    return apply(table(spark, sf, "lineitem"), "DATA_QUALITY", {"rules": _RULES, "mode": mode, "errorField": "errors"}, port)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 AND l_returnflag IN ('A', 'N')")
def dq_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf, "DIRTY_PORT", DEFAULT_OUT).select("l_orderkey", "l_linenumber")


@query(f"SELECT * FROM (SELECT l_orderkey, l_linenumber, {_BAD} AS errors FROM lineitem) WHERE errors <> ''")
def dq_dirty(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf, "DIRTY_PORT", "dirty").select("l_orderkey", "l_linenumber", F.concat_ws(";", "errors").alias("errors"))


@query(f"SELECT l_orderkey, l_linenumber, {_BAD} AS errors FROM lineitem")
def dq_mark(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf, "MARK_ERROR", DEFAULT_OUT).select("l_orderkey", "l_linenumber", F.concat_ws(";", "errors").alias("errors"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS p_k FROM events")
def deserialize_flatten(spark: SparkSession, sf: str) -> DataFrame:
    df = apply(table(spark, sf, "events"), "DESERIALIZE", {"field": "props", "targetField": "parsed", "format": "JSON", "schema": "k bigint"})
    return apply(df, "FLATTEN", {"sourceField": "parsed", "targetPrefix": "p", "removeSourceField": True}).select("event_id", "p_k")


@query("SELECT n_nationkey, 'n_name=' || n_name || '&n_regionkey=' || n_regionkey AS text FROM nation")
def serialize_kv(spark: SparkSession, sf: str) -> DataFrame:
    return apply(table(spark, sf, "nation"), "SERIALIZE", {"sourceFields": ["n_name", "n_regionkey"], "targetField": "text", "format": "KV"}).select("n_nationkey", "text")


@query("SELECT n_nationkey, n_name || '|' || n_regionkey AS text FROM nation")
def serialize_csv(spark: SparkSession, sf: str) -> DataFrame:
    return apply(table(spark, sf, "nation"), "SERIALIZE", {"sourceFields": ["n_name", "n_regionkey"], "targetField": "text", "format": "CSV", "delimiter": "|"}).select("n_nationkey", "text")


@query("SELECT n_nationkey, '<root><n_name>' || n_name || '</n_name><n_regionkey>' || n_regionkey || '</n_regionkey></root>' AS text FROM nation")
def serialize_xml(spark: SparkSession, sf: str) -> DataFrame:
    return apply(table(spark, sf, "nation"), "SERIALIZE", {"sourceFields": ["n_name", "n_regionkey"], "targetField": "text", "format": "XML"}).select("n_nationkey", "text")


@query("SELECT page_id, nullif(regexp_extract(url, '^([a-z]+)://([^/]+)', 1), '') AS proto, nullif(regexp_extract(url, '^([a-z]+)://([^/]+)', 2), '') AS host FROM pages")
def grok_pages(spark: SparkSession, sf: str) -> DataFrame:
    df = apply(table(spark, sf, "pages"), "GROK", {"inputField": "url", "outputField": "parts", "pattern": "(?<proto>[a-z]+)://(?<host>[^/]+)"})
    return df.select("page_id", "parts.proto", "parts.host")


@query("SELECT page_id, unnest(string_split(url, '/')) AS part FROM pages")
def explode_url(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "pages").withColumn("parts", F.split("url", "/", -1))
    return apply(df, "EXPLODE", {"sourceField": "parts", "targetField": "part"}).select("page_id", "part")


_TIMED = {"timeMode": "EVENT_TIME", "eventTimeField": "ts", "outputMode": "FLAT", "timeUnit": "HOURS"}
_SUMS = [{"function": "COUNT", "outputField": "n"}, {"function": "SUM", "field": "value", "outputField": "total"}]


@query("SELECT 'TUMBLING_TIME' AS windowType, epoch_ms(date_trunc('hour', ts)) AS windowStart, epoch_ms(date_trunc('hour', ts)) + 3600000 AS windowEnd, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value > 100 GROUP BY ALL")
def agg_tumbling_hour(spark: SparkSession, sf: str) -> DataFrame:
    large = apply(table(spark, sf, "events"), "FILTER", {"condition": "value > 100"}, "true")
    df = apply(large, "AGGREGATE", {**_TIMED, "mode": "GROUPED", "groupBy": ["event_type"], "windowSize": 1, "aggregations": _SUMS})
    return df.withColumn("total", F.round("total", 4)).drop(*RESERVED)


@query(
    "SELECT 'SLIDING_TIME' AS windowType, epoch_ms(s) AS windowStart, epoch_ms(s) + 7200000 AS windowEnd, count(*) AS n, round(sum(value), 4) AS total"
    " FROM (SELECT value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s"
)
def agg_sliding(spark: SparkSession, sf: str) -> DataFrame:
    df = apply(table(spark, sf, "events"), "AGGREGATE", {**_TIMED, "mode": "GLOBAL", "windowType": "SLIDING_TIME", "windowSize": 2, "windowSlide": 1, "aggregations": _SUMS})
    return df.withColumn("total", F.round("total", 4)).drop(*RESERVED)


@query("SELECT epoch_ms(date_trunc('day', ts)) AS day_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def agg_global_day(spark: SparkSession, sf: str) -> DataFrame:
    df = apply(table(spark, sf, "events"), "AGGREGATE", {**_TIMED, "outputMode": "NESTED", "mode": "GLOBAL", "windowSize": 24, "aggregations": _SUMS})
    return df.select(F.col("window.start").alias("day_start"), "metrics.n", F.round("metrics.total", 4).alias("total"))


@query(
    "SELECT user_id, n, total FROM (SELECT user_id, (rn - 1) // 5 AS w, count(*) AS n, round(sum(value), 4) AS total"
    " FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1, 2) WHERE n = 5"
)
def agg_count_window(spark: SparkSession, sf: str) -> DataFrame:
    df = apply(table(spark, sf, "events"), "AGGREGATE", {"mode": "GROUPED", "groupBy": ["user_id"], "windowType": "COUNT", "countWindowSize": 5, "outputMode": "FLAT", "orderBy": ["ts", "event_id"], "aggregations": _SUMS})
    return df.select("user_id", "n", F.round("total", 4).alias("total"))


@query(
    "WITH w AS (SELECT *, date_trunc('day', ts) AS d FROM events) SELECT epoch_ms(d) AS windowStart, event_type, count(*) AS n, round(sum(value), 4) AS s, round(avg(value), 8) AS a, min(value) AS lo, max(value) AS hi, count(DISTINCT user_id) AS users,"
    " arg_min(user_id, (ts, event_id)) AS f, arg_max(user_id, (ts, event_id)) AS l, array_to_string(list(event_id ORDER BY value DESC, ts, event_id)[1:3], ',') AS top, array_to_string(list(user_id ORDER BY ts, event_id), ',') AS ids FROM w GROUP BY d, event_type"
)
def agg_all_functions(spark: SparkSession, sf: str) -> DataFrame:
    specs = [
        {"function": "COUNT", "outputField": "n"},
        *[{"function": f, "field": "value", "outputField": o} for f, o in (("SUM", "s"), ("AVG", "a"), ("MIN", "lo"), ("MAX", "hi"))],
        *[{"function": f, "field": "user_id", "outputField": o} for f, o in (("COUNT_DISTINCT", "users"), ("FIRST_VALUE", "f"), ("LAST_VALUE", "l"), ("COLLECT_LIST", "ids"))],
        {"function": "TOP_N", "field": "event_id", "sortField": "value", "limit": 3, "outputField": "top"},
    ]
    df = apply(table(spark, sf, "events"), "AGGREGATE", {**_TIMED, "mode": "GROUPED", "groupBy": ["event_type"], "windowSize": 24, "orderBy": ["ts", "event_id"], "aggregations": specs})
    joined = lambda c: F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)
    return df.select("windowStart", "event_type", "n", F.round("s", 4).alias("s"), F.round("a", 8).alias("a"), "lo", "hi", "users", "f", "l", joined("top"), joined("ids"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return apply(table(spark, sf, "events"), "DEDUPLICATE", {"keyFields": ["user_id", "event_type"], "ttlSeconds": 3600, "orderBy": ["ts", "event_id"]}).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def dedup_last(spark: SparkSession, sf: str) -> DataFrame:
    return apply(table(spark, sf, "events"), "DEDUPLICATE", {"keyFields": ["user_id", "event_type"], "ttlSeconds": 3600, "keepStrategy": "LAST", "orderBy": ["ts", "event_id"]}).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1")
def dedup_event_time_latest(spark: SparkSession, sf: str) -> DataFrame:
    config = {"keyFields": ["user_id"], "timeMode": "EVENT_TIME", "eventTimeField": "ts", "windowSeconds": 86400, "keepStrategy": "EVENT_TIME_LATEST", "orderBy": ["event_id"]}
    return apply(table(spark, sf, "events"), "DEDUPLICATE", config).select("user_id", "event_id")


_REGIONS = [{"key": str(i), "value": {"name": n, "wet": w}} for i, n, w in ((0, "south", True), (1, "west", False), (2, "east", True))]


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' WHEN 2 THEN 'east' END AS region FROM nation")
def lookup_enrich_nation(spark: SparkSession, sf: str) -> DataFrame:
    entries = [{"key": e["key"], "value": e["value"]["name"]} for e in _REGIONS]
    return apply(table(spark, sf, "nation"), "LOOKUP_ENRICH", {"sourceField": "n_regionkey", "targetField": "region", "entries": entries, "missingStrategy": "PUT_NULL"}).select("n_nationkey", "region")


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' WHEN 2 THEN 'east' END AS name, CASE n_regionkey WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS wet FROM nation")
def lookup_join_left(spark: SparkSession, sf: str) -> DataFrame:
    return apply(table(spark, sf, "nation"), "LOOKUP_JOIN", {"sourceField": "n_regionkey", "targetField": "region", "entries": _REGIONS}).select("n_nationkey", "region.name", "region.wet")


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' ELSE 'east' END AS name FROM nation WHERE n_regionkey IN (0, 1, 2)")
def lookup_join_inner(spark: SparkSession, sf: str) -> DataFrame:
    return apply(table(spark, sf, "nation"), "LOOKUP_JOIN", {"sourceField": "n_regionkey", "targetField": "region", "entries": _REGIONS, "joinType": "INNER"}).select("n_nationkey", "region.name")


def _interval(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    events = table(spark, sf, "events")
    sides = {"left": events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), "right": events.where("event_type = 'error'").select("event_id", "user_id", "ts")}
    config = {"leftKeyField": "user_id", "rightKeyField": "user_id", "targetField": "error", "joinType": kind, "timeMode": "EVENT_TIME", "leftTimeField": "ts", "rightTimeField": "ts", "timeUnit": "HOURS", "windowBefore": 1, "windowAfter": 1}
    return apply(sides, "STREAM_JOIN", config).select("event_id", F.col("error.event_id").alias("error_id"))


_NEAR = "ON l.user_id = r.user_id AND r.event_type = 'error' AND r.ts BETWEEN l.ts - INTERVAL 1 HOUR AND l.ts + INTERVAL 1 HOUR WHERE l.event_type = 'purchase'"


@query(f"SELECT l.event_id, r.event_id AS error_id FROM events l JOIN events r {_NEAR}")
def stream_join_inner(spark: SparkSession, sf: str) -> DataFrame:
    return _interval(spark, sf, "INNER")


@query(f"SELECT l.event_id, r.event_id AS error_id FROM events l LEFT JOIN events r {_NEAR}")
def stream_join_left(spark: SparkSession, sf: str) -> DataFrame:
    return _interval(spark, sf, "LEFT")


@query("SELECT event_id, CASE WHEN value > 200 THEN 'high' END AS level FROM events WHERE value > 200 OR value < 1")
def union_ports(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    high = apply(apply(events, "FILTER", {"condition": "value > 200"}, "true"), "PUT", {"field": "level", "value": "high"})
    return union([high, apply(events, "FILTER", {"condition": "value < 1"}, "true")]).select("event_id", "level")


@query("SELECT event_id, value * 2 + 1 AS score FROM events WHERE event_type <> 'error'")
def custom_code_score(spark: SparkSession, sf: str) -> DataFrame:
    def score(record: dict) -> dict | None:
        return None if record["event_type"] == "error" else {"event_id": record["event_id"], "score": record["value"] * 2 + 1}

    return apply(table(spark, sf, "events").select("event_id", "event_type", "value"), "CUSTOM_CODE", {"className": "score", "outputSchema": "event_id long, score double"}, score=score)


def _round_trip(spark: SparkSession, df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Written by the file sink and read by the file source, in the shared folder."""
    config = {**config, "path": f"{shared_folder(spark)}/sparkloom/files-{uuid.uuid4().hex}"}
    write_files(df, config)
    return read_files(spark, config, False)


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def file_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    config = {"file_format_type": "JSON", "schema": "c_custkey bigint, c_name string", "partition_by": ["c_mktsegment"], "parse_partition_from_path": True, "is_partition_field_write_in_file": False}
    return _round_trip(spark, df, config).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def file_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    config = {"file_format_type": "CSV", "csv_use_header_line": True, "field_delimiter": ",", "sink_columns": ["s_suppkey", "s_name"]}
    return _round_trip(spark, table(spark, sf, "supplier"), config).select("s_suppkey", "s_name")


_TEXT_RULES = {
    "dq_type": ({"field": "c_phone", "ruleType": "TYPE", "expectedType": "INTEGER"}, "CASE WHEN c_custkey % 4 = 0 THEN 'c_phone must be INTEGER' ELSE '' END"),
    "dq_length": ({"field": "c_mktsegment", "ruleType": "LENGTH", "minLength": 9, "maxLength": 9}, "CASE WHEN length(c_mktsegment) < 9 THEN 'c_mktsegment length must be >= 9' WHEN length(c_mktsegment) > 9 THEN 'c_mktsegment length must be <= 9' ELSE '' END"),
    "dq_regex": ({"field": "c_name", "ruleType": "REGEX", "pattern": ".*[02468]"}, "CASE WHEN regexp_full_match(c_name, '.*[02468]') THEN '' ELSE 'c_name does not match the pattern' END"),
    "dq_not_null": ({"field": "c_maybe", "ruleType": "NOT_NULL"}, "CASE WHEN c_custkey % 3 = 0 THEN 'c_maybe is required' ELSE '' END"),
}


def _rule_query(name: str, rule: dict[str, Any], errors: str) -> None:
    """One rule over customers, some of which lack a field or have text for a number."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, "customer")
        df = df.withColumn("c_phone", F.when(F.col("c_custkey") % 4 == 0, "x12").otherwise(F.col("c_custkey").cast("string")))
        df = df.withColumn("c_maybe", F.when(F.col("c_custkey") % 3 != 0, "y"))
        marked = apply(df, "DATA_QUALITY", {"rules": [rule], "mode": "MARK_ERROR", "errorField": "errors"})
        return marked.select("c_custkey", F.concat_ws(";", "errors").alias("errors"))

    run.__name__ = name
    query(f"SELECT c_custkey, {errors} AS errors FROM customer")(run)


for _name, (_rule, _errors) in _TEXT_RULES.items():
    _rule_query(_name, _rule, _errors)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 AND l_returnflag IN ('A', 'N') AND l_shipdate IS NOT NULL")
def dq_discard(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf, "DISCARD", DEFAULT_OUT).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey, round(abs(p_size - 25) + greatest(p_size, 30) - least(p_size, 10) + sqrt(p_size) + power(p_size, 2), 6) AS x, CASE WHEN p_size > 20 THEN 'big' ELSE 'small' END AS kind FROM part")
def eval_functions(spark: SparkSession, sf: str) -> DataFrame:
    df = apply(table(spark, sf, "part"), "EVAL", {"targetField": "x", "expression": "#abs(p_size - 25) + #max(p_size, 30) - #min(p_size, 10) + #sqrt(p_size) + #pow(p_size, 2)"})
    df = apply(df, "EVAL", {"targetField": "kind", "expression": "p_size > 20 ? 'big' : 'small'"})
    return df.select("p_partkey", F.round("x", 6).alias("x"), "kind")


@query("SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, '.*[1-3]') AND p_size BETWEEN 5 AND 30 AND p_type IS NOT NULL")
def filter_grammar(spark: SparkSession, sf: str) -> DataFrame:
    return apply(table(spark, sf, "part"), "FILTER", {"condition": "p_brand matches '.*[1-3]' and p_size between {5, 30} and not (p_type == null)"}, "true").select("p_partkey")


@query("SELECT o_orderkey, CAST(((o_orderkey * 3000000000 + 2147483648) % 4294967296) - 2147483648 AS INTEGER) AS wrapped FROM orders")
def cast_int_wraps(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").withColumn("large", (F.col("o_orderkey") * 3000000000).cast("string"))
    return apply(df, "CAST", {"inputField": "large", "outputField": "wrapped", "targetType": "INT"}).select("o_orderkey", "wrapped")


def _deserialized(spark: SparkSession, sf: str, form: str, **more: Any) -> DataFrame:
    """Nations written as text by SERIALIZE and read again."""
    fields = ["n_name", "n_regionkey"]
    df = apply(table(spark, sf, "nation"), "SERIALIZE", {"sourceFields": fields, "targetField": "t", "format": form}).select("n_nationkey", "t")
    config = {"field": "t", "targetField": "x", "format": form, "schema": "n_name string, n_regionkey string"} | more
    return apply(df, "DESERIALIZE", config).select("n_nationkey", "x.n_name", "x.n_regionkey")


_AS_TEXT = "SELECT n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation"


@query(_AS_TEXT)
def deserialize_kv(spark: SparkSession, sf: str) -> DataFrame:
    return _deserialized(spark, sf, "KV")


@query(_AS_TEXT)
def deserialize_csv(spark: SparkSession, sf: str) -> DataFrame:
    return _deserialized(spark, sf, "CSV", fieldNames=["n_name", "n_regionkey"])


@query(_AS_TEXT)
def deserialize_xml(spark: SparkSession, sf: str) -> DataFrame:
    return _deserialized(spark, sf, "XML")


@query("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS text FROM nation")
def serialize_json(spark: SparkSession, sf: str) -> DataFrame:
    return apply(table(spark, sf, "nation"), "SERIALIZE", {"sourceFields": ["n_name", "n_regionkey"], "targetField": "text", "format": "JSON"}).select("n_nationkey", "text")


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS word, split_part(c_name, '#', 2) AS number FROM customer")
def grok_named(spark: SparkSession, sf: str) -> DataFrame:
    df = apply(table(spark, sf, "customer"), "GROK", {"inputField": "c_name", "outputField": "parts", "pattern": "%{WORD:word}#%{GREEDYDATA:number}"})
    return df.select("c_custkey", "parts.word", "parts.number")


@query("SELECT event_type, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS users FROM events GROUP BY event_type")
def agg_collect_set(spark: SparkSession, sf: str) -> DataFrame:
    specs = [{"function": "COLLECT_SET", "field": "user_id", "outputField": "users"}]
    df = apply(table(spark, sf, "events"), "AGGREGATE", {**_TIMED, "mode": "GROUPED", "groupBy": ["event_type"], "windowSize": 24 * 365 * 100, "orderBy": ["ts", "event_id"], "aggregations": specs})
    return df.select("event_type", F.concat_ws(",", F.array_sort("users").cast("array<string>")).alias("users"))


@query("SELECT 'aggregate:day:' || epoch_ms(date_trunc('day', ts)) || ':' || (epoch_ms(date_trunc('day', ts)) + 86400000) || ':global' AS id, count(*) AS n FROM events GROUP BY 1")
def agg_identity(spark: SparkSession, sf: str) -> DataFrame:
    config = {**_TIMED, "mode": "GLOBAL", "windowSize": 24, "aggregations": _SUMS[:1]}
    return REGISTRY["AGGREGATE"]({DEFAULT_IN: table(spark, sf, "events")}, config, Context("day"))[DEFAULT_OUT].select(F.col("_id").alias("id"), "n")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def dedup_event_time_first(spark: SparkSession, sf: str) -> DataFrame:
    config = {"keyFields": ["user_id"], "timeMode": "EVENT_TIME", "eventTimeField": "ts", "windowSeconds": 86400, "orderBy": ["ts", "event_id"]}
    return apply(table(spark, sf, "events"), "DEDUPLICATE", config).select("user_id", "event_id")


@query("SELECT n_nationkey::VARCHAR AS id FROM nation UNION ALL SELECT r_name FROM region")
def union_mixed_types(spark: SparkSession, sf: str) -> DataFrame:
    return union([table(spark, sf, "nation").select(F.col("n_nationkey").alias("id")), table(spark, sf, "region").select(F.col("r_name").alias("id"))])


_LOOKED_UP = [{"key": str(i), "value": {"half": i // 2}} for i in range(0, 1000, 2)]


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey < 1000 THEN p_partkey // 2 END AS half FROM part")
def lookup_join_broadcast(spark: SparkSession, sf: str) -> DataFrame:
    """More entries than a literal map takes."""
    return apply(table(spark, sf, "part"), "LOOKUP_JOIN", {"sourceField": "p_partkey", "targetField": "d", "entries": _LOOKED_UP}).select("p_partkey", F.col("d.half").cast("long").alias("half"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def file_parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf, "part"), {"file_format_type": "PARQUET"}).select("p_partkey", "p_name", "p_retailprice")


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def file_orc_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return _round_trip(spark, table(spark, sf, "part"), {"file_format_type": "ORC"}).select("p_partkey", "p_name", "p_retailprice")


@query("SELECT s_name || '|' || s_nationkey AS _message FROM supplier")
def file_text_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    config = {"file_format_type": "TEXT", "field_delimiter": "|", "sink_columns": ["s_name", "s_nationkey"]}
    return _round_trip(spark, table(spark, sf, "supplier"), config).select("_message")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def file_partitioned_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The partition field stands both in the folder and in the file."""
    config = {"file_format_type": "JSON", "schema": "c_custkey bigint, c_mktsegment string", "partition_by": ["c_mktsegment"], "custom_filename": True}
    return _round_trip(spark, table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), config).select("c_custkey", "c_mktsegment")


def _streamed(spark: SparkSession, sf: str, operator: str, config: dict[str, Any], name: str = "events") -> DataFrame:
    """A table through an operator as a stream that ends when all is read; the output as a written table."""
    home = f"{shared_folder(spark)}/sparkloom/stream-{uuid.uuid4().hex}"
    given = table(spark, sf, name)
    stream = spark.readStream.schema(given.schema).parquet(f"{sf}/{name}.parquet*")
    out = apply(stream, operator, config).drop(*RESERVED)
    writer = out.writeStream.format("parquet").outputMode("append").option("path", f"{home}/out").option("checkpointLocation", f"{home}/checkpoint")
    with stateful_streams(spark):
        query_ = writer.trigger(availableNow=True).start()
        query_.awaitTermination()
    if query_.exception():
        raise query_.exception()
    return spark.read.schema(out.schema).parquet(f"{home}/out")


@query("SELECT event_id, user_id FROM events WHERE value > 100")
def stream_filter(spark: SparkSession, sf: str) -> DataFrame:
    home = _streamed(spark, sf, "EVAL", {"targetField": "large", "expression": "value > 100"})
    return home.where("large").select("event_id", "user_id")


@query("SELECT epoch_ms(date_trunc('day', ts)) AS windowStart, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1")
def stream_agg_day(spark: SparkSession, sf: str) -> DataFrame:
    """Days that the watermark has passed; the last day is still open when the input ends."""
    config = {**_TIMED, "mode": "GLOBAL", "windowSize": 24, "watermarkDelay": 0, "aggregations": _SUMS[:1]}
    return _streamed(spark, sf, "AGGREGATE", config).select("windowStart", "n")


@query("SELECT user_id, CAST(10 AS BIGINT) AS n FROM (SELECT user_id, count(*) // 10 AS w FROM events GROUP BY user_id), range(1000000) r WHERE r.range < w")
def stream_count_window(spark: SparkSession, sf: str) -> DataFrame:
    config = {"mode": "GROUPED", "groupBy": ["user_id"], "windowType": "COUNT", "countWindowSize": 10, "outputMode": "FLAT", "aggregations": _SUMS[:1]}
    return _streamed(spark, sf, "AGGREGATE", config).select("user_id", "n")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


