"""Operators on records of a harbour: ships, berths and tide gauges."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sparkloom.engine import Engine
from sparkloom.model import ConfigError
from sparkloom.operators import REGISTRY, Context
from sparkloom.plans.planner import union
from sparkloom.sources import mock


def records(spark, samples):
    return mock(spark, {"sampleData": [s if isinstance(s, str) else json.dumps(s) for s in samples]})


def rows_of(df):
    ordered = df.orderBy("_seq") if "_seq" in df.columns else df
    return [r.asDict(recursive=True) for r in ordered.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")]).collect()]


def apply(spark, samples, operator, config, port="output-0", **functions):
    return rows_of(REGISTRY[operator]({"input-0": records(spark, samples)}, config, Context("n", functions)).get(port))


GAUGES = [{"gauge": "north", "level": 4}, {"gauge": "south", "level": 0}, {"gauge": "mole"}]


@pytest.mark.parametrize(
    ("condition", "kept"),
    [
        ("8 / level > 1", ["north"]),  # a division by zero and a missing field are false
        ("level >= 0 and gauge != 'south'", ["north"]),
        ("gauge matches '.*o.*'", ["north", "south", "mole"]),
        ("level between {1, 9}", ["north"]),
        ("level == null", ["mole"]),
        ("(level ?: 7) > 5", ["mole"]),
        ("not (gauge == 'mole') and 2 ^ level < 2", ["south"]),
        ("#max(level, 3) == 3", ["south"]),
        ("#abs(level - 6) == #sqrt(4)", ["north"]),
        ("#min(level, 1) + #pow(level, 2) == 17", ["north"]),
    ],
)
def test_filter_conditions(spark, condition, kept):
    assert [r["gauge"] for r in apply(spark, GAUGES, "FILTER", {"condition": condition}, "true")] == kept
    assert len(apply(spark, GAUGES, "FILTER", {"condition": condition}, "false")) == 3 - len(kept)


def test_put_copies_values_and_fills_templates(spark):
    ship = [{"name": "Petrel", "length": 31, "ship": {"sign": "LX"}}]
    put = lambda field, value: apply(spark, ship, "PUT", {"field": field, "value": value})[0]
    assert put("metres", "${length}")["metres"] == 31
    assert put("sign", "${name}/${flag}")["sign"] == "Petrel/null"
    assert put("ship.home.port", "Esbjerg")["ship"] == {"sign": "LX", "home": {"port": "Esbjerg"}}


def test_prune_drops_emptied_parents_and_rename_moves(spark):
    ship = [{"ship": {"crew": {"mate": "Ines"}}, "berth": 7}]
    assert apply(spark, ship, "PRUNE", {"fields": ["ship.crew.mate"]}) == [{"berth": 7}]
    assert apply(spark, ship, "RENAME", {"mapping": {"ship.crew.mate": "pilot.name", "berth": "pier"}})[0]["pilot"] == {"name": "Ines"}


def test_flatten_and_explode(spark):
    manifest = [{"hold": {"deck": 2, "cargo": {"kind": "salt", "tons": 90}}, "stops": ["Hull", "Bergen"]}]
    flat = apply(spark, manifest, "FLATTEN", {"sourceField": "hold", "targetPrefix": "h", "removeSourceField": True})[0]
    assert flat == {"h_deck": 2, "h_cargo_kind": "salt", "h_cargo_tons": 90, "stops": ["Hull", "Bergen"]}
    assert [r["stop"] for r in apply(spark, manifest, "EXPLODE", {"sourceField": "stops", "targetField": "stop"})] == ["Hull", "Bergen"]
    assert apply(spark, manifest, "EXPLODE", {"sourceField": "absent", "targetField": "stop"}) == []


@pytest.mark.parametrize(
    ("text", "kind", "wanted"),
    [("  42 ", "INT", 42), ("1e3", "LONG", 1000), ("-0.99", "INT", 0), ("4294967301", "INT", 5), ("2147483648", "INT", -2147483648), ("9223372036854775808", "LONG", -9223372036854775808), ("18446744073709551617", "LONG", 1), ("maybe", "BOOLEAN", False), ("TRUE", "BOOLEAN", True), ("6.75", "DOUBLE", 6.75), ("fathom", "INT", None)],
)
def test_cast_truncates_and_wraps(spark, text, kind, wanted):
    assert apply(spark, [{"depth": text}], "CAST", {"inputField": "depth", "outputField": "d", "targetType": kind})[0]["d"] == wanted


def test_eval_strategies(spark):
    tide = [{"high": 9, "low": 2, "range": {"now": 1}}]
    run = lambda more, rows=tide: apply(spark, rows, "EVAL", {"targetField": "range.now", "expression": "high - low", **more})[0]
    assert run({})["range"] == {"now": 7}
    assert run({"outputMode": "WRITE_IF_ABSENT"})["range"] == {"now": 1}
    assert run({"errorStrategy": "PUT_NULL", "targetField": "gap"}, [{"high": 9}])["gap"] is None
    with pytest.raises(Exception, match="EVAL failed"):
        run({"expression": "high / (low - 2)", "errorStrategy": "FAIL"})


def test_case_when_and_route_agree(spark):
    ships = [{"tons": 900, "flag": "NO"}, {"tons": 40, "flag": "NO"}, {"tons": 900, "flag": "IS"}, {"tons": 3, "flag": "IS"}]
    conditions = {"heavy": "tons > 500", "home": "flag == 'NO'"}
    cases = [{"condition": c, "value": v} for v, c in conditions.items()]
    assert [r["c"] for r in apply(spark, ships, "CASE_WHEN", {"targetField": "c", "cases": cases, "defaultMode": "VALUE", "defaultValue": "rest"})] == ["heavy", "home", "heavy", "rest"]
    routes = [{"portId": p, "condition": c} for p, c in conditions.items()]
    count = lambda mode: [len(apply(spark, ships, "ROUTE", {"routes": routes, "matchMode": mode}, p)) for p in ("heavy", "home", "unmatched")]
    assert count("FIRST_MATCH") == [2, 1, 1] and count("ALL_MATCHES") == [2, 2, 1]


def test_time_derive_over_a_new_year(spark):
    config = {"sourceField": "at", "sourceFormat": "PATTERN", "sourcePattern": "dd.MM.yyyy HH:mm", "sourceTimeZone": "Europe/Oslo", "parseErrorStrategy": "SET_NULL"}
    config["derivations"] = [{"type": t, "outputField": t.lower()} for t in ("DATE", "YEAR", "HOUR", "WEEK", "QUARTER", "DAY_OF_YEAR")] + [{"type": "FORMAT", "pattern": "yyMMdd-HHmm", "outputField": "f"}]
    good, bad = apply(spark, [{"at": "01.01.2021 00:30"}, {"at": "noon"}], "TIME_DERIVE", config)
    assert [good[k] for k in ("date", "year", "hour", "week", "quarter", "day_of_year", "f")] == ["2020-12-31", 2020, 23, 53, 4, 366, "201231-2330"]
    assert bad["year"] is None and bad["f"] is None


def test_mask_and_hash(spark):
    rules = [{"sourceField": "pass", "targetField": "m", "action": "MASK"}, {"sourceField": "pilot", "targetField": "h", "action": "HASH", "salt": "quay:"}]
    row = apply(spark, [{"pass": "HB-204-7781", "pilot": "Ines"}], "MASK_HASH", {"rules": rules})[0]
    assert row["m"] == "HB-****7781" and row["h"] == hashlib.sha256(b"quay:Ines").hexdigest()


@pytest.mark.parametrize(
    ("form", "text", "more", "wanted"),
    [
        ("JSON", '{"berth":"B4","depth":9.5}', {"schema": "berth string, depth double"}, {"berth": "B4", "depth": 9.5}),
        ("KV", "berth=B4&depth=9", {}, {"berth": "B4", "depth": "9"}),
        ("CSV", "B4; 9", {"fieldNames": ["berth", "depth"], "delimiter": ";"}, {"berth": "B4", "depth": "9"}),
        ("XML", "<call><berth>B4</berth><depth>9</depth></call>", {}, {"berth": "B4", "depth": "9"}),
    ],
)
def test_deserialize_forms(spark, form, text, more, wanted):
    assert apply(spark, [{"raw": text}], "DESERIALIZE", {"field": "raw", "targetField": "call", "format": form, **more})[0]["call"] == wanted


def test_bad_json_leaves_no_value(spark):
    rows = apply(spark, [{"raw": '{"berth":"B4"}'}, {"raw": "{berth"}], "DESERIALIZE", {"field": "raw", "targetField": "call", "format": "JSON"})
    assert [r["call"] for r in rows] == [{"berth": "B4"}, None]


@pytest.mark.parametrize(
    ("form", "wanted"),
    [("KV", "berth=B4&depth=9"), ("CSV", "B4,9"), ("XML", "<root><berth>B4</berth><depth>9</depth></root>"), ("JSON", '{"berth":"B4","depth":9}')],
)
def test_serialize_forms(spark, form, wanted):
    assert apply(spark, [{"berth": "B4", "depth": 9}], "SERIALIZE", {"sourceFields": ["berth", "depth"], "targetField": "t", "format": form})[0]["t"] == wanted


@pytest.mark.parametrize("pattern", [r"(?<code>[A-Z]+)-(?<berth>\d+) (?<note>.*)", "%{WORD:code}-%{INT:berth} %{GREEDYDATA:note}"])
def test_grok(spark, pattern):
    found = apply(spark, [{"line": "ARR-12 two tugs"}, {"line": "?"}], "GROK", {"inputField": "line", "outputField": "parts", "pattern": pattern})
    assert found[0]["parts"] == {"code": "ARR", "berth": "12", "note": "two tugs"}


@pytest.mark.parametrize("size", [3, 250])
def test_lookups_of_any_size(spark, size):
    """Few entries are a literal, more a join."""
    flags = [{"flag": "f1"}, {"flag": "none"}]
    entries = [{"key": f"f{i}", "value": f"state {i}"} for i in range(size)]
    config = {"sourceField": "flag", "targetField": "state", "entries": entries}
    assert sorted(str(r["state"]) for r in apply(spark, flags, "LOOKUP_ENRICH", {**config, "missingStrategy": "PUT_NULL"})) == ["None", "state 1"]
    assert [r["flag"] for r in apply(spark, flags, "LOOKUP_ENRICH", {**config, "missingStrategy": "DISCARD"})] == ["f1"]
    with pytest.raises(Exception, match="no lookup entry"):
        apply(spark, flags, "LOOKUP_ENRICH", {**config, "missingStrategy": "FAIL"})
    dimension = [{"key": e["key"], "value": {"name": e["value"], "rank": i}} for i, e in enumerate(entries)]
    inner = apply(spark, flags, "LOOKUP_JOIN", {"sourceField": "flag", "targetField": "s", "entries": dimension, "joinType": "INNER"})
    assert inner == [{"flag": "f1", "s": {"name": "state 1", "rank": 1}}]


QUALITY = [
    ({"ruleType": "NOT_NULL", "field": "tons"}, "tons is required"),
    ({"ruleType": "TYPE", "field": "name", "expectedType": "INTEGER"}, "name must be INTEGER"),
    ({"ruleType": "REGEX", "field": "name", "pattern": "[A-Z].*"}, "name does not match the pattern"),
    ({"ruleType": "LENGTH", "field": "name", "minLength": 5}, "name length must be >= 5"),
    ({"ruleType": "RANGE", "field": "draft", "max": 3}, "draft must be <= 3"),
    ({"ruleType": "ENUM", "field": "name", "enumValues": ["tern"], "customMessage": "unknown ship"}, "unknown ship"),
]


@pytest.mark.parametrize(("rule", "message"), QUALITY)
def test_each_quality_rule(spark, rule, message):
    bad = [{"name": "auk", "draft": 4.5, "tons": None}]
    config = {"rules": [rule], "errorField": "check.errors"}
    assert apply(spark, bad, "DATA_QUALITY", config, "dirty")[0]["check"]["errors"] == [message]
    assert apply(spark, bad, "DATA_QUALITY", config) == [] and apply(spark, bad, "DATA_QUALITY", {**config, "mode": "DISCARD"}) == []
    with pytest.raises(Exception, match="data quality"):
        apply(spark, bad, "DATA_QUALITY", {**config, "mode": "FAIL"})


def test_deduplicate(spark):
    calls = [{"ship": s, "minute": m, "pilot": p} for s, m, p in (("tern", 0, "Ines"), ("auk", 20, "Odd"), ("tern", 40, "Per"), ("tern", 70, "Kari"))]
    for keep, wanted in (("FIRST", ["Ines", "Odd"]), ("LAST", ["Kari", "Odd"])):
        assert sorted(r["pilot"] for r in apply(spark, calls, "DEDUPLICATE", {"keyFields": ["ship"], "ttlSeconds": 9, "keepStrategy": keep})) == wanted
    timed = [{**c, "at": c["minute"] * 60_000} for c in calls]
    config = {"keyFields": ["ship"], "timeMode": "EVENT_TIME", "eventTimeField": "at", "windowSeconds": 3600}
    for keep, wanted in (("EVENT_TIME_LATEST", ["Kari", "Odd", "Per"]), ("FIRST", ["Ines", "Kari", "Odd"])):
        assert sorted(r["pilot"] for r in apply(spark, timed, "DEDUPLICATE", {**config, "keepStrategy": keep})) == wanted


ALL = ["COUNT", "SUM", "AVG", "MIN", "MAX", "COUNT_DISTINCT", "FIRST_VALUE", "LAST_VALUE", "COLLECT_LIST", "COLLECT_SET"]
SPECS = [{"function": f, "field": "tons", "outputField": f.lower()} for f in ALL] + [{"function": "TOP_N", "field": "ship", "sortField": "tons", "limit": 2, "outputField": "top"}]
LOADS = [{"pier": p, "ship": s, "tons": t} for p, s, t in (("east", "tern", 30), ("west", "auk", 5), ("east", "gull", 70), ("east", "skua", 30), ("west", "knot", None), ("east", "smew", 1))]
EAST = {"pier": "east", "count": 3, "sum": 130.0, "avg": 130 / 3, "min": 30.0, "max": 70.0, "count_distinct": 2, "first_value": 30, "last_value": 30, "collect_list": [30, 70, 30], "collect_set": [30, 70], "top": ["gull", "tern"]}


def test_count_windows_and_every_function(spark):
    config = {"groupBy": ["pier"], "windowType": "COUNT", "countWindowSize": 3, "outputMode": "FLAT", "aggregations": SPECS}
    (found,) = apply(spark, LOADS, "AGGREGATE", config)
    assert {k: round(found[k], 9) if isinstance(found[k], float) else found[k] for k in EAST} == {k: round(v, 9) if isinstance(v, float) else v for k, v in EAST.items()}


def test_count_windows_of_a_stream_agree_with_a_batch(spark, tmp_path):
    """The same loads in two files of a stream: the window spans both, and what is not full is not reported."""
    schema = "pier string, ship string, tons long"
    for i, part in enumerate((LOADS[:3], LOADS[3:])):
        spark.createDataFrame([(r["pier"], r["ship"], r["tons"]) for r in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    config = {"groupBy": ["pier"], "windowType": "COUNT", "countWindowSize": 3, "outputMode": "FLAT", "aggregations": SPECS}
    out = REGISTRY["AGGREGATE"]({"input-0": stream}, config, Context("n"))["output-0"]
    query = out.writeStream.format("memory").queryName("loads").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(180) and query.exception() is None
    (found,) = rows_of(spark.table("loads"))
    assert found["pier"] == "east" and found["count"] == 3 and sorted(found["collect_list"]) == [30, 30, 70] and found["top"][0] == "gull"


def test_aggregate_windows_have_an_identity(spark):
    rows = [{"at": t, "pier": p} for t, p in ((100, "east"), (59_999, "west"), (60_000, "east"))]
    config = {"windowType": "TUMBLING_TIME", "timeMode": "EVENT_TIME", "eventTimeField": "at", "timeUnit": "MINUTES", "windowSize": 1, "outputMode": "FLAT", "aggregations": [{"function": "COUNT", "outputField": "n"}]}
    made = lambda more: REGISTRY["AGGREGATE"]({"input-0": records(spark, rows)}, {**config, **more}, Context("tides"))["output-0"].collect()
    found = made({})
    assert sorted((r["windowStart"], r["windowEnd"], r["n"]) for r in found) == [(0, 60_000, 2), (60_000, 120_000, 1)]
    assert sorted(r["_id"] for r in found) == ["aggregate:tides:0:60000:global", "aggregate:tides:60000:120000:global"]
    assert found[0]["_headers"] == {"operator": "AGGREGATE", "nodeId": "tides", "windowType": "TUMBLING_TIME"} and found[0]["_ts_ms"] > 0
    grouped = {"groupBy": ["pier"]}
    assert len({r["_id"] for r in made(grouped)}) == 3 and {r["_id"] for r in made(grouped)} == {r["_id"] for r in made(grouped)}


def test_late_records_of_a_stream_are_dropped(spark, tmp_path):
    for i, times in enumerate(([10, 7_500], [8_000], [2_000, 20_000], [90_000])):
        spark.createDataFrame([(t,) for t in times], "at long").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("at long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    config = {"windowType": "TUMBLING_TIME", "timeMode": "EVENT_TIME", "eventTimeField": "at", "timeUnit": "SECONDS", "windowSize": 5, "watermarkDelay": 0, "outputMode": "FLAT", "aggregations": [{"function": "COUNT", "outputField": "n"}]}
    out = REGISTRY["AGGREGATE"]({"input-0": stream}, config, Context("n"))["output-0"]
    query = out.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    assert sorted((r["windowStart"], r["n"]) for r in spark.table("late").collect()) == [(0, 1), (5_000, 2), (20_000, 1)]


def test_ports_of_mixed_types_meet_as_text(spark):
    numbers, texts = records(spark, [{"berth": 7, "deep": True}]), records(spark, [{"berth": "quay", "tons": 2}])
    assert sorted(r["berth"] for r in rows_of(union([numbers, texts]))) == ["7", "quay"]
    assert sorted(r["berth"] for r in rows_of(union([numbers, records(spark, [{"berth": 2.5}])]))) == [2.5, 7.0]


def test_custom_code(spark):
    def weigh(record):
        if record["tons"] is None:
            return None
        return {"ship": record["ship"], "kilos": record["tons"] * 1000}

    found = apply(spark, LOADS[3:], "CUSTOM_CODE", {"className": "weigh", "outputSchema": "ship string, kilos long"}, weigh=weigh)
    assert found == [{"ship": "skua", "kilos": 30_000}, {"ship": "smew", "kilos": 1000}]
    with pytest.raises(ConfigError):
        apply(spark, LOADS, "CUSTOM_CODE", {"className": "Weigh", "language": "JAVA", "sourceCode": "class Weigh {}"})


def _pipeline(*nodes, edges):
    return {"pipelineId": "harbour", "nodes": [{"id": i, "operator": o, "config": c} for i, o, c in nodes], "edges": [{"id": f"e{k}", "sourceNodeId": a, "sourcePortId": p, "targetNodeId": b, "targetPortId": q} for k, (a, p, b, q) in enumerate(edges)]}


def test_preview_of_a_join(spark):
    ships = ['{"imo":"7","tons":40}', "not json", '{"imo":"8","tons":2}']
    join = {"leftKeyField": "imo", "rightKeyField": "imo", "targetField": "call", "joinType": "LEFT", "windowBefore": 90, "windowAfter": 90}
    p = _pipeline(
        ("ships", "KAFKA_SOURCE", {"sampleData": ships}), ("calls", "KAFKA_SOURCE", {"sampleData": ['{"imo":"7","berth":"B4"}']}), ("j", "STREAM_JOIN", join), ("out", "KAFKA_SINK", {"bootstrapServers": "h", "topic": "t"}),
        edges=[("ships", "output-0", "j", "left"), ("calls", "output-0", "j", "right"), ("j", "output-0", "out", "input-0")],
    )
    found = [json.loads(r) for r in Engine(spark).preview(p)["outputs"][0]["records"]]
    assert sorted((r["imo"], (r.get("call") or {}).get("berth")) for r in found) == [("7", "B4"), ("8", None)]


def test_run_counts_and_fans_out(spark, tmp_path):
    """One branch into two sinks; counters of what passed."""
    file = lambda name: {"path": str(tmp_path / name), "file_format_type": "JSON"}
    p = _pipeline(
        ("s", "KAFKA_SOURCE", {"useMockSource": True, "sampleData": [json.dumps(r) for r in GAUGES]}), ("f", "FILTER", {"condition": "level > 1"}), ("a", "HDFS_FILE_SINK", file("a")), ("b", "HDFS_FILE_SINK", file("b")),
        edges=[("s", "output-0", "f", "input-0"), ("f", "true", "a", "input-0"), ("f", "true", "b", "input-0")],
    )
    run = Engine(spark).run(p, count=True)
    assert run.metrics()["f/true"] >= 1
    assert [json.loads(spark.read.text(str(tmp_path / n)).collect()[0][0])["gauge"] for n in "ab"] == ["north", "north"]


@pytest.mark.parametrize("condition", ["T(java.io.File)", "gauge.length()", "#root", "level = 3", "new Ship()", "@harbour", "level >", "{1, 2"])
def test_expressions_outside_the_language_are_refused(spark, condition):
    p = _pipeline(("s", "KAFKA_SOURCE", {}), ("f", "FILTER", {"condition": condition}), ("k", "KAFKA_SINK", {}), edges=[("s", "output-0", "f", "input-0"), ("f", "true", "k", "input-0")])
    with pytest.raises(ConfigError):
        Engine(spark).validate(p)


def test_structure_is_checked(spark):
    good = _pipeline(("s", "KAFKA_SOURCE", {}), ("f", "FILTER", {"condition": "level > 1"}), ("k", "KAFKA_SINK", {}), edges=[("s", "output-0", "f", "input-0"), ("f", "true", "k", "input-0")])
    Engine(spark).validate(good)
    broken = {
        "no output port": {"edges": [{"sourceNodeId": "s", "targetNodeId": "f"}, {"sourceNodeId": "f", "sourcePortId": "perhaps", "targetNodeId": "k"}]},
        "not supported": {"nodes": [*good["nodes"], {"id": "x", "operator": "JOIN"}]},
        "not on a path": {"nodes": [*good["nodes"], {"id": "x", "operator": "PRUNE"}]},
    }
    for message, change in broken.items():
        with pytest.raises(ConfigError, match=message):
            Engine(spark).validate({**good, **change})


@pytest.mark.parametrize("kind", ["LEFT", "INNER"])
@pytest.mark.parametrize(("before", "after"), [(5, 0), (0, 7), (3, 4)])
def test_join_in_time_buckets_against_all_pairs(spark, kind, before, after):
    ships = [(f"s{i}", None if i % 11 == 0 else f"k{i % 3}", None if i % 13 == 0 else (i * 37) % 50 - 9) for i in range(60)]
    calls = [(f"c{i}", None if i % 7 == 0 else f"k{i % 4}", None if i % 9 == 0 else (i * 29) % 50 - 9) for i in range(60)]
    left, right = (spark.createDataFrame(rows, f"{name} string, k string, at long") for rows, name in ((ships, "ship"), (calls, "call")))
    config = {"leftKeyField": "k", "rightKeyField": "k", "targetField": "met", "joinType": kind, "timeMode": "EVENT_TIME", "leftTimeField": "at", "rightTimeField": "at", "timeUnit": "MILLISECONDS", "windowBefore": before, "windowAfter": after}
    found = REGISTRY["STREAM_JOIN"]({"left": left, "right": right}, config, Context("n", {}))["output-0"]
    wanted = []
    for ship, k, at in ships:
        met = [c for c, key, then in calls if k is not None and key == k and at is not None and then is not None and at - before <= then <= at + after]
        wanted += [(ship, c) for c in met] or ([(ship, "")] if kind == "LEFT" else [])
    assert sorted((r["ship"], r["met"]["call"] if r["met"] else "") for r in found.collect()) == sorted(wanted)
