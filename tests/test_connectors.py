"""Sources and sinks against files, an embedded database and local HTTP servers."""

import json
import threading
import time
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from sparkloom import sinks, sources
from sparkloom.engine import Engine
from sparkloom.model import ConfigError, Pipeline
from sparkloom.settings import check_settings
from sparkloom.sources.search_index import SearchIndexSource


@pytest.fixture
def server():
    seen, answers = [], []

    class Handler(BaseHTTPRequestHandler):
        def _serve(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            seen.append((self.command, self.path, body))
            data = json.dumps(answers.pop(0) if answers else {}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = _serve

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{http.server_port}", seen, answers
    http.shutdown()


def test_search_index_source(spark, server):
    host, seen, answers = server
    answers += [{"_scroll_id": "z9", "hits": {"hits": [{"_id": n, "_source": {"berth": n, "depth": d, "surveyed": at}} for n, d, at in (("B4", 9.5, 80), ("B6", 12.0, 95))]}}, {"_scroll_id": "z9", "hits": {"hits": []}}]
    config = {"hosts": host, "index": "berths", "source": ["berth", "depth", "surveyed"], "readMode": "INCREMENTAL", "cursorField": "surveyed", "cursorType": "LONG", "initialCursorValue": 77, "schema": "berth string, depth double, surveyed long"}
    rows = sources.search_index(spark, config, False).select("berth", "depth").collect()
    assert sorted(map(tuple, rows)) == [("B4", 9.5), ("B6", 12.0)]
    body = json.loads(seen[0][2])
    assert body["_source"] == ["berth", "depth", "surveyed"] and body["query"]["bool"]["must"][1] == {"range": {"surveyed": {"gt": 77}}}


def test_search_index_sink(spark, server):
    host, seen, answers = server
    df = spark.createDataFrame([("B4", "NORTH", 9.5)], "berth string, basin string, depth double")
    sinks.search_index(df, {"hosts": [host], "index": "berths-${basin}", "primaryKeys": ["berth"], "fields": ["berth", "depth"]})
    head, doc = map(json.loads, seen[0][2].strip().split("\n"))
    assert head == {"index": {"_index": "berths-north", "_id": "B4"}} and doc == {"berth": "B4", "depth": 9.5}


def test_time_series(spark, server):
    host, seen, answers = server
    answers.append({"results": [{"series": [{"name": "tide", "tags": {"gauge": "mole"}, "columns": ["time", "metres"], "values": [[60_000, 1.25], [120_000, 1.5]]}]}]})
    config = {"url": host, "database": "harbour", "sql": "SELECT * FROM tide", "schema": "_measurement string, gauge string, time long, metres double"}
    found = sources.time_series(spark, config, False).select("_measurement", "gauge", "metres", "_ts_ms").collect()
    assert sorted(map(tuple, found)) == [("tide", "mole", 1.25, 60_000), ("tide", "mole", 1.5, 120_000)]
    df = spark.createDataFrame([(60_000, "south pier", "in", 2.5)], "at long, gauge string, basin string, metres double")
    sinks.time_series(df, {"url": host, "database": "harbour", "measurement": "tide_${basin}", "keyTime": "at", "keyTags": ["gauge", "basin"], "fields": ["metres"]})
    assert seen[-1][2] == "tide_in,basin=in,gauge=south\\ pier metres=2.5 60000" or seen[-1][2] == "tide_in,gauge=south\\ pier,basin=in metres=2.5 60000"


def test_jdbc(spark, tmp_path):
    config = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    schema = "BERTH long, SHIP string, FEE double"
    first = spark.createDataFrame([(4, "tern", 10.0), (6, "auk", 20.0), (9, "gull", 30.0)], schema)
    first.write.format("jdbc").option("url", config["url"]).option("driver", config["driver"]).option("dbtable", "CALLS").save()
    read = lambda **more: sorted(r["BERTH"] for r in sources.jdbc(spark, {**config, "tablePath": "CALLS", **more}, False).collect())
    assert read() == [4, 6, 9]
    assert read(readMode="INCREMENTAL", cursorField="BERTH", cursorType="LONG", initialCursorValue=5) == [6, 9]
    target = {**config, "tablePath": "CALLS", "fields": ["BERTH", "SHIP", "FEE"]}
    sinks.jdbc(spark.createDataFrame([(7, "knot", 5.0)], schema), target)
    changed = spark.createDataFrame([(6, "skua", 1.0), (6, "smew", 2.0), (11, "knot", 3.0)], schema).coalesce(1)
    sinks.jdbc(changed, {**target, "writeMode": "UPSERT", "keyFields": ["BERTH"]})
    rows = {r["BERTH"]: (r["SHIP"], r["FEE"]) for r in sources.jdbc(spark, {**config, "tablePath": "CALLS"}, False).collect()}
    assert rows == {4: ("tern", 10.0), 6: ("smew", 2.0), 7: ("knot", 5.0), 9: ("gull", 30.0), 11: ("knot", 3.0)}
    with pytest.raises(ConfigError):
        sources.jdbc_query({"query": "drop table CALLS"})


def test_cursors_as_literals():
    at = "2031-02-03 04:05:06"
    assert sources.cursor_literal(at, "TIMESTAMP", "jdbc:derby:x") == f"'{at}'" and sources.cursor_literal(at, "TIMESTAMP", "jdbc:postgresql://h/d") == f"TIMESTAMP '{at}'"
    assert sources.cursor_literal("o'clock", "STRING") == "'o''clock'" and sources.cursor_literal("7", "LONG") == "7"


def test_json_files_with_partition_folders(spark, tmp_path):
    """Bad lines are skipped; partition fields of any file are fields, not only those of the first."""
    for folder, line in (("basin=in", '{"ship":"tern","at":5}\n\n{oops'), ("basin=out/pier=3", '{"ship":"auk","at":9}')):
        (tmp_path / "calls" / folder).mkdir(parents=True)
        (tmp_path / "calls" / folder / "x.json").write_text(line + "\n")
    config = {"path": str(tmp_path / "calls"), "fs.defaultFS": "file://", "file_format_type": "JSON", "parse_partition_from_path": True, "idField": "ship", "timestampField": "at"}
    rows = sources.files(spark, config, False).select("ship", "basin", "pier", "_id", "_ts_ms").collect()
    assert sorted((r["ship"], r["basin"], r["pier"], r["_id"], r["_ts_ms"]) for r in rows) == [("auk", "out", "3", "auk", 9), ("tern", "in", None, "tern", 5)]


@pytest.mark.parametrize("form", ["JSON", "CSV", "TEXT", "PARQUET", "ORC"])
def test_file_sink_keeps_partition_fields_in_files_and_folders(spark, tmp_path, form):
    df = spark.createDataFrame([("tern", "in/out", 1), ("auk", None, 2)], "ship string, basin string, berth long").coalesce(1)
    config = {"path": str(tmp_path / form), "file_format_type": form, "partition_by": ["basin"], "field_delimiter": ",", "sink_columns": ["ship", "basin"]}
    sinks.files(df, config)
    sinks.files(df, {**config, "custom_filename": True, "file_name_expression": "call-${now}", "filename_time_format": "yyyy"})
    folders = sorted(p.name for p in (tmp_path / form).iterdir() if not p.name.startswith("."))
    assert folders == ["basin=__HIVE_DEFAULT_PARTITION__", "basin=in_out"]
    files = [p.name for p in (tmp_path / form / "basin=in_out").iterdir() if not p.name.startswith(".")]
    assert len(files) == 2 and sum(f.startswith("call-20") for f in files) == 1
    if form == "JSON":
        assert [json.loads(r[0]) for r in spark.read.text(f"{config['path']}/basin=in_out").collect()] == [{"ship": "tern", "basin": "in/out"}] * 2
    if form in ("PARQUET", "ORC"):
        back = spark.read.option("recursiveFileLookup", "true").format(form.lower()).load(config["path"])
        assert sorted(back.columns) == ["basin", "ship"] and back.count() == 4


def test_file_sink_folders_by_expression(spark, tmp_path):
    df = spark.createDataFrame([("tern", "in"), ("auk", "out")], "ship string, basin string")
    config = {"path": str(tmp_path / "x"), "file_format_type": "JSON", "partition_by": ["basin"], "partition_dir_expression": "basin-${basin}/all", "is_partition_field_write_in_file": False}
    sinks.files(df, config)
    assert [r[0] for r in spark.read.text(f"{config['path']}/basin-in/all").collect()] == ['{"ship":"tern"}']
    sinks.files(df.where("basin = 'out'"), {**config, "write_mode": "overwrite"})
    assert sorted(p.name for p in (tmp_path / "x").iterdir() if not p.name.startswith(".")) == ["basin-out"]


def test_kafka_options(spark):
    config = {"bootstrapServers": "a:1", "authType": "SASL_SCRAM", "scramMechanism": "SCRAM-SHA-512", "username": 'u"', "password": "p\\", "topic": "t", "deliveryGuarantee": "EXACTLY_ONCE"}
    options = sinks.kafka_write_options(config)
    assert options["kafka.sasl.mechanism"] == "SCRAM-SHA-512" and 'username="u\\""' in options["kafka.sasl.jaas.config"] and options["kafka.enable.idempotence"] == "true"
    raw = spark.createDataFrame([(b"k", b'{"a":1}', "t", 0, 5), (None, b"bad", "t", 0, 6)], "key binary, value binary, topic string, partition int, offset long").withColumn("timestamp", F.current_timestamp())
    assert [r["a"] for r in sources.kafka_records(raw, {"format": "JSON"}).collect()] == [1]


def test_count_windows_of_a_stream(spark, tmp_path):
    from sparkloom.streaming.stateful import count_windows

    spark.createDataFrame([("a", i, float(i)) for i in range(5)] + [("b", i, 1.0) for i in range(2)], "k string, n long, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, n long, v double").parquet(str(tmp_path / "in"))
    query = count_windows(stream, ["k"], 2, "n").writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = sorted((r["k"], r["_window"], r["n"]) for r in spark.table("windows").collect())
    assert rows == [("a", 0, 0), ("a", 0, 1), ("a", 1, 2), ("a", 1, 3), ("b", 0, 0), ("b", 0, 1)]


def _embedded(spark, tmp_path, rows, table="CALLS"):
    config = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver", "tablePath": table}
    _insert(spark, config, rows)
    return config


def _insert(spark, config, rows):
    df = spark.createDataFrame(rows, "BERTH long, SHIP string, FEE double, MOORED timestamp")
    df.write.format("jdbc").mode("append").option("createTableColumnTypes", "SHIP varchar(20)").option("url", config["url"]).option("driver", config["driver"]).option("dbtable", config["tablePath"]).save()


def _lines(spark, path):
    return sorted(json.loads(r[0])["BERTH"] for r in spark.read.text(path).collect())


@pytest.mark.parametrize(("field", "kind", "first"), [("BERTH", "LONG", 4), ("FEE", "DOUBLE", None), ("SHIP", "STRING", "a"), ("MOORED", "TIMESTAMP", "2031-02-03 00:00:00")])
def test_a_polled_database_is_a_stream(spark, tmp_path, field, kind, first):
    """Rows come once, after restarts too; those without a cursor or before the first one never."""
    at = lambda h: datetime(2031, 2, 3, h, 5, 6, 789_000)
    config = _embedded(spark, tmp_path, [(5, "b1", 10.5, at(1)), (6, "b2", 20.5, at(2)), (None, "", None, None)])
    polled = {**config, "readMode": "INCREMENTAL", "cursorField": field, "cursorType": kind, "initialCursorValue": first, "maxPolls": 2, "pollIntervalMillis": 200}
    out = str(tmp_path / "out")
    p = {"pipelineId": "calls", "nodes": [{"id": "s", "operator": "JDBC_SOURCE", "config": polled}, {"id": "k", "operator": "HDFS_FILE_SINK", "config": {"path": out, "file_format_type": "JSON"}}], "edges": [{"sourceNodeId": "s", "targetNodeId": "k"}]}

    def pass_over():
        engine = Engine(spark)
        for query in engine.start(p, str(tmp_path / "c"), trigger={"availableNow": True}):
            query.awaitTermination(120)
            assert query.exception() is None

    pass_over()
    assert _lines(spark, out) == [5, 6]
    _insert(spark, config, [(8, "b3", 30.5, at(3)), (7, "b4", 31.5, at(4))])
    pass_over()
    pass_over()
    assert _lines(spark, out) == [5, 6, 7, 8]


def test_polls_go_on_beside_a_running_stream(spark, tmp_path):
    config = _embedded(spark, tmp_path, [(5, "tern", 1.0, None)])
    source = {**config, "readMode": "INCREMENTAL", "cursorField": "BERTH", "cursorType": "LONG", "pollIntervalMillis": 200}
    out = str(tmp_path / "out")
    p = {"pipelineId": "calls", "nodes": [{"id": "s", "operator": "JDBC_SOURCE", "config": source}, {"id": "k", "operator": "HDFS_FILE_SINK", "config": {"path": out, "file_format_type": "JSON"}}], "edges": [{"sourceNodeId": "s", "targetNodeId": "k"}]}
    engine = Engine(spark)
    engine.start(p, str(tmp_path / "c"))
    try:
        for berths in ([5], [5, 9]):
            until = time.time() + 60
            while time.time() < until and not ((tmp_path / "out").exists() and _lines(spark, out) == berths):
                time.sleep(0.3)
            assert _lines(spark, out) == berths and engine.status() == {"calls": "RUNNING"}
            _insert(spark, config, [(9, "auk", 2.0, None)] if berths == [5] else [])
    finally:
        engine.stop("calls")
    assert engine.status() == {}


def test_bounded_polls(server):
    """A poll counts whether it finds rows or not, and there are no more than ``maxPolls``."""
    host, seen, answers = server
    hits = lambda *at: {"hits": {"hits": [{"_id": str(a), "_source": {"at": a}} for a in at]}}
    options = {"hosts": json.dumps([host]), "index": "berths", "cursorField": "at", "maxPolls": 2}
    tail = SearchIndexSource({"config": json.dumps(options)}).simpleStreamReader(None)
    offset, found = tail.initialOffset(), []
    for page in ([hits(3, 4), hits()], [hits()], [hits(9)], [hits(9)]):
        answers[:] = page
        rows, offset = tail.read(offset)
        found += [json.loads(r[0])["at"] for r in rows]
    assert found == [3, 4] and offset == {"cursor": "4", "polls": 2}


def test_upsert_keeps_the_last_by_number(spark, tmp_path):
    """9 comes before 10, though not as text."""
    config = _embedded(spark, tmp_path, [(4, "tern", 1.0, None)])
    df = spark.createDataFrame([(4, "skua", 10), (4, "smew", 9), (5, "knot", 100), (5, "auk", 99)], "BERTH long, SHIP string, nth long")
    sinks.jdbc(df, {**config, "fields": ["BERTH", "SHIP"], "writeMode": "UPSERT", "keyFields": ["BERTH"], "orderBy": "nth"})
    assert sorted((r["BERTH"], r["SHIP"]) for r in sources.jdbc(spark, config, False).collect()) == [(4, "skua"), (5, "knot")]


GOOD_SETTINGS = {
    "KAFKA_SOURCE": {"bootstrapServers": "h:1", "topics": "t"},
    "JDBC_SOURCE": {"url": "jdbc:derby:x", "tablePath": 'harbour."calls"', "readMode": "INCREMENTAL", "cursorField": "at", "cursorType": "LONG"},
    "ELASTICSEARCH_SOURCE": {"hosts": "http://h:1", "index": "Berths-*"},
    "INFLUXDB_SOURCE": {"url": "h:1", "database": "harbour", "sql": "select * from tide"},
    "HDFS_FILE_SOURCE": {"path": "/in", "file_format_type": "CSV"},
    "KAFKA_SINK": {"bootstrapServers": "h:1", "topic": "t"},
    "JDBC_SINK": {"url": "jdbc:derby:x", "tablePath": "calls", "fields": "ship,berth", "writeMode": "UPSERT", "keyFields": ["berth"]},
    "ELASTICSEARCH_SINK": {"hosts": ["h:1"], "index": "berths-${basin}", "authType": "API_KEY_ENCODED", "apiKeyEncoded": "x"},
    "INFLUXDB_SINK": {"url": "h:1", "database": "harbour", "measurement": "tide_${basin}"},
    "HDFS_FILE_SINK": {"path": "/out", "file_format_type": "JSON"},
}


@pytest.mark.parametrize(
    ("operator", "change"),
    [
        ("KAFKA_SOURCE", {"topics": []}),
        ("KAFKA_SOURCE", {"authType": "SASL_PLAIN"}),
        ("JDBC_SOURCE", {"tablePath": "calls; drop table calls"}),
        ("JDBC_SOURCE", {"cursorField": None}),
        ("JDBC_SOURCE", {"initialCursorValue": "noon"}),
        ("JDBC_SOURCE", {"maxPolls": -1}),
        ("ELASTICSEARCH_SOURCE", {"hosts": "http://h h"}),
        ("ELASTICSEARCH_SOURCE", {"scrollTime": "soon"}),
        ("ELASTICSEARCH_SOURCE", {"authType": "BASIC", "username": "u"}),
        ("INFLUXDB_SOURCE", {"sql": "drop database harbour"}),
        ("HDFS_FILE_SOURCE", {"file_filter_pattern": "("}),
        ("KAFKA_SINK", {"topic": " "}),
        ("JDBC_SINK", {"keyFields": ["ship", "berth"]}),
        ("JDBC_SINK", {"fields": "ship,ship"}),
        ("ELASTICSEARCH_SINK", {"index": "berths-${basin"}),
        ("ELASTICSEARCH_SINK", {"apiKeyEncoded": ""}),
        ("INFLUXDB_SINK", {"measurement": "tide ${basin}"}),
        ("INFLUXDB_SINK", {"keyTags": ["a b"]}),
        ("HDFS_FILE_SINK", {"file_format_type": "PAPER"}),
    ],
)
def test_settings_are_checked_before_a_run(operator, change):
    for config, ok in ((GOOD_SETTINGS[operator], True), ({**GOOD_SETTINGS[operator], **change}, False)):
        p = Pipeline.parse({"nodes": [{"id": "n", "operator": operator, "config": config}]})
        if ok:
            check_settings(p)
        else:
            with pytest.raises(ConfigError, match="node n: "):
                check_settings(p)
        check_settings(p, ["n"])
