"""Checks of connectors' settings, before a plan is made or anything is reached."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from typing import Any

from sparkloom.model import ConfigError, Pipeline, choice, names, number, text
from sparkloom.sinks import kafka_write_options
from sparkloom.sources import TABLE_PATH, file_format, file_path, jdbc_query, kafka_read_options, read_mode
from sparkloom.sources.time_series import checked_query, epoch_unit

Settings = dict[str, Any]
# What names in connectors' settings may be made of.
FIELD = r"[A-Za-z_][A-Za-z0-9_]*"
PATH = r"[A-Za-z_][A-Za-z0-9_.]*"
FILE_FIELD = r"[A-Za-z_][A-Za-z0-9_.-]*"
DATABASE = r"[A-Za-z0-9_.$-]+"
INDEX = r"[A-Za-z0-9_.*,+-]+"
MEASUREMENT = r"[A-Za-z0-9_.$,+-]+"
HOST = r"(https?://)?[A-Za-z0-9._:-]+/?"
SCROLL_TIME = r"[1-9][0-9]*(ms|s|m|h)"


def _shaped(what: str, values: Iterable[str], pattern: str) -> None:
    """Each value of the form, and none twice."""
    seen = set()
    for value in values:
        if not re.fullmatch(pattern, value):
            raise ConfigError(f"{what} has an unusable value: {value!r}")
        if value in seen:
            raise ConfigError(f"{what} names {value!r} twice")
        seen.add(value)


def _template(config: Settings, key: str, placeholder: str, literal: str) -> None:
    """A name made of literal pieces and ``${field}``."""
    whole = text(config, key)
    rest = re.sub(r"\$\{" + placeholder + r"\}", "", whole)
    if rest and not re.fullmatch(literal, rest):
        raise ConfigError(f"{key} has an unusable value: {whole!r}")


def _polls(config: Settings, cursor: str) -> None:
    mode, kept = read_mode(config)
    if mode == "INCREMENTAL":
        _shaped("cursorField", [text(kept, "cursorField")], cursor)
        kind = choice(kept, "cursorType", ("STRING", "LONG", "DOUBLE", "TIMESTAMP"), "STRING")
        value = kept.get("initialCursorValue")
        if value not in (None, "") and kind in ("LONG", "DOUBLE"):
            try:
                int(value) if kind == "LONG" else float(value)
            except (TypeError, ValueError):
                raise ConfigError(f"initialCursorValue must be a {kind}: {value!r}") from None
    number(config, "pollIntervalMillis", 5000, 1)
    number(config, "maxPolls", 0, 0)


def _kafka_source(config: Settings) -> None:
    kafka_read_options(config, True)
    choice(config, "format", ("JSON", "TEXT"), "JSON")


def _kafka_sink(config: Settings) -> None:
    kafka_write_options(config)
    choice(config, "format", ("JSON", "TEXT"), "JSON")


def _jdbc_source(config: Settings) -> None:
    text(config, "url")
    number(config, "fetchSize", 1000, 1)
    _polls(config, rf'"?{FIELD}"?')
    jdbc_query(read_mode(config)[1])


def _jdbc_sink(config: Settings) -> None:
    text(config, "url")
    number(config, "batchSize", 500, 1)
    if not TABLE_PATH.fullmatch(text(config, "tablePath")):
        raise ConfigError("tablePath must be a table name, with schema and catalogue at most")
    fields, keys = names(config, "fields", required=True), names(config, "keyFields")
    _shaped("fields", fields, PATH)
    if choice(config, "writeMode", ("INSERT", "UPSERT"), "INSERT") == "UPSERT" and not (keys and set(keys) < set(fields)):
        raise ConfigError("keyFields must be among fields, and not all of them")


def _authorised(config: Settings) -> None:
    wanted = {"NONE": (), "BASIC": ("username", "password"), "API_KEY": ("apiKey",), "API_KEY_ENCODED": ()}
    kind = choice(config, "authType", tuple(wanted), "NONE")
    for key in wanted[kind]:
        text(config, key)
    if kind == "API_KEY_ENCODED" and not (config.get("apiKeyEncoded") or config.get("apiKey")):
        raise ConfigError("apiKeyEncoded is required")


def _search_source(config: Settings) -> None:
    _shaped("hosts", names(config, "hosts", required=True), HOST)
    _shaped("index", [text(config, "index")], INDEX)
    _shaped("source", names(config, "source"), PATH)
    _shaped("scrollTime", [str(config.get("scrollTime") or "1m")], SCROLL_TIME)
    number(config, "scrollSize", 100, 1)
    _authorised(config)
    _polls(config, PATH)


def _search_sink(config: Settings) -> None:
    _shaped("hosts", names(config, "hosts", required=True), HOST)
    _template(config, "index", PATH, INDEX)
    for key in ("fields", "primaryKeys"):
        _shaped(key, names(config, key), PATH)
    if config.get("indexType"):
        _shaped("indexType", [str(config["indexType"])], INDEX)
    number(config, "maxBatchSize", 10, 1)
    number(config, "maxRetryCount", 3, 0)
    _authorised(config)


def _series_source(config: Settings) -> None:
    text(config, "url")
    _shaped("database", [text(config, "database")], DATABASE)
    checked_query(text(config, "sql"))
    epoch_unit(config.get("epoch"))
    _polls(config, FIELD)


def _series_sink(config: Settings) -> None:
    text(config, "url")
    _shaped("database", [text(config, "database")], DATABASE)
    _template(config, "measurement", FIELD, MEASUREMENT)
    for key in ("fields", "keyTags"):
        _shaped(key, names(config, key), FIELD)
    epoch_unit(config.get("precision"))
    number(config, "batchSize", 100, 1)
    number(config, "maxRetries", 3, 0)


def _file_source(config: Settings) -> None:
    file_format(config)
    file_path(config)
    _shaped("read_columns", names(config, "read_columns"), FILE_FIELD)
    number(config, "skip_header_row_number", 0, 0)
    choice(config, "readMode", ("FULL", "INCREMENTAL"), "FULL")
    try:
        re.compile(str(config.get("file_filter_pattern") or ""))
    except re.error as e:
        raise ConfigError(f"file_filter_pattern: {e}") from None


def _file_sink(config: Settings) -> None:
    file_format(config)
    file_path(config)
    for key in ("sink_columns", "partition_by"):
        _shaped(key, names(config, key), FILE_FIELD)


CHECKS: dict[str, Callable[[Settings], None]] = {
    "KAFKA_SOURCE": _kafka_source, "JDBC_SOURCE": _jdbc_source, "ELASTICSEARCH_SOURCE": _search_source, "INFLUXDB_SOURCE": _series_source, "HDFS_FILE_SOURCE": _file_source,
    "KAFKA_SINK": _kafka_sink, "JDBC_SINK": _jdbc_sink, "ELASTICSEARCH_SINK": _search_sink, "INFLUXDB_SINK": _series_sink, "HDFS_FILE_SINK": _file_sink,
}


def check_settings(pipeline: Pipeline, given: Iterable[str] = ()) -> None:
    """Settings of all connectors that a run will use: not of mock sources, nor of nodes whose data is ``given``."""
    for node in pipeline.nodes:
        if node.operator not in CHECKS or node.id in given or node.config.get("useMockSource") in (True, "true"):
            continue
        try:
            CHECKS[node.operator](node.config)
        except ConfigError as e:
            raise ConfigError(f"node {node.id}: {e}") from None
