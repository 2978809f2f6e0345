"""Reading and tailing a time-series database over its query API, as Python data sources."""

from __future__ import annotations

import json
import re
import urllib.parse
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from sparkloom.model import ConfigError
from sparkloom.sources.http import base_url, next_offset, polls_left, request_json

#: Milliseconds of an epoch unit.
UNIT_MS = {"n": 1e-6, "u": 1e-3, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}


def epoch_unit(value: object) -> str:
    unit = str(value or "ms").lower()
    unit = {"us": "u", "ns": "n"}.get(unit, unit)
    if unit not in UNIT_MS:
        raise ConfigError(f"unknown epoch unit {value}")
    return unit


def checked_query(sql: str) -> str:
    """One SELECT statement without its closing semicolon."""
    sql = sql.strip().rstrip(";").strip()
    if not re.match(r"(?i)select\s", sql) or ";" in sql:
        raise ConfigError("sql must be a single SELECT statement")
    return sql


def with_cursor(sql: str, field: str, cursor: object) -> str:
    """The query for rows after a cursor: in place of ``${cursor}``, or as a condition before the closing clauses."""
    literal = "'" + str(cursor).replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(cursor, str) else str(cursor)
    if "${cursor}" in sql:
        return sql.replace("${cursor}", literal)
    cut = re.search(r"(?i)\s(?:group\s+by|order\s+by|limit|slimit|tz\()", sql)
    head, tail = (sql[: cut.start()], sql[cut.start() :]) if cut else (sql, "")
    return f"{head} {'and' if re.search(r'(?i)\swhere\s', head) else 'where'} {field} > {literal}{tail}"


def query(config: dict, cursor: object = None) -> Iterator[dict]:
    """Rows of a query: measurement, tags and columns."""
    sql = config["sql"]
    if config.get("cursorField") and cursor is not None:
        sql = with_cursor(sql, config["cursorField"], cursor)
    parameters = {"db": config["database"], "q": sql, "epoch": epoch_unit(config.get("epoch"))}
    if config.get("username"):
        parameters |= {"u": config["username"], "p": config.get("password") or ""}
    answer = request_json("GET", f"{base_url(config['url'])}/query?{urllib.parse.urlencode(parameters)}", timeout=float(config.get("queryTimeoutSeconds") or 30))
    if answer.get("error"):
        raise OSError(answer["error"])
    for result in answer.get("results", []):
        if result.get("error"):
            raise OSError(result["error"])
        for series in result.get("series", []):
            for values in series.get("values", []):
                yield {"_measurement": series.get("name"), **(series.get("tags") or {}), **dict(zip(series.get("columns", []), values, strict=False))}


class _Reader(DataSourceReader):
    def __init__(self, config: dict) -> None:
        self.config = config

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        field = self.config.get("cursorField")
        for row in query(self.config, json.loads(self.config.get("initialCursor") or "null")):
            if not field or row.get(field) is not None:
                yield (json.dumps(row),)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, config: dict) -> None:
        self.config = config

    def initialOffset(self) -> dict:
        return {"cursor": self.config.get("initialCursor") or "null"}

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        if not polls_left(self.config, start):
            return iter([]), start
        field, last = self.config["cursorField"], json.loads(start["cursor"])
        rows = [r for r in query(self.config, last) if r.get(field) is not None]
        end = max([r[field] for r in rows], default=last)
        return iter([(json.dumps(r),) for r in rows]), next_offset(self.config, start, end)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
        field, last = self.config["cursorField"], json.loads(end["cursor"])
        return iter([(json.dumps(r),) for r in query(self.config, json.loads(start["cursor"])) if r.get(field) is not None and r[field] <= last])


class TimeSeriesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loom_time_series"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["config"]))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(json.loads(self.options["config"]))
