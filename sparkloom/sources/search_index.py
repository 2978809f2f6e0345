"""Reading and tailing a search index over its scroll API, as Python data sources.

The rows are JSON texts of documents; the source operator parses them with the
declared or inferred schema.  ``slices`` reads a snapshot in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from sparkloom.sources.http import auth_headers, base_url, next_offset, polls_left, request_json


def _body(options: dict, cursor: object, slice_: tuple[int, int] | None) -> dict:
    query = json.loads(options.get("query") or "{}") or {"match_all": {}}
    body: dict = {"size": int(options.get("scrollSize", 100)), "query": query}
    source = json.loads(options.get("source") or "[]")
    if source:
        body["_source"] = [s for s in source if s != "_id"]
    field = options.get("cursorField")
    if field:
        must = [query]
        if cursor is not None:
            must.append({"range": {field: {"gt": cursor}}})
        body["query"] = {"bool": {"must": must}}
        body["sort"] = [{field: {"order": "asc"}}]
    if slice_ and slice_[1] > 1:
        body["slice"] = {"id": slice_[0], "max": slice_[1]}
    return body


def scroll(options: dict, cursor: object = None, slice_: tuple[int, int] | None = None) -> Iterator[dict]:
    """All documents of a query, page by page; the scroll is released at the end."""
    base = base_url(json.loads(options["hosts"])[0])
    headers = auth_headers(options)
    keep = options.get("scrollTime", "1m")
    wanted = json.loads(options.get("source") or "[]")
    page = request_json("POST", f"{base}/{options['index']}/_search?scroll={keep}", _body(options, cursor, slice_), headers)
    try:
        while hits := page.get("hits", {}).get("hits", []):
            for hit in hits:
                record = dict(hit.get("_source") or {})
                if not wanted or "_id" in wanted:
                    record["_id"] = hit.get("_id")
                yield record
            if not page.get("_scroll_id"):
                return
            page = request_json("POST", f"{base}/_search/scroll", {"scroll": keep, "scroll_id": page["_scroll_id"]}, headers)
    finally:
        if page.get("_scroll_id"):
            try:
                request_json("DELETE", f"{base}/_search/scroll", {"scroll_id": [page["_scroll_id"]]}, headers)
            except OSError:
                pass  # an open scroll ends by itself


class _Slice(InputPartition):
    def __init__(self, index: int, count: int) -> None:
        self.index, self.count = index, count


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        n = 1 if self.options.get("cursorField") else int(self.options.get("slices", 1))
        return [_Slice(i, n) for i in range(n)]

    def read(self, partition: _Slice) -> Iterator[tuple[str]]:
        field = self.options.get("cursorField")
        cursor = json.loads(self.options.get("initialCursor") or "null")
        for record in scroll(self.options, cursor, (partition.index, partition.count)):
            if not field or _at(record, field) is not None:
                yield (json.dumps(record),)


def _at(record: dict, path: str) -> object:
    if path in record:
        return record[path]
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"cursor": self.options.get("initialCursor") or "null"}

    def read(self, start: dict) -> tuple[Iterator[tuple[str]], dict]:
        if not polls_left(self.options, start):
            return iter([]), start
        field, last = self.options["cursorField"], json.loads(start["cursor"])
        rows = []
        for record in scroll(self.options, last):
            value = _at(record, field)
            if value is not None:
                rows.append((json.dumps(record),))
                last = value
        return iter(rows), next_offset(self.options, start, last)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str]]:
        field, last = self.options["cursorField"], json.loads(end["cursor"])
        return iter([(json.dumps(r),) for r in scroll(self.options, json.loads(start["cursor"])) if (v := _at(r, field)) is not None and v <= last])


class SearchIndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loom_search_index"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["config"]))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(json.loads(self.options["config"]))
