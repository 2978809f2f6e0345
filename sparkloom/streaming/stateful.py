"""Stateful operators that Structured Streaming has no built-in form for."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cmp_to_key

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: The session's state store; stateful processors need one with several columns, as RocksDB has.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def stateful_streams(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own setting is restored."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class CountWindows(StatefulProcessor):
    """Collects rows of a key and emits them, numbered by window, whenever ``size`` have come."""

    def __init__(self, size: int, row: T.StructType, order: str) -> None:
        self.size, self.row, self.order = size, row, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", self.row)
        self.count = handle.getValueState("count", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        names = self.row.fieldNames()
        arrived = [tuple(r) for batch in rows for r in batch[names].sort_values(self.order).itertuples(index=False)]
        waiting = [*(tuple(r) for r in self.waiting.get()), *arrived]
        done = self.count.get()[0] if self.count.exists() else 0
        whole = len(waiting) // self.size * self.size
        self.waiting.clear()
        if waiting[whole:]:
            self.waiting.put(waiting[whole:])
        if whole:
            out = pd.DataFrame(waiting[:whole], columns=names)
            out["_window"] = [done + i // self.size for i in range(whole)]
            self.count.update((done + whole // self.size,))
            yield out

    def close(self) -> None:
        pass


def count_windows(df: DataFrame, keys: list[str], size: int, order: str) -> DataFrame:
    """Rows of full count windows of a stream, with ``_window``: the window's number in its key.

    Aggregating by key and ``_window`` downstream gives the window's result; a
    window that is not full is kept in the state and never emitted.
    """
    keyed = df
    if not keys:
        keyed, keys = keyed.withColumn("_all", F.lit(0)), ["_all"]
    schema = keyed.schema
    result = T.StructType([*schema.fields, T.StructField("_window", T.LongType())])
    out = keyed.groupBy(*keys).transformWithStateInPandas(CountWindows(size, schema, order), result, "Append", "None")
    return out.drop("_all")


def window_metric(spec: dict, values: list, sorts: list) -> object:
    """One aggregation over a window's values in order of arrival, as the batch form defines it."""
    function = str(spec["function"]).upper()
    known = [v for v in values if v is not None]
    if function == "COUNT":
        return len(values)
    if function == "SUM":
        return float(sum(known))
    if function in ("AVG", "MIN", "MAX"):
        return {"AVG": lambda: sum(known) / len(known), "MIN": lambda: min(known), "MAX": lambda: max(known)}[function]() if known else None
    if function in ("FIRST_VALUE", "LAST_VALUE"):
        return known[0 if function == "FIRST_VALUE" else -1] if known else None
    if function == "COLLECT_LIST":
        return known
    distinct = [v for i, v in enumerate(known) if v not in known[:i]]
    if function == "COLLECT_SET":
        return distinct
    if function == "COUNT_DISTINCT":
        return len(distinct)
    limit, ascending = int(spec.get("limit") or spec.get("topNSize") or 10), str(spec.get("sortDirection") or "DESC").upper() == "ASC"

    def compare(a: tuple, b: tuple) -> int:
        x, y = a[0], b[0]
        try:
            x, y = float(x), float(y)
        except (TypeError, ValueError):
            pass
        return ((x > y) - (x < y)) * (1 if ascending else -1)

    return [v for _, v in sorted(((s, v) for s, v in zip(sorts, values, strict=True) if v is not None), key=cmp_to_key(compare))][:limit]


class CountWindowMetrics(StatefulProcessor):
    """Collects the values of a key and emits the metrics of every ``size`` rows that have come."""

    def __init__(self, size: int, specs: list[dict], row: T.StructType, groups: list[str], result: T.StructType) -> None:
        self.size, self.specs, self.row, self.groups, self.result = size, specs, row, groups, result

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", self.row)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        names = self.row.fieldNames()
        known = lambda x: None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x
        # Values come by position: a batch's columns need not carry the names of the state.
        arrived = [tuple(map(known, r[: len(names)])) for batch in rows for r in batch.astype(object).itertuples(index=False, name=None)]
        waiting = [*(tuple(r) for r in self.waiting.get()), *arrived]
        whole = len(waiting) // self.size * self.size
        self.waiting.clear()
        if waiting[whole:]:
            self.waiting.put(waiting[whole:])
        out = []
        for at in range(0, whole, self.size):
            columns = dict(zip(names, zip(*waiting[at : at + self.size], strict=True), strict=True))
            metrics = [window_metric(s, list(columns[f"_v{i}"]), list(columns[f"_s{i}"])) for i, s in enumerate(self.specs)]
            out.append([*(columns[g][0] for g in self.groups), *metrics])
        if out:
            yield pd.DataFrame(out, columns=self.result.fieldNames())

    def close(self) -> None:
        pass


def count_window_metrics(df: DataFrame, groups: list[Column], size: int, specs: list[dict], inputs: list[Column], result: T.StructType) -> DataFrame:
    """Groups and metrics of the full count windows of a stream, in order of arrival; a window that is not full stays in the state."""
    rows = df.select(*groups, *inputs, F.lit(0).alias("_all"))
    names = [n for n in result.fieldNames() if n.startswith("_g")]
    row = T.StructType(rows.schema.fields[:-1])
    return rows.groupBy(*(names or ["_all"])).transformWithStateInPandas(CountWindowMetrics(size, specs, row, names, result), result, "Append", "None")


class Deduplicator(StatefulProcessor):
    """First or last row of a key; the key is free again ``ttl`` after its first row."""

    def __init__(self, ttl_ms: int, last: bool, row: T.StructType) -> None:
        self.ttl_ms, self.last, self.row = ttl_ms, last, row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.row)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        fresh = not self.held.exists()
        first, newest = None, None
        for batch in rows:
            records = [tuple(r) for r in batch[self.row.fieldNames()].itertuples(index=False)]
            if records:
                first, newest = first or records[0], records[-1]
        if newest is None:
            return
        if fresh:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.ttl_ms)
        if fresh or self.last:
            self.held.update(newest if self.last else first)
        if fresh and not self.last:
            yield pd.DataFrame([first], columns=self.row.fieldNames())

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        held = self.held.get() if self.held.exists() else None
        self.held.clear()
        if self.last and held is not None:
            yield pd.DataFrame([tuple(held)], columns=self.row.fieldNames())

    def close(self) -> None:
        pass


def deduplicate_stream(df: DataFrame, keys: list[Column], ttl_seconds: int, keep: str) -> DataFrame:
    """Processing-time deduplication with a time to live that duplicates do not renew."""
    keyed = df.select("*", *[k.cast("string").alias(f"_k{i}") for i, k in enumerate(keys)])
    processor = Deduplicator(ttl_seconds * 1000, keep == "LAST", keyed.schema)
    out = keyed.groupBy(*[f"_k{i}" for i in range(len(keys))]).transformWithStateInPandas(processor, keyed.schema, "Append", "ProcessingTime")
    return out.drop(*[f"_k{i}" for i in range(len(keys))])
