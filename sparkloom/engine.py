"""Runs pipelines: in batch, as streams, or on samples."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.model import Node, Pipeline, number
from sparkloom.operators import REGISTRY, Context
from sparkloom.plans.planner import topological, union
from sparkloom.sinks import SINKS, payload
from sparkloom.settings import check_settings
from sparkloom.sources import SOURCES, mock
from sparkloom.sources.polling import Poller
from sparkloom.streaming.stateful import stateful_streams
from sparkloom.validate import validate


@dataclass
class Run:
    """What a batch run wrote: for each node, the records of each of its ports."""

    counters: dict[str, Observation] = field(default_factory=dict)

    def metrics(self) -> dict[str, int]:
        """Records by ``node/port`` of what was computed."""
        return {k: o.get.get("n", 0) for k, o in self.counters.items()}


class Engine:
    """Validates pipelines and turns them into Spark plans.

    ``functions`` are the Python functions that CUSTOM_CODE may name.
    """

    def __init__(self, spark: SparkSession, functions: dict[str, Callable] | None = None) -> None:
        self.spark, self.functions = spark, dict(functions or {})
        self.queries: dict[str, list[StreamingQuery]] = {}
        self.pollers: dict[str, list[Poller]] = {}

    @staticmethod
    def parse(definition: str | dict[str, Any] | Pipeline) -> Pipeline:
        return definition if isinstance(definition, Pipeline) else Pipeline.parse(definition)

    def validate(self, definition: str | dict[str, Any] | Pipeline, mode: str = "run") -> None:
        """Structure and expressions; ``complete`` also the connectors' settings, which a run checks before it starts."""
        pipeline = self.parse(definition)
        validate(pipeline, "run" if mode == "complete" else mode)
        if mode == "complete":
            check_settings(pipeline)

    def plan(self, definition: str | dict[str, Any] | Pipeline, *, streaming: bool = False, samples: bool = False, run: Run | None = None, inputs: dict[str, DataFrame] | None = None, polled: dict[str, Poller] | None = None) -> dict[str, DataFrame]:
        """The DataFrame that reaches each sink.  ``inputs`` replaces sources by DataFrames, ``polled`` by what pollers land."""
        pipeline = self.parse(definition)
        ports: dict[tuple[str, str], DataFrame] = {}
        sinks: dict[str, DataFrame] = {}
        for node in topological(pipeline):
            if node.operator in SOURCES:
                made = {"output-0": polled[node.id].stream() if polled and node.id in polled else self._source(node, streaming, samples, inputs or {})}
            else:
                arriving: dict[str, list[DataFrame]] = {}
                for e in pipeline.edges:
                    if e.target == node.id and (e.source, e.source_port) in ports:
                        arriving.setdefault(e.target_port, []).append(ports[e.source, e.source_port])
                joined = {p: union(d) for p, d in arriving.items()}
                if not joined:
                    continue
                if node.operator in SINKS:
                    sinks[node.id] = self._counted(union([*joined.values()]), node.id, "input", run)
                    continue
                made = REGISTRY[node.operator](joined, node.config, Context(node.id, self.functions))
            # A port that no edge leaves is never computed, and a counter on it would be waited for in vain.
            read = {e.source_port for e in pipeline.edges if e.source == node.id}
            for port, df in made.items():
                ports[node.id, port] = self._counted(df, node.id, port, run if port in read else None)
        return sinks

    def _source(self, node: Node, streaming: bool, samples: bool, inputs: dict[str, DataFrame]) -> DataFrame:
        if node.id in inputs:
            return inputs[node.id]
        if samples or node.config.get("useMockSource") in (True, "true"):
            return mock(self.spark, node.config)
        return SOURCES[node.operator](self.spark, node.config, streaming)

    def _counted(self, df: DataFrame, node: str, port: str, run: Run | None) -> DataFrame:
        if run is None or df.isStreaming:
            return df
        name = f"{node}/{port}"
        run.counters[name] = Observation(name)
        return df.observe(run.counters[name], F.count(F.lit(1)).alias("n"))

    def run(self, definition: str | dict[str, Any] | Pipeline, *, inputs: dict[str, DataFrame] | None = None, count: bool = False) -> Run:
        """Validates and runs a pipeline over what its sources hold now."""
        pipeline, run = self.parse(definition), Run()
        validate(pipeline)
        check_settings(pipeline, inputs or ())
        by = {n.id: n for n in pipeline.nodes}
        for sink, df in self.plan(pipeline, run=run if count else None, inputs=inputs).items():
            SINKS[by[sink].operator](df, by[sink].config)
        return run

    def preview(self, definition: str | dict[str, Any] | Pipeline, limit: int = 1000) -> dict[str, list[dict[str, Any]]]:
        """Runs on sample data; what reaches each sink as payload texts, by sink id."""
        pipeline = self.parse(definition)
        validate(pipeline, "preview")
        by = {n.id: n for n in pipeline.nodes}
        found = self.plan(pipeline, samples=True)
        outputs = [{"nodeId": s, "records": [r["value"] for r in payload(found[s], by[s].config if by[s].operator == "KAFKA_SINK" else {}).select("value").limit(limit).collect()]} for s in sorted(found)]
        return {"outputs": outputs}

    def start(self, definition: str | dict[str, Any] | Pipeline, checkpoint: str, *, inputs: dict[str, DataFrame] | None = None, trigger: dict[str, Any] | None = None) -> list[StreamingQuery]:
        """Starts a pipeline as streams, one query a sink, each with its own checkpoint folder.

        Databases are polled by this driver.  Without a ``trigger``, batches follow
        the shortest ``pollIntervalMillis`` of the sources.  A trigger that ends with
        what is there (``availableNow``, ``once``) sees the polls made before it.
        """
        pipeline = self.parse(definition)
        validate(pipeline)
        check_settings(pipeline, inputs or ())
        by, folder = {n.id: n for n in pipeline.nodes}, checkpoint.rstrip("/")
        live = [n for n in pipeline.nodes if n.operator in SOURCES and n.id not in (inputs or {}) and n.config.get("useMockSource") not in (True, "true")]
        polled = {n.id: Poller(self.spark, n.config, f"{folder}/polled-{n.id}") for n in live if n.operator == "JDBC_SOURCE"}
        pauses = [number(n.config, "pollIntervalMillis", 5000, 1) for n in live if str(n.config.get("readMode") or "").upper() == "INCREMENTAL"]
        sinks = self.plan(pipeline, streaming=True, inputs=inputs, polled=polled)
        ends = bool(trigger) and bool(trigger.get("availableNow") or trigger.get("once"))
        if ends:
            for poller in polled.values():
                poller.catch_up()
        self.queries[pipeline.id], self.pollers[pipeline.id] = [], list(polled.values())
        for sink, df in sinks.items():
            write, config = SINKS[by[sink].operator], by[sink].config

            def batch(rows: DataFrame, _: int, write=write, config=config) -> None:
                write(rows, config)

            writer = df.writeStream.queryName(f"{pipeline.id or 'pipeline'}-{sink}").foreachBatch(batch).outputMode("append").option("checkpointLocation", f"{folder}/{sink}")
            with stateful_streams(self.spark):
                self.queries[pipeline.id].append(writer.trigger(**(trigger or {"processingTime": f"{min(pauses, default=10_000)} milliseconds"})).start())
        if not ends:
            for poller in polled.values():
                poller.start()
        return self.queries[pipeline.id]

    def stop(self, pipeline_id: str) -> None:
        for poller in self.pollers.pop(pipeline_id, []):
            poller.stop()
        for query in self.queries.pop(pipeline_id, []):
            query.stop()

    def status(self) -> dict[str, str]:
        """RUNNING, FAILED, DEGRADED or STOPPED for each started pipeline; FAILED also where polls ended by an error."""
        out = {}
        for name, queries in self.queries.items():
            active, failed = sum(q.isActive for q in queries), sum(q.exception() is not None for q in queries)
            lost = any(p.error is not None for p in self.pollers.get(name, []))
            out[name] = "FAILED" if lost or failed == len(queries) else "DEGRADED" if failed else "RUNNING" if active else "STOPPED"
        return out

    def metrics(self, pipeline_id: str) -> dict[str, dict[str, float]]:
        """Rows and rates of the last batch of each query of a started pipeline."""
        out = {}
        for query in self.queries.get(pipeline_id, []):
            last = query.lastProgress
            out[query.name] = {"input_records": last.numInputRows, "input_rate": last.inputRowsPerSecond, "processed_rate": last.processedRowsPerSecond} if last else {}
        return out
