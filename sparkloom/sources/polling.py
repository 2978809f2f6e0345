"""A database as a stream: polls land as files, and the stream reads the files.

Each poll takes the largest cursor there is now and reads the rows after the last
one up to it, in Spark and in parallel where the configuration says so.  The rows
are written beside the landing folder together with the new cursor and then moved
there by one rename: a poll has landed with its cursor, or not at all, and a batch
that is run again reads the same rows.  After a restart polls go on from the last
cursor that landed.

Rows without a cursor are skipped, and so are rows that the database commits with
a cursor at or below one that was read before.  A poll without new rows lands
nothing.  FULL is one poll of everything, once.  Landed files stay until their
folder, below that of the checkpoints, is removed.
"""

from __future__ import annotations

import json
import threading
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.model import choice, number, text
from sparkloom.sources import described, jdbc_query, jdbc_rows, read_mode

CURSOR = "_cursor"


class Poller:
    """Polls of one source into ``folder``, by hand or in a thread of their own."""

    def __init__(self, spark: SparkSession, config: dict[str, Any], folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.mode, self.config = read_mode(config)
        self.kind = choice(config, "cursorType", ("STRING", "LONG", "DOUBLE", "TIMESTAMP"), "STRING")
        self.pause = number(config, "pollIntervalMillis", 5000, 1) / 1000
        self.most = number(config, "maxPolls", 0, 0) if self.mode == "INCREMENTAL" else 1
        self.error: Exception | None = None
        self._ended, self._thread = threading.Event(), None
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def stream(self) -> DataFrame:
        """What has landed and will land."""
        landed = f"{self.folder}/landed"
        self._files.mkdirs(self._path(landed))
        schema = jdbc_rows(self.spark, self.config, jdbc_query(self.config, self.config.get("initialCursorValue"))).schema
        return described(self.spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(landed), self.config)

    def _last(self) -> tuple[int, Any]:
        """How many polls have landed, and the cursor of the last."""
        landed = sorted(s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.folder}/landed")))
        if not landed:
            return 0, self.config.get("initialCursorValue")
        opened = self._files.open(self._path(f"{self.folder}/landed/{landed[-1]}/{CURSOR}"))
        try:
            return int(landed[-1].rsplit("-", 1)[1]) + 1, json.loads(bytes(opened.readAllBytes()))
        finally:
            opened.close()

    def _top(self, cursor: Any) -> Any:
        """The largest cursor after ``cursor``; a time as the database's clock shows it."""
        statement = f"select max({text(self.config, 'cursorField')}) loom_top from ({jdbc_query(self.config, cursor)}) loom_polled"
        found = jdbc_rows(self.spark, {**self.config, "partitionColumn": None}, statement, preferTimestampNTZ="true")
        top = found.select(F.col(found.columns[0]).cast({"LONG": "bigint", "DOUBLE": "double"}.get(self.kind, "string"))).collect()[0][0]
        return None if top == cursor else top

    def poll(self) -> bool:
        """Whether new rows landed."""
        landed, cursor = self._last()
        top = self._top(cursor) if self.mode == "INCREMENTAL" else None
        if (self.mode == "FULL" and landed) or (self.mode == "INCREMENTAL" and top is None):
            return False
        staged = f"{self.folder}/staged/{uuid.uuid4().hex}"
        jdbc_rows(self.spark, self.config, jdbc_query(self.config, cursor, top)).write.parquet(staged)
        written = self._files.create(self._path(f"{staged}/{CURSOR}"))
        written.write(bytearray(json.dumps(top).encode()))
        written.close()
        if not self._files.rename(self._path(staged), self._path(f"{self.folder}/landed/poll-{landed:012d}")):
            raise OSError(f"cannot move {staged}")
        return True

    def _run(self) -> None:
        done = 0
        try:
            while not self._ended.is_set():
                self.poll()
                done += 1
                if done == self.most:
                    return
                self._ended.wait(self.pause)
        except Exception as e:  # kept for the status of the pipeline, which has no other way to see a thread's end
            self.error = e

    def start(self) -> None:
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def catch_up(self) -> None:
        """As many polls as the configuration bounds, else one: for streams that end with what is there."""
        for _ in range(self.most or 1):
            self.poll()

    def stop(self) -> None:
        """Ends the polls; one that runs is waited for."""
        self._ended.set()
        if self._thread is not None:
            self._thread.join(60)
