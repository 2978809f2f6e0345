"""``python -m sparkloom pipeline.json [--preview | --stream FOLDER]``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from sparkloom.engine import Engine
from sparkloom.model import Pipeline


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sparkloom")
    parser.add_argument("file")
    parser.add_argument("--preview", action="store_true", help="run on sample data and print what reaches the sinks")
    parser.add_argument("--stream", metavar="FOLDER", help="run as a stream with checkpoints below FOLDER")
    chosen = parser.parse_args(arguments)
    engine, pipeline = Engine(SparkSession.builder.appName("sparkloom").getOrCreate()), Pipeline.load(chosen.file)
    if chosen.preview:
        print(json.dumps(engine.preview(pipeline), ensure_ascii=False))
    elif chosen.stream:
        for query in engine.start(pipeline, chosen.stream):
            query.awaitTermination()
    else:
        print(json.dumps(engine.run(pipeline, count=True).metrics()))


if __name__ == "__main__":
    main()
