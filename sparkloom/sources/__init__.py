"""Sources: each builds a DataFrame, batch or streaming, from its configuration."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.model import MESSAGE, RECORD_HEADERS, RECORD_ID, RECORD_ORDER, RECORD_TIME, ConfigError, choice, flag, names, number, text
from sparkloom.operators.serde import _inferred, _is_object
from sparkloom.paths import as_text, column, lookup
from sparkloom.sources.search_index import SearchIndexSource
from sparkloom.sources.time_series import UNIT_MS, TimeSeriesSource, checked_query, epoch_unit

#: Names of a table with schema and catalogue at most, each plain or in quotes.
TABLE_PATH = re.compile(r"""([\w$]+|"[\w$]+"|`[\w$]+`)(\.([\w$]+|"[\w$]+"|`[\w$]+`)){0,2}""", re.ASCII)


def parse_payload(df: DataFrame, form: str, schema: str | None, payload: str = "_payload") -> DataFrame:
    """Payload texts as fields; JSON that is no object is skipped."""
    if form == "TEXT":
        return df.withColumnRenamed(payload, MESSAGE)
    good = df.where(_is_object(F.col(payload)))
    schema = schema or (None if df.isStreaming else _inferred(df, F.col(payload)))
    if schema is None:
        raise ConfigError("a stream of JSON needs a schema")
    rest = [c for c in df.columns if c != payload]
    if schema == "STRUCT<>":
        return good.select(*rest)
    parsed = good.withColumn("_fields", F.from_json(payload, schema))
    return parsed.select("_fields.*", *[c for c in rest if c not in parsed.select("_fields.*").columns])


def identified(df: DataFrame, config: dict[str, Any], fallback: Column | None = None) -> DataFrame:
    """Adds the record's id and time from ``idField`` and ``timestampField``."""
    id_ = lookup(df.schema, str(config.get("idField") or ""))
    at = lookup(df.schema, str(config.get("timestampField") or ""))
    own = fallback if fallback is not None else F.expr("uuid()")
    now = F.unix_millis(F.current_timestamp())
    time = now
    if at is not None:
        time = F.coalesce(F.unix_millis(at.column.cast("timestamp")) if isinstance(at.type, (T.TimestampType, T.TimestampNTZType)) else as_text(at).try_cast("bigint"), F.unix_millis(F.try_to_timestamp(as_text(at))), now)
    return df.withColumn(RECORD_ID, F.coalesce(as_text(id_), own) if id_ else own).withColumn(RECORD_TIME, time)


def mock(spark: SparkSession, config: dict[str, Any]) -> DataFrame:
    """Sample payloads in order; bad ones are skipped."""
    form = choice(config, "format", ("JSON", "TEXT"), "JSON")
    samples = config.get("sampleData") or (['{"message":"Sample data"}'] if form == "JSON" else ["Sample data"])
    if not isinstance(samples, list) or not all(isinstance(s, str) for s in samples):
        raise ConfigError("sampleData must be an array of strings")
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], f"{RECORD_ORDER} long, _payload string")
    parsed = parse_payload(rows, form, config.get("schema"))
    headers = F.create_map(F.lit("source"), F.lit("mock"))
    return parsed.withColumn(RECORD_ID, F.expr("uuid()")).withColumn(RECORD_TIME, F.unix_millis(F.current_timestamp())).withColumn(RECORD_HEADERS, headers)


def kafka_options(config: dict[str, Any]) -> dict[str, str]:
    """Connection and authentication options, for reading and writing."""
    out = {"kafka.bootstrap.servers": ",".join(names(config, "bootstrapServers", required=True))}
    kind = choice(config, "authType", ("NONE", "SASL_PLAIN", "SASL_SCRAM"), "NONE")
    if kind == "NONE":
        return out
    quote = lambda s: s.replace("\\", "\\\\").replace('"', '\\"')
    user, password = quote(text(config, "username")), quote(text(config, "password"))
    if kind == "SASL_PLAIN":
        mechanism, module = "PLAIN", "org.apache.kafka.common.security.plain.PlainLoginModule"
    else:
        mechanism = choice(config, "scramMechanism", ("SCRAM-SHA-256", "SCRAM-SHA-512"), "SCRAM-SHA-256")
        module = "org.apache.kafka.common.security.scram.ScramLoginModule"
    jaas = f'{module} required username="{user}" password="{password}";'
    return out | {"kafka.security.protocol": "SASL_PLAINTEXT", "kafka.sasl.mechanism": mechanism, "kafka.sasl.jaas.config": jaas}


def kafka_read_options(config: dict[str, Any], streaming: bool) -> dict[str, str]:
    """``committed`` has no counterpart: Spark keeps offsets in its own checkpoint, and starts at the earliest."""
    mode = choice(config, "consumeMode", ("EARLIEST", "LATEST", "COMMITTED"), "LATEST")
    out = kafka_options(config) | {"subscribe": ",".join(names(config, "topics", required=True)), "failOnDataLoss": "true" if mode == "COMMITTED" else "false"}
    if config.get("groupId"):
        out["kafka.group.id" if flag(config, "useGroupId") else "groupIdPrefix"] = str(config["groupId"])
    return out | {"startingOffsets": "latest" if mode == "LATEST" and streaming else "earliest"}


def kafka(spark: SparkSession, config: dict[str, Any], streaming: bool) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).format("kafka").options(**kafka_read_options(config, streaming))
    return kafka_records(reader.load(), config)


def kafka_records(raw: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Records from the columns that a Kafka reader gives."""
    headers = F.create_map(F.lit("topic"), F.col("topic"), F.lit("partition"), F.col("partition").cast("string"), F.lit("offset"), F.col("offset").cast("string"))
    rows = raw.select(
        F.col("value").cast("string").alias("_payload"),
        F.coalesce(F.col("key").cast("string"), F.expr("uuid()")).alias(RECORD_ID),
        F.unix_millis(F.col("timestamp").cast("timestamp")).alias(RECORD_TIME),
        headers.alias(RECORD_HEADERS),
        F.col("offset").cast("long").alias(RECORD_ORDER),
    )
    return parse_payload(rows, choice(config, "format", ("JSON", "TEXT"), "JSON"), config.get("schema"))


def cursor_literal(value: object, kind: str, url: str = "") -> str:
    """A cursor as a SQL literal of the database at ``url``."""
    if kind == "LONG":
        return str(int(value))
    if kind == "DOUBLE":
        return repr(float(value))
    quoted = "'" + str(value).replace("'", "''") + "'"
    return f"TIMESTAMP {quoted}" if kind == "TIMESTAMP" and not url.startswith("jdbc:derby") else quoted


def jdbc_query(config: dict[str, Any], cursor: object = None, until: object = None) -> str:
    """The checked query or table, restricted to rows after a cursor, and up to another."""
    if config.get("query"):
        base = str(config["query"]).strip().rstrip(";").strip()
        if not base.lower().startswith("select ") or ";" in base:
            raise ConfigError("query must be a single SELECT statement")
        base = f"({base})"
    else:
        base = text(config, "tablePath")
        if not TABLE_PATH.fullmatch(base):
            raise ConfigError("tablePath must be a table name, with schema and catalogue at most")
    if not config.get("cursorField"):
        return f"select * from {base} loom_source"
    field = text(config, "cursorField")
    if not re.fullmatch(r'"?[A-Za-z_][\w$]*"?', field):
        raise ConfigError("cursorField must be a column name")
    literal = lambda value: cursor_literal(value, choice(config, "cursorType", ("STRING", "LONG", "DOUBLE", "TIMESTAMP"), "STRING"), str(config.get("url") or ""))
    where = f"{field} > {literal(cursor)}" if cursor is not None else f"{field} is not null"
    return f"select * from {base} loom_source where {where}" + (f" and {field} <= {literal(until)}" if until is not None else "")


def read_mode(config: dict[str, Any]) -> tuple[str, dict[str, Any]]:
    """FULL or INCREMENTAL, and the configuration without the cursor that FULL ignores."""
    mode = choice(config, "readMode", ("FULL", "INCREMENTAL"), "FULL")
    if mode == "INCREMENTAL":
        text(config, "cursorField")
        return mode, config
    return mode, {k: v for k, v in config.items() if k not in ("cursorField", "initialCursorValue")}


def jdbc_rows(spark: SparkSession, config: dict[str, Any], statement: str, **options: str) -> DataFrame:
    """Rows of a statement; ``partitionColumn`` with its bounds reads them in parallel."""
    reader = spark.read.format("jdbc").options(**options).option("url", text(config, "url")).option("fetchsize", number(config, "fetchSize", 1000, 1))
    for key, option in (("driver", "driver"), ("username", "user"), ("password", "password")):
        if config.get(key):
            reader = reader.option(option, str(config[key]))
    if not config.get("partitionColumn"):
        return reader.option("query", statement).load()
    for key in ("partitionColumn", "lowerBound", "upperBound", "numPartitions"):
        reader = reader.option(key, text(config, key))
    return reader.option("dbtable", f"({statement}) loom_parts").load()


def described(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Rows of a database as records, their times as ISO texts."""
    if flag(config, "isoTimes", True):
        for f in df.schema.fields:
            if isinstance(f.dataType, T.TimestampType):
                df = df.withColumn(f.name, F.date_format(column(f.name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
            elif isinstance(f.dataType, T.DateType):
                df = df.withColumn(f.name, column(f.name).cast("string"))
    return identified(df, config)


def jdbc(spark: SparkSession, config: dict[str, Any], streaming: bool) -> DataFrame:
    """What a table or query holds now; ``Engine.start`` polls it instead."""
    _, config = read_mode(config)
    return described(jdbc_rows(spark, config, jdbc_query(config, config.get("initialCursorValue"))), config)


def _served(spark: SparkSession, source: type, config: dict[str, Any], streaming: bool) -> DataFrame:
    spark.dataSource.register(source)
    cursor = config.get("initialCursorValue")
    if cursor is not None and str(config.get("cursorType") or "STRING").upper() in ("LONG", "DOUBLE"):
        cursor = float(cursor) if config["cursorType"].upper() == "DOUBLE" else int(cursor)
    passed = {**config, "initialCursor": json.dumps(cursor)}
    if str(config.get("readMode") or "FULL").upper() == "FULL":
        passed.pop("cursorField", None)
    reader = (spark.readStream if streaming else spark.read).format(source.name()).option("config", json.dumps(passed))
    df = reader.load().withColumnRenamed("value", "_payload")
    return parse_payload(df, "JSON", config.get("schema"))


def search_index(spark: SparkSession, config: dict[str, Any], streaming: bool) -> DataFrame:
    if not re.fullmatch(r"[A-Za-z0-9*_.,+-]+", text(config, "index")):
        raise ConfigError("index must be made of letters, digits and * _ . , + -")
    query = config.get("query") or {}
    passed = {**config, "hosts": json.dumps(names(config, "hosts", required=True)), "source": json.dumps(names(config, "source")), "query": query if isinstance(query, str) else json.dumps(query)}
    df = _served(spark, SearchIndexSource, passed, streaming)
    return identified(df, config, F.col("`_id`") if "_id" in df.columns else None)


def time_series(spark: SparkSession, config: dict[str, Any], streaming: bool) -> DataFrame:
    sql = checked_query(text(config, "sql"))
    df = _served(spark, TimeSeriesSource, {**config, "sql": sql, "url": text(config, "url"), "database": text(config, "database")}, streaming)
    df = identified(df, config)
    if not config.get("timestampField") and "time" in df.columns:
        unit = UNIT_MS[epoch_unit(config.get("epoch"))]
        df = df.withColumn(RECORD_TIME, F.coalesce((F.col("time").try_cast("double") * unit).cast("bigint"), F.col(RECORD_TIME)))
    return df


_ESCAPES = {r"\001": "\x01", r"\n": "\n", r"\r": "\r", r"\t": "\t"}


def delimiter(config: dict[str, Any], key: str, default: str) -> str:
    value = str(config.get(key) if config.get(key) is not None else default)
    for written, meant in _ESCAPES.items():
        value = value.replace(written, meant)
    return value


def file_format(config: dict[str, Any]) -> str:
    form = choice(config, "file_format_type", ("JSON", "CSV", "TEXT", "PARQUET", "ORC", "XML", "BINARY", "EXCEL"))
    if form == "EXCEL":
        raise ConfigError("EXCEL files are not supported")
    return form


def file_path(config: dict[str, Any]) -> str:
    path, root = text(config, "path"), str(config.get("fs.defaultFS") or "").rstrip("/")
    if "://" in path or path.startswith("file:"):
        return path
    return f"{root}/{path.lstrip('/')}" if root else path


def _declared(config: dict[str, Any]) -> str | T.StructType | None:
    """A DDL string, or the JSON object ``{"fields": {name: type}}``."""
    schema = config.get("schema")
    if isinstance(schema, str) and schema.strip().startswith("{"):
        schema = json.loads(schema)
    if isinstance(schema, dict):
        fields = schema.get("fields", schema)
        sql = {"int": "bigint", "integer": "bigint", "long": "bigint"}
        return ", ".join(f"`{n}` {sql.get(str(t).lower(), str(t))}" for n, t in fields.items())
    return schema or None


def files(spark: SparkSession, config: dict[str, Any], streaming: bool) -> DataFrame:
    """Files below a path.  JSON and text are read by line, so that bad lines are skipped one by one."""
    form, path = file_format(config), file_path(config)
    schema = _declared(config)
    reader = (spark.readStream if streaming else spark.read).option("recursiveFileLookup", "true")
    if config.get("encoding"):
        reader = reader.option("encoding", str(config["encoding"]))
    if streaming and form in ("CSV", "PARQUET", "ORC", "XML"):
        if schema is None:
            raise ConfigError("a stream of files needs a schema")
        reader = reader.schema(schema)
    if form in ("JSON", "TEXT"):
        df = reader.format("text").load(path)
    elif form == "CSV":
        reader = reader.option("sep", delimiter(config, "field_delimiter", "\x01")).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
        columns = T.StructType.fromDDL(schema).names if isinstance(schema, str) else None
        header = flag(config, "csv_use_header_line")
        if columns and not header:
            reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
        df = reader.option("header", str(header).lower()).csv(path)
        if not columns and not header:
            df = df.toDF(*[f"column_{i + 1}" for i in range(len(df.columns))])
    elif form == "BINARY":
        df = reader.format("binaryFile").load(path)
    else:
        if form == "XML":
            reader = reader.option("rowTag", str(config.get("row_tag") or "row"))
        df = reader.format(form.lower()).load(path)
    df = df.withColumn("_file", F.col("_metadata.file_path"))
    if config.get("file_filter_pattern"):
        pattern = rf"\A(?:{config['file_filter_pattern']})\z"
        df = df.where(F.col("_file").rlike(pattern) | F.regexp_extract("_file", r"[^/]*$", 0).rlike(pattern))
    skipped = number(config, "skip_header_row_number", 0, 0)
    if skipped and form in ("JSON", "TEXT", "CSV"):
        if streaming:
            raise ConfigError("skip_header_row_number needs a batch read")
        # Lines of a file are numbered by where they stand; only files of one split have headers to skip.
        df = df.withColumn("_line", F.monotonically_increasing_id())
        firsts = df.groupBy("_file").agg(F.min("_line").alias("_first"))
        df = df.join(firsts, "_file").where(F.col("_line") - F.col("_first") >= skipped).drop("_line", "_first")
    segments: list[str] = []
    if flag(config, "parse_partition_from_path"):
        segments = names(config, "partition_columns") or (_partition_names(spark, path) if streaming else _partitions_of([path, *df.inputFiles()]))
    if form in ("JSON", "TEXT"):
        df = parse_payload(df.where(F.trim("value") != "").withColumnRenamed("value", "_payload"), form, schema if form == "JSON" else None)
    for name in segments:
        if name not in df.columns:
            df = df.withColumn(name, F.nullif(F.regexp_extract("_file", rf"/{re.escape(name)}=([^/]*)/", 1), F.lit("")))
    wanted = names(config, "read_columns")
    if wanted:
        df = df.select(*[column(c) for c in df.columns if c in wanted or c in segments or c == "_file"])
    return identified(df, config, F.concat(F.col("_file"), F.lit(":"), F.expr("uuid()"))).drop("_file")


def _partitions_of(paths: list[str]) -> list[str]:
    """Names of ``k=v`` folders on the way to any of the files."""
    return list(dict.fromkeys(n for p in paths for n in re.findall(r"/([^/=]+)=[^/]*(?=/|$)", p)))


def _partition_names(spark: SparkSession, path: str) -> list[str]:
    """Names of ``k=v`` folders below a stream's path, whose files Spark has not listed yet."""
    home = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = home.getFileSystem(spark._jsc.hadoopConfiguration())
    listed, paths = system.listFiles(home, True), [path]
    while listed.hasNext():
        paths.append(listed.next().getPath().getParent().toString())
    return _partitions_of(paths)


SOURCES = {"KAFKA_SOURCE": kafka, "JDBC_SOURCE": jdbc, "ELASTICSEARCH_SOURCE": search_index, "INFLUXDB_SOURCE": time_series, "HDFS_FILE_SOURCE": files}
