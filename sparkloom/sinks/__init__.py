"""Sinks: each writes a DataFrame, and can write a micro-batch of a stream."""

from __future__ import annotations

import json
import re
import time
import urllib.parse
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.model import MESSAGE, RECORD_ID, RECORD_ORDER, RECORD_TIME, RESERVED, ConfigError, choice, flag, names, number, text
from sparkloom.paths import Field, as_text, column, lookup
from sparkloom.sources import TABLE_PATH, delimiter, file_format, file_path, kafka_options
from sparkloom.sources.http import auth_headers, base_url, request
from sparkloom.sources.time_series import UNIT_MS, epoch_unit

_PLACEHOLDER = re.compile(r"\$\{([^}]+)\}")


def fields_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in RESERVED]


def payload(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Records as ``value`` texts: JSON of all fields, or one field; TEXT records without it are skipped."""
    form = choice(config, "format", ("JSON", "TEXT"), "JSON")
    key = F.col(RECORD_ID).cast("string") if RECORD_ID in df.columns else F.expr("uuid()")
    if form == "JSON":
        return df.select(key.alias("key"), F.to_json(F.struct(*[column(c) for c in fields_of(df)])).alias("value") if fields_of(df) else F.lit("{}").alias("value"))
    found = lookup(df.schema, str(config.get("messageField") or MESSAGE))
    value = as_text(found) if found else F.lit(None).cast("string")
    return df.select(key.alias("key"), value.alias("value")).where(F.col("value").isNotNull())


def kafka_write_options(config: dict[str, Any]) -> dict[str, str]:
    guarantee = choice(config, "deliveryGuarantee", ("NONE", "AT_LEAST_ONCE", "EXACTLY_ONCE"), "AT_LEAST_ONCE")
    out = kafka_options(config) | {"topic": text(config, "topic"), "kafka.acks": "0" if guarantee == "NONE" else "all"}
    if guarantee == "EXACTLY_ONCE":
        out |= {"kafka.enable.idempotence": "true", "kafka.max.in.flight.requests.per.connection": "1"}
    return out


def kafka(df: DataFrame, config: dict[str, Any]) -> None:
    payload(df, config).write.format("kafka").options(**kafka_write_options(config)).save()


def selected(df: DataFrame, paths: list[str], *beside: str) -> DataFrame:
    """Fields at dotted paths as columns of those names; structs, arrays and maps as JSON.  Columns ``beside`` stay as they are."""
    out = []
    for p in paths:
        found = lookup(df.schema, p)
        nested = found is not None and isinstance(found.type, (T.StructType, T.ArrayType, T.MapType))
        out.append((as_text(found) if nested else found.column if found else F.lit(None).cast("string")).alias(p.rsplit(".", 1)[-1]))
    return df.select(*out, *beside)


def jdbc(df: DataFrame, config: dict[str, Any]) -> None:
    """INSERT appends; UPSERT updates by key and inserts what was not there.

    Upserted rows are first reduced to one of each key, so that no key is
    written twice: the last by ``orderBy``, else by time and order of the records,
    else as Spark numbers its rows.  They go to a staging table, and two statements
    of one transaction bring them over inside the database.
    """
    mode = choice(config, "writeMode", ("INSERT", "UPSERT"), "INSERT")
    table, paths = text(config, "tablePath"), names(config, "fields", required=True)
    if not TABLE_PATH.fullmatch(table):
        raise ConfigError("tablePath must be a table name, with schema and catalogue at most")
    rows, size = selected(df, paths), number(config, "batchSize", 500, 1)
    if mode == "INSERT":
        writer = rows.write.format("jdbc").mode("append").option("url", text(config, "url")).option("dbtable", table).option("batchsize", size)
        for key, option in (("driver", "driver"), ("username", "user"), ("password", "password")):
            if config.get(key):
                writer = writer.option(option, str(config[key]))
        writer.save()
        return
    keys = names(config, "keyFields", required=True)
    if not set(keys) <= set(paths) or len(keys) == len(paths):
        raise ConfigError("keyFields must be among fields, and not all of them")
    _upsert(df, rows, config, table, [k.rsplit(".", 1)[-1] for k in keys], size)


def _upsert(df: DataFrame, rows: DataFrame, config: dict[str, Any], table: str, keys: list[str], size: int) -> None:
    """Through a staging table, in statements that databases share; names are quoted as the database does."""
    from sparkloom.operators.base import order_key

    spark = df.sparkSession
    known = config.get("orderBy") or any(c in df.columns for c in (RECORD_TIME, RECORD_ORDER))
    numbered = df.withColumn("_loom_at", F.struct(*([order_key(df, config).alias("order")] if known else []), F.monotonically_increasing_id().alias("row")))
    ordered = selected(numbered, names(config, "fields"), "_loom_at")
    last = ordered.groupBy(*[column(k) for k in keys]).agg(F.max_by(F.struct(*[column(c) for c in rows.columns]), "_loom_at").alias("_row")).select("_row.*")
    staging = re.sub(r"""(["`]?)\Z""", rf"_loom_{uuid.uuid4().hex[:12]}\1", table, count=1)
    target = {k: str(config[k]) for k in ("username", "password", "driver") if config.get(k)}
    options = {"url": text(config, "url"), "batchsize": str(size)} | {o: target[k] for k, o in (("driver", "driver"), ("username", "user"), ("password", "password")) if k in target}
    types = {f.name.lower(): f for f in spark.read.format("jdbc").options(**options).option("dbtable", table).load().schema.fields}
    last = last.select(*[column(c).cast(types[c.lower()].dataType).alias(types[c.lower()].name) for c in last.columns])
    writer_columns = last.columns
    manager = spark._jvm.java.sql.DriverManager
    if "driver" in target:
        spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(target["driver"])
    connect = lambda: manager.getConnection(text(config, "url"), target.get("username", ""), target.get("password", "")) if target.get("username") else manager.getConnection(text(config, "url"))
    quote = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(text(config, "url")).quoteIdentifier
    cased = {k.lower(): f.name for k, f in types.items()}
    match = " and ".join(f"{table}.{quote(cased[k.lower()])} = s.{quote(cased[k.lower()])}" for k in keys)
    others = [c for c in writer_columns if c.lower() not in {k.lower() for k in keys}]
    connection, made = connect(), False
    try:
        statement = connection.createStatement()
        listed = ", ".join(quote(c) for c in writer_columns)
        statement.execute(_empty_copy(text(config, "url"), table, staging, listed))
        made = True
        last.write.format("jdbc").mode("append").options(**options).option("dbtable", staging).save()
        connection.setAutoCommit(False)
        updates = ", ".join(f"{quote(c)} = (select s.{quote(c)} from {staging} s where {match})" for c in others)
        statement.execute(f"update {table} set {updates} where exists (select 1 from {staging} s where {match})")
        statement.execute(f"insert into {table} ({listed}) select {', '.join('s.' + quote(c) for c in writer_columns)} from {staging} s where not exists (select 1 from {table} where {match})")
        connection.commit()
    except Exception:
        if not connection.getAutoCommit():
            connection.rollback()
        raise
    finally:
        try:
            connection.setAutoCommit(True)
            if made:
                statement.execute(f"drop table {staging}")
        finally:
            connection.close()


def _empty_copy(url: str, table: str, staging: str, columns: str) -> str:
    """The statement that makes an empty table with the target's types."""
    if url.startswith("jdbc:sqlserver:"):
        return f"select {columns} into {staging} from {table} where 1 = 0"
    return f"create table {staging} as select {columns} from {table} " + ("with no data" if url.startswith("jdbc:derby:") else "where 1 = 0")


def filled(template: str, df: DataFrame) -> Column:
    """A template with ``${field}``; null where a field is."""
    parts = []
    for i, piece in enumerate(_PLACEHOLDER.split(template)):
        found = lookup(df.schema, piece.strip()) if i % 2 else None
        parts.append(F.lit(piece) if i % 2 == 0 else as_text(found) if found else F.lit(None).cast("string"))
    return F.concat(*parts)


def _required(value: Column, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(what)).cast("string"))


def _sent(batches: Iterator[list[str]], send: Callable[[list[str]], None], retries: int, waits: Callable[[int], float]) -> None:
    for batch in batches:
        for attempt in range(retries + 1):
            try:
                send(batch)
                break
            except OSError as e:
                if attempt == retries or "status 4" in str(e):
                    raise
                time.sleep(waits(attempt + 1))


def _batches(rows: Iterator[Row], size: int) -> Iterator[list[str]]:
    batch: list[str] = []
    for row in rows:
        batch.append(row[0])
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def bulk_lines(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """One row a document: the action line and the document, for a bulk request."""
    index = F.lower(_required(filled(text(config, "index"), df), "a field of index is null"))
    wanted = names(config, "fields") or fields_of(df)
    kept = [(p, f) for p in wanted if (f := lookup(df.schema, p))]
    action = [index.alias("_index")]
    if config.get("indexType"):
        action.append(F.lit(str(config["indexType"])).alias("_type"))
    keys = names(config, "primaryKeys")
    if keys:
        parts = [as_text(f) if (f := lookup(df.schema, k)) else F.lit(None).cast("string") for k in keys]
        between = F.lit(str(config.get("keyDelimiter") or "_"))
        joined = parts[0]
        for p in parts[1:]:
            joined = F.concat(joined, between, p)
        action.append(_required(joined, "a primary key is null").alias("_id"))
    head = F.to_json(F.struct(F.struct(*action).alias("index")))
    body = F.to_json(F.struct(*[f.column.alias(p) for p, f in kept]), {"ignoreNullFields": "false"})
    return df.select(F.concat(head, F.lit("\n"), body).alias("line"))


def search_index(df: DataFrame, config: dict[str, Any]) -> None:
    host, headers = base_url(names(config, "hosts", required=True)[0]), auth_headers(config)
    size, retries = number(config, "maxBatchSize", 10, 1), number(config, "maxRetryCount", 3, 0)

    def send(batch: list[str]) -> None:
        body = ("\n".join(batch) + "\n").encode()
        answer = json.loads(request("POST", f"{host}/_bulk", body, {"Content-Type": "application/x-ndjson", **headers}))
        if answer.get("errors"):
            failed = [i for i in answer.get("items", []) if next(iter(i.values())).get("error")]
            raise RuntimeError(f"bulk items failed: {json.dumps(failed[:3])}")

    def write(rows: Iterator[Row]) -> None:
        _sent(_batches(rows, size), send, retries, lambda n: min(float(n), 5.0))

    bulk_lines(df, config).foreachPartition(write)


def _escaped(value: Column, marks: str) -> Column:
    for mark in marks:
        value = F.replace(value, F.lit(mark), F.lit("\\" + mark))
    return value


def line_protocol(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Records as lines ``measurement,tags fields time``."""
    unit = epoch_unit(config.get("precision"))
    tags, time_key = names(config, "keyTags"), str(config.get("keyTime") or "time")
    wanted = names(config, "fields") or [c for c in fields_of(df) if c not in tags and c != time_key]
    measurement = _escaped(_required(filled(text(config, "measurement"), df), "a field of measurement is null"), ", ")
    tag_parts = []
    for t in sorted(tags):
        if t in df.columns:
            value = as_text(Field(column(t), df.schema[t].dataType))
            tag_parts.append(F.when(value.isNotNull() & (value != ""), F.concat(F.lit("," + re.sub(r"([,= ])", r"\\\1", t) + "="), _escaped(value, ",= "))))
    parts = []
    for f in wanted:
        if f not in df.columns:
            continue
        kind, c = df.schema[f].dataType, column(f)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            value = F.concat(c.cast("string"), F.lit("i"))
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)):
            value = c.cast("string")
        else:
            raw = as_text(Field(c, kind))
            value = F.concat(F.lit('"'), F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(re.sub(r"([,= ])", r"\\\1", f) + "="), value)))
    fields = F.nullif(F.concat_ws(",", *parts), F.lit("")) if parts else F.lit(None).cast("string")
    at = lookup(df.schema, time_key)
    own = F.col(RECORD_TIME) if RECORD_TIME in df.columns else F.unix_millis(F.current_timestamp())
    if at is not None and isinstance(at.type, (T.TimestampType, T.TimestampNTZType)):
        millis = F.unix_millis(at.column.cast("timestamp"))
    else:
        millis = F.coalesce(as_text(at).try_cast("bigint"), F.unix_millis(F.try_to_timestamp(as_text(at)))) if at else F.lit(None).cast("bigint")
    stamp = F.floor(F.coalesce(millis, own) / F.lit(UNIT_MS[unit])).cast("bigint")
    head = F.concat(measurement, *[F.coalesce(t, F.lit("")) for t in tag_parts])
    return df.select(F.concat(head, F.lit(" "), _required(fields, "no field to write"), F.lit(" "), stamp.cast("string")).alias("line"))


def time_series(df: DataFrame, config: dict[str, Any]) -> None:
    parameters = {"db": text(config, "database"), "precision": epoch_unit(config.get("precision"))}
    if config.get("username"):
        parameters |= {"u": str(config["username"]), "p": str(config.get("password") or "")}
    url = f"{base_url(text(config, 'url'))}/write?{urllib.parse.urlencode(parameters)}"
    size, retries = number(config, "batchSize", 100, 1), number(config, "maxRetries", 3, 0)
    first, most = number(config, "retryBackoffMillis", 100, 0) / 1000, number(config, "maxRetryBackoffMillis", 1000, 0) / 1000

    def write(rows: Iterator[Row]) -> None:
        _sent(_batches(rows, size), lambda b: request("POST", url, "\n".join(b).encode()) and None, retries, lambda n: min(first * 2 ** (n - 1), most))

    line_protocol(df, config).foreachPartition(write)


def _folder(df: DataFrame, config: dict[str, Any], by: list[str]) -> Column:
    """The partition folder of a record: ``partition_dir_expression`` filled in, or ``field=value`` for each field."""
    safe = lambda name: F.regexp_replace(F.coalesce(as_text(lookup(df.schema, name) or Field(F.lit(None), T.StringType())), F.lit("__HIVE_DEFAULT_PARTITION__")), "/", "_")
    expression = str(config.get("partition_dir_expression") or "/".join(f"{b}=${{{b}}}" for b in by))
    return F.concat(*[safe(piece.strip()) if i % 2 else F.lit(piece) for i, piece in enumerate(_PLACEHOLDER.split(expression))])


def _file_prefix(config: dict[str, Any], now: datetime) -> str:
    """What a file's name begins with: ``file_name_expression`` with ``${now}`` in ``filename_time_format``."""
    if not flag(config, "custom_filename"):
        return ""
    pattern = str(config.get("filename_time_format") or "yyyy.MM.dd")
    for letters, code in (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S")):
        pattern = pattern.replace(letters, code)
    return str(config.get("file_name_expression") or "part-${now}").replace("${now}", now.strftime(pattern)).replace("/", "_") + "-"


def files(df: DataFrame, config: dict[str, Any]) -> None:
    """Files below a path, in partition folders.

    Spark's own folders lack the partition fields in the files, and Spark names
    the files.  Where a configuration wants it otherwise, files are written beside
    the target and then moved, each by one rename, so that no reader sees a part
    of one.
    """
    by = names(config, "partition_by")
    keeps = flag(config, "is_partition_field_write_in_file", True) and bool(by)
    if not keeps and not flag(config, "custom_filename") and not config.get("partition_dir_expression"):
        return _write_files(df, config, file_path(config), by)
    spark, path = df.sparkSession, file_path(config).rstrip("/")
    beside = f"{path}/.loom-{uuid.uuid4().hex}"
    if keeps or config.get("partition_dir_expression"):
        wanted = names(config, "sink_columns") or [c for c in sorted(fields_of(df)) if keeps or c not in by]
        rows, inner = df.withColumn("_loom_folder", _folder(df, config, by)), {**config, "sink_columns": wanted, "write_mode": "append"}
        folders = ["_loom_folder"]
    else:
        rows, inner, folders = df, {**config, "write_mode": "append"}, by
    _write_files(rows, inner, beside, folders)
    home = spark._jvm.org.apache.hadoop.fs.Path
    system = home(path).getFileSystem(spark._jsc.hadoopConfiguration())
    prefix, listed = _file_prefix(config, datetime.now()), system.listFiles(home(beside), True)
    if str(config.get("write_mode") or "append") == "overwrite":
        for status in system.listStatus(home(path)):
            if not status.getPath().getName().startswith(".loom-"):
                system.delete(status.getPath(), True)
    try:
        while listed.hasNext():  # one rename a file, as Spark's own commit does
            found = listed.next().getPath()
            if found.getName().startswith(("_", ".")):
                continue
            between = found.getParent().toString().split(beside.rsplit("/", 1)[1], 1)[1].strip("/")
            if folders == ["_loom_folder"]:
                between = urllib.parse.unquote(between.split("=", 1)[1])
            target = home(f"{path}/{between}".rstrip("/"))
            system.mkdirs(target)
            if not system.rename(found, home(target, f"{prefix}{found.getName()}")):
                raise OSError(f"cannot move {found.toString()}")
    finally:
        system.delete(home(beside), True)


def _write_files(df: DataFrame, config: dict[str, Any], path: str, folders: list[str]) -> None:
    """Files in Spark's folders, without the fields that name these."""
    form = file_format(config)
    wanted = names(config, "sink_columns") or sorted(fields_of(df))
    rows = df.select(*[column(c) for c in wanted if c in df.columns and c not in folders], *[column(f) for f in folders])
    mode = str(config.get("write_mode") or "append")
    options = {k: str(config[o]) for k, o in (("encoding", "encoding"), ("compression", "compress_codec")) if config.get(o) and str(config[o]).lower() != "none"}
    writer = lambda part: part.write.mode(mode).partitionBy(*folders).options(**options)
    if form == "JSON":
        writer(rows).option("ignoreNullFields", "false").json(path)
    elif form == "CSV":
        header = str(flag(config, "csv_use_header_line")).lower()
        writer(_as_strings(rows, folders)).option("sep", delimiter(config, "field_delimiter", "\x01")).option("header", header).option("escape", '"').option("lineSep", delimiter(config, "row_delimiter", "\n")).csv(path)
    elif form == "TEXT":
        flat = _as_strings(rows, folders)
        line = F.concat_ws(delimiter(config, "field_delimiter", "\x01"), *[F.coalesce(column(c), F.lit("")) for c in flat.columns if c not in folders])
        writer(flat.select(line.alias("value"), *[column(c) for c in folders])).option("lineSep", delimiter(config, "row_delimiter", "\n")).text(path)
    else:
        writer(rows).format(form.lower()).save(path)


def _as_strings(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*[column(f.name) if f.name in keep else as_text(Field(column(f.name), f.dataType)).alias(f.name) for f in df.schema.fields])


SINKS: dict[str, Callable[[DataFrame, dict[str, Any]], None]] = {"KAFKA_SINK": kafka, "JDBC_SINK": jdbc, "ELASTICSEARCH_SINK": search_index, "INFLUXDB_SINK": time_series, "HDFS_FILE_SINK": files}
