"""Batch readers: JSON log records, syslog text, and the dispatch between them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netsilt.functions.columns import surrogate_id
from netsilt.functions.text import parse_timestamp
from netsilt.schema import JSON_RECORD, RAW_LOG
from netsilt.session import SPREAD_SETTING
from netsilt.sources.places import PLACE, with_line_places, with_row_places
from netsilt.sources.syslog import parse_syslog


def spread_input(df: DataFrame) -> DataFrame:
    """Deal the rows into as many parts as the session asks for (``SPREAD_SETTING``).

    The log projections are CPU-bound (patterns over every message), so a small
    file in one row group would keep one core busy. Large tables need none of this
    and the setting is unset for them: file splits decide.
    """
    parts = df.sparkSession.conf.get(SPREAD_SETTING, None)
    return df.repartition(int(parts)) if parts else df


def _kept_place(df: DataFrame) -> list[str]:
    return [PLACE] if PLACE in df.columns else []


def metrics_map(metrics: str | Column) -> Column:
    """Text-valued metrics as numbers; what is not a number is left out."""
    metrics = F.col(metrics) if isinstance(metrics, str) else metrics
    numbers = F.transform_values(metrics, lambda _, v: v.try_cast("double"))
    return F.coalesce(F.map_filter(numbers, lambda _, v: v.isNotNull()), F.create_map().cast("map<string,double>"))


def _now(collected_at: datetime | Column | None) -> Column:
    if collected_at is None:
        return F.current_timestamp()
    return collected_at if isinstance(collected_at, Column) else F.lit(collected_at)


def time_or_arrival(text: str, collected_at: datetime | Column | None = None) -> Column:
    """The parsed time stamp, arrival time where the field is absent, null where it cannot be read."""
    return F.when(F.col(text).isNull(), _now(collected_at)).otherwise(parse_timestamp(text))


def with_defaults(records: DataFrame, collected_at: datetime | Column | None = None) -> DataFrame:
    """Complete any frame of log fields to the raw log schema.

    Absent columns and nulls take the record defaults, but a time stamp that could
    not be read stays null. A missing id becomes a digest of the record and its place
    in the input, so equal records are different logs; read again from the same files,
    a record keeps its id, see ``places`` (the time, which may be that of arrival, has no part in it).
    """
    now = _now(collected_at)
    of_file = PLACE in records.columns
    records = records if of_file else with_row_places(records)
    have = set(records.columns)
    field = lambda name, default: (F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default))
    identity = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
                ("timestamp", "source", "severity", "description", "raw_message") if c in have and not (of_file and c == "timestamp")]
    cols = {
        "log_id": surrogate_id("LOG", *identity, PLACE),
        "timestamp": F.col("timestamp") if "timestamp" in have else now,
        "severity": field("severity", "INFO"),
        "metrics": F.coalesce("metrics", F.create_map().cast("map<string,double>")) if "metrics" in have
        else F.create_map().cast("map<string,double>"),
        "tags": F.coalesce("tags", F.array().cast("array<string>")) if "tags" in have
        else F.array().cast("array<string>"),
        "collected_at": F.coalesce(F.col("collected_at"), now) if "collected_at" in have else now,
    }
    if "log_id" in have:
        cols["log_id"] = F.coalesce(F.col("log_id"), cols["log_id"])
    out = []
    for f in RAW_LOG.fields:
        value = cols.get(f.name)
        out.append((field(f.name, "") if value is None else value).cast(f.dataType).alias(f.name))
    return records.select(*out)


def with_ids(logs: DataFrame) -> DataFrame:
    """Fill empty ids with a digest of the record and its row: scores are joined to logs by id."""
    columns = logs.columns
    if PLACE not in columns:
        logs = with_row_places(logs)
    identity = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
                ("timestamp", "source", "severity", "description", "raw_message")]
    return logs.withColumn(
        "log_id", F.coalesce(F.nullif(F.col("log_id"), F.lit("")), surrogate_id("LOG", *identity, PLACE))).select(*columns)


def json_logs(records: DataFrame, collected_at: datetime | Column | None = None) -> DataFrame:
    """JSON log records (``record_text`` plus the fields of ``JSON_RECORD``) to raw logs.

    A null field counts as absent. Severity is upper-cased; a record without a raw
    message keeps its own JSON text as one.
    """
    return with_defaults(records.select(
        "log_id",
        time_or_arrival("timestamp", collected_at).alias("timestamp"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce("source_ip", F.lit("")).alias("source_ip"),
        F.coalesce("platform", F.lit("file")).alias("platform"),
        F.coalesce("component", F.lit("UNKNOWN")).alias("component"),
        F.coalesce("version", F.lit("")).alias("version"),
        F.upper(F.coalesce("severity", F.lit("INFO"))).alias("severity"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("raw_message", "record_text").alias("raw_message"),
        metrics_map("metrics").alias("metrics"), *_kept_place(records),
    ), collected_at)


def api_logs(records: DataFrame, collected_at: datetime | Column | None = None) -> DataFrame:
    """Records posted to the ingest call: platform ``api``, severity kept as given,
    id and component empty when absent."""
    empty = F.lit("")
    return with_defaults(records.select(
        F.coalesce("log_id", empty).alias("log_id"),
        time_or_arrival("timestamp", collected_at).alias("timestamp"),
        F.coalesce("source", empty).alias("source"),
        F.coalesce("source_ip", empty).alias("source_ip"),
        F.coalesce("platform", F.lit("api")).alias("platform"),
        F.coalesce("component", empty).alias("component"),
        F.coalesce("version", empty).alias("version"),
        F.coalesce("severity", F.lit("INFO")).alias("severity"),
        F.coalesce("description", empty).alias("description"),
        F.coalesce("raw_message", empty).alias("raw_message"),
        metrics_map("metrics").alias("metrics"),
    ), collected_at)


def with_record(texts: DataFrame, text_column: str) -> DataFrame:
    """Parse one JSON record per row; keeps the text as ``record_text``."""
    return texts.select(
        F.col(text_column).alias("record_text"), F.from_json(text_column, JSON_RECORD).alias("r"),
        *_kept_place(texts),
    ).select("record_text", "r.*", *_kept_place(texts))


def read_json_logs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """JSON lines, or with ``multi_line`` files that hold one JSON array each.

    JSON lines split by bytes and are the form for large data; a file with one
    array is read by one task.
    """
    if multi_line:
        # each record as its own text, fields we do not know included
        items = spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("_file"), F.posexplode(F.from_json("value", "array<string>")).alias("_item", "value"),
        ).select("value", F.concat_ws(":", "_file", "_item").alias(PLACE))
        return json_logs(with_record(items, "value"))
    return json_lines(with_line_places(spark.read.text(path)))


def json_lines(texts: DataFrame, collected_at: datetime | Column | None = None) -> DataFrame:
    """Raw logs of lines (column ``value``) with one JSON record each; blank lines are dropped."""
    return json_logs(with_record(texts.filter(F.trim("value") != ""), "value"), collected_at)


def read_syslog_logs(spark: SparkSession, path: str) -> DataFrame:
    """Text file with one syslog message per line; blank lines are dropped."""
    return syslog_lines(with_line_places(spark.read.text(path)))


def syslog_lines(texts: DataFrame) -> DataFrame:
    """Raw logs of text lines (column ``value``), white space around them removed."""
    lines = texts.select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("message"), *_kept_place(texts))
    return parse_syslog(lines.filter(F.col("message") != ""), "message", F.lit("file"))


def read_logs(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read by format, or by file name: ``.json`` (array), ``.jsonl``, otherwise syslog."""
    fmt = fmt or ("json" if path.endswith(".json") else "jsonl" if path.endswith(".jsonl") else "syslog")
    if fmt == "json":
        return read_json_logs(spark, path, multi_line=True)
    if fmt == "jsonl":
        return read_json_logs(spark, path)
    return read_syslog_logs(spark, path)


def merge_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All sources as one raw log table."""
    for df in others:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
