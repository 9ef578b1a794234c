"""Landed monitoring-system payloads to raw logs.

A payload table holds one response per row as JSON text (``payload``). Responses
are bounded by their batch size; rows, not payloads, carry the volume.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsilt import rules
from netsilt.functions.columns import lookup
from netsilt.schema import JSON_RECORD, RAW_LOG
from netsilt.sources.readers import metrics_map, time_or_arrival, with_defaults

_SOLARWINDS = "EventTime string, NetObjectID string, NetObjectType string, Message string"
_ZABBIX = "clock string, hosts array<struct<host:string>>, severity string, name string"


def _items(payload: Column) -> Column:
    """The items of a response as JSON texts: the payload itself when it is a list,
    else its ``results``, else its ``logs``."""
    texts = "array<string>"
    whole = F.when(F.ltrim(payload).startswith("["), F.from_json(payload, texts))
    part = lambda key: F.from_json(F.get_json_object(payload, f"$.{key}"), texts)
    return F.coalesce(whole, part("results"), part("logs"), part("result"))


def normalise_rest(payloads: DataFrame, default_source: str | Column = "", batch_size: int | None = None) -> DataFrame:
    """Generic REST responses: all items, or with ``batch_size`` the first so many of each."""
    base = default_source if isinstance(default_source, Column) else F.lit(default_source)
    texts = _items(F.col("payload"))
    items = payloads.select(
        base.alias("base"), F.explode(F.slice(texts, 1, batch_size) if batch_size else texts).alias("record_text"))
    rows = items.withColumn("r", F.from_json("record_text", JSON_RECORD))
    return with_defaults(rows.select(
        F.coalesce("r.source", "base").alias("source"),
        F.lit("api").alias("platform"),
        F.coalesce("r.component", F.lit("UNKNOWN")).alias("component"),
        F.coalesce("r.version", F.lit("")).alias("version"),
        F.upper(F.coalesce("r.severity", F.lit("INFO"))).alias("severity"),
        F.coalesce("r.description", "r.message", F.lit("")).alias("description"),
        F.col("record_text").alias("raw_message"),
        metrics_map("r.metrics").alias("metrics"),
    ))


def normalise_solarwinds(payloads: DataFrame, as_of: datetime | Column | None = None) -> DataFrame:
    """SolarWinds events; with ``as_of`` only those of the day before it, as the
    system's own query returns them."""
    rows = payloads.select(F.explode(_items(F.col("payload"))).alias("record_text"))
    rows = rows.withColumn("r", F.from_json("record_text", _SOLARWINDS))
    out = with_defaults(rows.select(
        time_or_arrival("r.EventTime").alias("timestamp"),
        F.coalesce("r.NetObjectID", F.lit("")).alias("source"),
        F.lit("nms_solarwinds").alias("platform"),
        F.coalesce("r.NetObjectType", F.lit("UNKNOWN")).alias("component"),
        F.coalesce("r.Message", F.lit("")).alias("description"),
        F.col("record_text").alias("raw_message"),
    ))
    if as_of is None:
        return out
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return out.filter(F.col("timestamp") > now - F.expr("INTERVAL 1 DAY"))


def normalise_zabbix(payloads: DataFrame) -> DataFrame:
    """Zabbix events; the numeric severity maps to names, the first host is the source."""
    rows = payloads.select(F.explode(_items(F.col("payload"))).alias("record_text"))
    rows = rows.withColumn("r", F.from_json("record_text", _ZABBIX))
    code = F.coalesce(F.col("r.severity").try_cast("int"), F.lit(0))
    return with_defaults(rows.select(
        F.timestamp_seconds(F.coalesce(F.col("r.clock").try_cast("long"), F.lit(0))).alias("timestamp"),
        F.coalesce(F.get("r.hosts", 0)["host"], F.lit("unknown")).alias("source"),
        F.lit("nms_zabbix").alias("platform"),
        lookup(rules.ZABBIX_SEVERITY, code, "INFO").alias("severity"),
        F.coalesce("r.name", F.lit("")).alias("description"),
        F.col("record_text").alias("raw_message"),
    ))


NORMALISERS = {"solarwinds": normalise_solarwinds, "zabbix": normalise_zabbix, "rest": normalise_rest}


def normalise(payloads: DataFrame, platform: str, **options) -> DataFrame:
    """Raw logs of a platform's payloads; an unknown platform gives an empty table."""
    if platform in NORMALISERS:
        return NORMALISERS[platform](payloads, **options)
    return payloads.sparkSession.createDataFrame([], RAW_LOG)
