"""Schemas of the log tables. Column order is the table contract."""

from __future__ import annotations

from pyspark.sql import types as T

METRICS = T.MapType(T.StringType(), T.DoubleType())
STRINGS = T.ArrayType(T.StringType())

RAW_LOG = T.StructType([
    T.StructField("log_id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("component", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("raw_message", T.StringType()),
    T.StructField("metrics", METRICS),
    T.StructField("tags", STRINGS),
    T.StructField("collected_at", T.TimestampType()),
])

CLASSIFIED_COLUMNS = [
    "log_id", "timestamp", "source", "source_ip", "platform", "raw_message", "description", "metrics",
    "category", "subcategory", "severity", "impacted_components", "version",
    "classification_confidence", "classification_method", "is_anomaly", "anomaly_score",
    "security_threat", "threat_type", "threat_score", "recommended_action", "tags",
]

# A JSON log record before defaults: every key may be absent, metrics may hold
# numbers or numeric strings.
JSON_RECORD = T.StructType([
    T.StructField("log_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("component", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("raw_message", T.StringType()),
    T.StructField("metrics", T.MapType(T.StringType(), T.StringType())),
])
