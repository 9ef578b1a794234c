"""Log search, point lookup and views on the result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_logs(logs: DataFrame, category: str | None = None, severity: str | None = None,
                source: str | None = None) -> DataFrame:
    """Category and severity are matched upper-cased, the source by substring in any case."""
    if category:
        logs = logs.filter(F.col("category") == category.upper())
    if severity:
        logs = logs.filter(F.col("severity") == severity.upper())
    if source:
        logs = logs.filter(F.contains(F.lower("source"), F.lit(source.lower())))
    return logs


def page(rows: DataFrame, limit: int = 100, offset: int = 0, order=("timestamp", "log_id")) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a total order (a top-n, not a full sort)."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def search_logs(logs: DataFrame, limit: int = 100, offset: int = 0, **filters) -> dict[str, DataFrame]:
    """``total`` (one row) and the ``logs`` of one page."""
    found = filter_logs(logs, **filters)
    return {"total": found.agg(F.count("*").alias("total")), "logs": page(found, limit, offset)}


def log_by_id(logs: DataFrame, log_id: str) -> DataFrame:
    """The log with the id; of several, the first by time."""
    return logs.filter(F.col("log_id") == log_id).orderBy("timestamp", "log_id").limit(1)


def with_total(rows: DataFrame) -> dict[str, DataFrame]:
    return {"total": rows.agg(F.count("*").alias("total")), "rows": rows}


def anomaly_view(anomalies: DataFrame, anomalous_only: bool = True) -> dict[str, DataFrame]:
    return with_total(anomalies.filter("is_anomaly") if anomalous_only else anomalies)


def threat_view(threats: DataFrame) -> dict[str, DataFrame]:
    from netsilt.operators.security import threat_summary

    return {**with_total(threats), "summary": threat_summary(threats)}


def pattern_view(patterns: DataFrame) -> dict[str, DataFrame]:
    """The patterns, most frequent first."""
    from netsilt.operators.patterns import patterns_by_frequency

    return with_total(patterns_by_frequency(patterns))


def alert_view(alerts: DataFrame) -> dict[str, DataFrame]:
    """The maintenance alerts, most probable first."""
    return with_total(alerts.orderBy(F.desc("failure_probability"), "device"))
