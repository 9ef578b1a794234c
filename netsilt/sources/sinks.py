"""Result tables and report files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsilt.operators.report import report_sections

TABLES = ["classified_logs", "anomaly_results", "security_threats", "patterns", "maintenance_alerts"]


def table_path(store: str, table: str) -> str:
    if table not in TABLES:
        raise ValueError(f"unknown table {table!r}")
    return f"{store}/{table}"


def append_logs(classified: DataFrame, store: str) -> None:
    """Add classified logs; day partitions let later reads prune by time.

    Rebalancing by day keeps files large and splits a day that holds too much.
    """
    dated = classified.withColumn("log_date", F.to_date("timestamp"))
    dated.hint("rebalance", "log_date").write.mode("append").partitionBy("log_date").parquet(table_path(store, "classified_logs"))


def replace_results(store: str, **results: DataFrame) -> None:
    """Replace the named result tables with new analysis results."""
    for table, df in results.items():
        df.write.mode("overwrite").parquet(table_path(store, table))


def read_table(spark: SparkSession, store: str, table: str) -> DataFrame:
    return spark.read.parquet(table_path(store, table))


def write_report(report: DataFrame, folder: str, as_of: datetime, formats: tuple[str, ...] = ("json", "sections")) -> dict[str, str]:
    """Write the one-row report as JSON, and its dashboard rows as a second file set."""
    stamp = as_of.strftime("%Y%m%d_%H%M%S")
    out = {}
    if "json" in formats:
        out["json"] = f"{folder}/report_{stamp}.json"
        report.write.mode("overwrite").json(out["json"])
    if "sections" in formats:
        out["sections"] = f"{folder}/report_{stamp}_sections"
        report_sections(report).write.mode("overwrite").json(out["sections"])
    return out
