"""Health report: counters, score, recommendations, sections.

Every part is an aggregate or a short top list; parts of one row meet in one
final aggregation over their union, so nothing is cross-joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsilt import rules
from netsilt.functions.columns import bucket, fixed, lookup, rounded, string_array, surrogate_id
from netsilt.operators.anomaly import top_anomalous_devices

TOP_SOURCES = 20


def log_counters(classified: DataFrame) -> DataFrame:
    """(dimension, key, count) by severity, category and source, in one pass."""
    dims = ["severity", "category", "source"]
    counted = classified.groupingSets([[d] for d in dims], *dims).agg(
        F.count("*").alias("count"), F.grouping_id(*dims).alias("gid"))
    # grouping id 3 = severity, 5 = category, 6 = source
    dimension = F.when(F.col("gid") == 3, "severity").when(F.col("gid") == 5, "category").otherwise("source")
    return counted.select(dimension.alias("dimension"), F.coalesce(*dims).alias("key"), "count")


def source_counters(logs: DataFrame) -> DataFrame:
    """The counters by source alone; raw logs do, no pattern is matched for them."""
    return logs.groupBy(F.col("source").alias("key")).agg(F.count("*").alias("count")).select(
        F.lit("source").alias("dimension"), "key", "count")


def top_sources(counters: DataFrame, n: int = TOP_SOURCES) -> DataFrame:
    return counters.filter("dimension = 'source'").orderBy(F.desc("count"), "key").limit(n)


def system_stats(classified: DataFrame, anomalies: DataFrame, threats: DataFrame, patterns: DataFrame,
                 alerts: DataFrame) -> DataFrame:
    """(statistic, key, value): totals, breakdowns and sizes of the result tables."""
    counters = log_counters(classified)
    named = F.concat(F.lit("by_"), F.col("dimension"))
    few = counters.filter("dimension <> 'source'").unionByName(top_sources(counters)).select(
        named.alias("statistic"), "key", F.col("count").alias("value"))
    totals = [
        classified.agg(F.count("*").alias("total_logs"), F.count_if("security_threat").alias("threat_count")),
        anomalies.agg(F.count("*").alias("analyzed_logs"), F.count_if("is_anomaly").alias("anomaly_count"))]
    sizes = {"active_threats": threats, "patterns_found": patterns, "maintenance_alerts": alerts}
    rows = [t.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("statistic"), F.lit("").alias("key"), F.col(c).alias("value"))
        for c in t.columns])).alias("r")).select("r.*") for t in totals]
    rows += [df.agg(F.count("*").alias("value")).select(F.lit(n).alias("statistic"), F.lit("").alias("key"), "value")
             for n, df in sizes.items()]
    return reduce(DataFrame.unionByName, rows, few)


def critical_alerts(threats: DataFrame, alerts: DataFrame) -> DataFrame:
    """Critical and high incidents and maintenance alerts in one shape."""
    urgent = ["CRITICAL", "HIGH"]
    first_action = F.coalesce(F.try_element_at("recommended_actions", F.lit(1)), F.lit(""))
    security = threats.filter(F.col("severity").isin(urgent)).select(
        F.lit("SECURITY").alias("type"), F.col("threat_id").alias("id"),
        F.substring("description", 1, 150).alias("description"), "severity", first_action.alias("action"),
        F.col("score").alias("weight"))
    maintenance = alerts.filter(F.col("risk_level").isin(urgent)).select(
        F.lit("MAINTENANCE").alias("type"), F.col("alert_id").alias("id"),
        F.concat(F.lit("Predicted "), "predicted_failure_type", F.lit(" on "), "device").alias("description"),
        F.col("risk_level").alias("severity"), first_action.alias("action"),
        F.col("failure_probability").alias("weight"))
    return security.unionByName(maintenance)


def first_critical_alerts(urgent: DataFrame, n: int = 20) -> DataFrame:
    """Incidents by score, then maintenance alerts by probability."""
    return urgent.orderBy(F.desc("type"), F.desc("weight"), "id").limit(n)


def _log_part(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.min("timestamp").alias("period_start"), F.max("timestamp").alias("period_end"),
        F.count("*").alias("total_logs"),
        F.count_if(F.col("severity").isin("CRITICAL", "ERROR")).alias("severe_logs"))


def _anomaly_part(anomalies: DataFrame) -> DataFrame:
    return anomalies.agg(
        F.count_if("is_anomaly").alias("total_anomalies"),
        F.count_if(F.col("is_anomaly") & (F.col("anomaly_score") > rules.SEVERITY_UPGRADE_SCORE))
        .alias("high_anomalies"))


def _threat_part(threats: DataFrame) -> DataFrame:
    deduction = lookup(rules.THREAT_DEDUCTION, "severity", 2)
    return threats.agg(
        F.count("*").alias("total_threats"), F.coalesce(F.sum(deduction), F.lit(0)).alias("threat_deduction"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_threats"))


def _pattern_part(patterns: DataFrame) -> DataFrame:
    return patterns.agg(
        F.count("*").alias("total_patterns"),
        F.count_if(F.array_contains("categories", "SECURITY")).alias("security_patterns"))


def _alert_part(alerts: DataFrame) -> DataFrame:
    deduction = lookup(rules.RISK_DEDUCTION, "risk_level", 1)
    return alerts.agg(
        F.count("*").alias("maintenance_alerts"), F.coalesce(F.sum(deduction), F.lit(0)).alias("alert_deduction"))


def _critical_devices(alerts: DataFrame) -> DataFrame:
    """The three most endangered devices as one array."""
    top = alerts.filter("risk_level = 'CRITICAL'").orderBy(F.desc("failure_probability"), "device").limit(3)
    return _as_list(top, "critical_devices", ["failure_probability", "device"], F.col("device"), descending=[0])


def _as_list(top: DataFrame, name: str, order: list[str], value: Column, descending=()) -> DataFrame:
    """A short top list as one array column, in the given order."""
    keys = [(-F.col(c)).alias(f"k{i}") if i in descending else F.col(c).alias(f"k{i}") for i, c in enumerate(order)]
    items = F.array_sort(F.collect_list(F.struct(*keys, value.alias("v"))))
    return top.agg(F.transform(items, lambda x: x["v"]).alias(name))


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """One-row frames side by side."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def with_health(facts: DataFrame) -> DataFrame:
    """Adds overall_health_score (0-100, unrounded) and health_status."""
    score = (
        F.lit(100.0)
        - F.least(F.col("total_anomalies") * 3, F.lit(20))
        - F.col("threat_deduction") - F.col("alert_deduction")
        - F.least(F.col("severe_logs") * 0.5, F.lit(15.0))
    )
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    levels = [("HEALTHY", rules.HEALTHY_SCORE), ("DEGRADED", rules.DEGRADED_SCORE)]
    return facts.withColumn("overall_health_score", bounded).withColumn(
        "health_status", bucket("overall_health_score", levels, "CRITICAL"))


def recommendations() -> Column:
    """Messages that apply, from the columns of the facts row."""
    devices = F.array_join("critical_devices", ", ")
    found = F.array_compact(F.array(
        F.when(F.col("overall_health_score") < rules.DEGRADED_SCORE, F.lit(rules.REC_CRITICAL_HEALTH)),
        F.when(F.col("critical_threats") > 0, F.format_string(rules.REC_THREATS, "critical_threats")),
        F.when(devices != "", F.format_string(rules.REC_DEVICES, devices)),
        F.when(F.col("high_anomalies") >= 3, F.format_string(rules.REC_ANOMALIES, "high_anomalies")),
        F.when(F.col("security_patterns") > 0, F.format_string(rules.REC_PATTERNS, "security_patterns")),
    ))
    return F.when(F.size(found) == 0, string_array([rules.REC_NORMAL])).otherwise(found)


def health_facts(classified: DataFrame, anomalies: DataFrame, threats: DataFrame, patterns: DataFrame,
                 alerts: DataFrame) -> DataFrame:
    """One row: totals, period, deductions, score, status, recommendations."""
    facts = _one_row([
        _log_part(classified), _anomaly_part(anomalies), _threat_part(threats), _pattern_part(patterns),
        _alert_part(alerts), _critical_devices(alerts)])
    return with_health(facts).withColumn("recommendations", recommendations())


def health_report(classified: DataFrame, anomalies: DataFrame, threats: DataFrame, patterns: DataFrame,
                  alerts: DataFrame, as_of: Column) -> DataFrame:
    """The report as one row; breakdowns are maps and arrays of structs."""
    counters = log_counters(classified)
    entry = F.struct(F.col("key"), F.col("count"))
    breakdown = lambda d: F.map_from_entries(F.array_sort(F.collect_list(
        F.when(F.col("dimension") == d, entry))))
    counts = counters.filter("dimension <> 'source'").agg(
        breakdown("severity").alias("logs_by_severity"), breakdown("category").alias("logs_by_category"))
    devices = top_sources(counters).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("logs_by_device"))
    threat_types = threats.groupingSets([["threat_type"], ["severity"]], "threat_type", "severity").agg(
        F.count("*").alias("n"), F.grouping_id("threat_type", "severity").alias("gid"))
    by = lambda gid, c: F.map_from_entries(F.array_sort(F.collect_list(
        F.when(F.col("gid") == gid, F.struct(F.col(c), F.col("n"))))))
    threat_maps = threat_types.agg(
        by(1, "threat_type").alias("threats_by_type"), by(2, "severity").alias("threats_by_severity"))
    anomalous = _as_list(
        top_anomalous_devices(anomalies), "top_anomalous_devices", ["avg_score", "device"],
        F.struct("device", "anomaly_count", "avg_score"), descending=[0])
    pattern_list = _as_list(
        patterns.orderBy(F.desc("frequency"), F.desc("impact_score"), "pattern_id").limit(5), "pattern_summary",
        ["frequency", "impact_score", "pattern_id"], F.struct(
            F.col("pattern_id").alias("id"), F.substring("description", 1, 100).alias("description"), "frequency",
            "severity"), descending=[0, 1])
    alert_list = _as_list(
        alerts.orderBy(F.desc("failure_probability"), "device").limit(10), "maintenance_summary",
        ["failure_probability", "device"], F.struct(
            "device", F.col("risk_level").alias("risk"), F.col("predicted_failure_type").alias("type"),
            F.col("failure_probability").alias("probability")), descending=[0])
    # incidents come before maintenance alerts
    urgent = first_critical_alerts(critical_alerts(threats, alerts)).withColumn(
        "_kind", F.when(F.col("type") == "SECURITY", 0).otherwise(1))
    urgent_list = _as_list(
        urgent, "critical_alerts", ["_kind", "weight", "id"],
        F.struct("type", "id", "description", "severity", "action"), descending=[1])
    facts = health_facts(classified, anomalies, threats, patterns, alerts)
    row = _one_row([facts, counts, devices, threat_maps, anomalous, pattern_list, alert_list, urgent_list])
    return row.select(
        surrogate_id("RPT", F.date_format(as_of, "yyyy-MM-dd HH:mm:ss")).alias("report_id"),
        as_of.alias("generated_at"),
        F.coalesce("period_start", as_of).alias("period_start"),
        F.coalesce("period_end", as_of).alias("period_end"),
        rounded("overall_health_score", 1).alias("overall_health_score"),
        "health_status",
        F.struct("total_logs", "total_anomalies", "total_threats", "total_patterns", "maintenance_alerts")
        .alias("summary"),
        "logs_by_severity", "logs_by_category", "logs_by_device", "top_anomalous_devices",
        F.struct(
            F.col("total_threats").alias("total"), F.col("threats_by_type").alias("by_type"),
            F.col("threats_by_severity").alias("by_severity"), F.col("critical_threats").alias("critical_count"),
        ).alias("threat_summary"),
        "pattern_summary", "maintenance_summary", "critical_alerts", "recommendations",
    )


def report_sections(report: DataFrame) -> DataFrame:
    """(section, rank, key, value, badge): the rows behind the dashboard, from the
    one report row. A section without rows shows its place holder."""
    text = lambda c: c.cast("string")
    line = lambda key, value, badge: F.struct(
        key.alias("key"), value.alias("value"), badge.alias("badge"))
    blank = F.lit("")

    def counted(name: str) -> Column:
        by_count = F.array_sort(F.transform(
            F.map_entries(name), lambda e: F.struct((-e["value"]).alias("c"), e["key"].alias("k"))))
        return F.transform(by_count, lambda e: line(e["k"], text(-e["c"]), blank))

    sections = [
        ("recommendations", F.transform("recommendations", lambda r: line(r, blank, blank)), rules.NO_RECOMMENDATIONS),
        ("critical_alerts", F.transform(F.slice("critical_alerts", 1, 8), lambda a: line(
            F.concat(a["type"], F.lit(" — "), a["description"]), a["action"], a["severity"])),
         rules.NO_CRITICAL_ALERTS),
        ("categories", counted("logs_by_category"), rules.NO_DATA),
        ("severities", counted("logs_by_severity"), rules.NO_DATA),
        ("anomalous_devices", F.transform(F.slice("top_anomalous_devices", 1, 10), lambda d: line(
            d["device"], F.concat(d["anomaly_count"].cast("string"), F.lit(" / "), fixed(d["avg_score"], 3)), blank)),
         rules.NO_ANOMALOUS_DEVICES),
        ("maintenance", F.transform("maintenance_summary", lambda a: line(
            a["device"], F.concat(a["type"], F.lit(" "), fixed(a["probability"] * 100, 1), F.lit("%")), a["risk"])),
         rules.NO_MAINTENANCE_ALERTS),
    ]
    stacked = F.array(*[
        F.struct(F.lit(name).alias("section"), F.when(
            F.size(rows) > 0, rows).otherwise(F.array(line(F.lit(none), blank, blank))).alias("rows"))
        for name, rows, none in sections])
    return report.select(F.inline(stacked)).select("section", F.posexplode("rows").alias("pos", "r")).select(
        "section", (F.col("pos") + 1).alias("rank"), "r.key", "r.value", "r.badge")
