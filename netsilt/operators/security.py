"""Security incidents: single-log assessment, consolidation, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsilt import rules
from netsilt.functions import text as X
from netsilt.functions.columns import bucket, computed_once, list_lookup, rounded, string_array, surrogate_id


def incident_severity(score: str | Column) -> Column:
    return bucket(score, rules.INCIDENT_SEVERITY, "LOW")


def mitre_tactics(threat_type: str | Column) -> Column:
    """Tactics of a threat type; a literal map, so no join is needed."""
    return list_lookup(rules.MITRE_TACTICS, threat_type, rules.DEFAULT_MITRE)


def incident_actions(threat_type: Column, severity: Column, source_ips: Column) -> Column:
    first_ips = F.array_join(F.slice(source_ips, 1, 3), ", ")
    ip_list = F.when(first_ips == "", F.lit(rules.UNKNOWN_SOURCE)).otherwise(first_ips)
    steps = list_lookup(rules.INCIDENT_ACTIONS, threat_type, rules.DEFAULT_INCIDENT_ACTIONS)
    named = F.transform(steps, lambda s: F.replace(s, F.lit("%s"), ip_list))
    urgent = string_array([rules.CRITICAL_INCIDENT_ACTION])
    return F.when(severity == "CRITICAL", F.concat(urgent, named)).otherwise(named)


def threat_logs(classified: DataFrame) -> DataFrame:
    """Logs that carry a threat of at least the minimum score, with their IOCs."""
    threats = classified.filter(F.col("security_threat") & (F.col("threat_score") >= rules.MIN_INCIDENT_SCORE))
    return computed_once(threats, _iocs=X.iocs(X.search_text()))


def _assessment(c: dict[str, Column]) -> dict[str, Column]:
    """Incident fields of one log; ``c`` maps the needed inputs to columns."""
    severity = incident_severity(c["score"])
    no_ip = F.coalesce(c["source_ip"], F.lit("")) == ""
    return {
        "target_ips": F.when(no_ip, F.array().cast("array<string>")).otherwise(F.array(c["source_ip"])),
        "target_ports": F.slice(c["ports"], 1, 10),
        "affected_devices": F.array(c["source"]),
        "description": F.substring(c["description"], 1, 300),
        "mitre_tactics": mitre_tactics(c["threat_type"]),
        "recommended_actions": incident_actions(c["threat_type"], severity, c["ips"]),
    }


def assess_logs(classified: DataFrame) -> DataFrame:
    """One incident per threatening log."""
    logs = threat_logs(classified)
    fields = _assessment({
        "score": F.col("threat_score"), "source_ip": F.col("source_ip"), "source": F.col("source"),
        "description": F.col("description"), "threat_type": F.col("threat_type"),
        "ips": F.col("_iocs.ips"), "ports": F.col("_iocs.ports"),
    })
    return logs.select(
        surrogate_id("THR", "log_id").alias("threat_id"),
        "threat_type",
        incident_severity("threat_score").alias("severity"),
        F.col("threat_score").alias("score"),
        F.slice("_iocs.ips", 1, 5).alias("source_ips"),
        fields["target_ips"].alias("target_ips"),
        fields["target_ports"].alias("target_ports"),
        fields["affected_devices"].alias("affected_devices"),
        F.array("log_id").alias("log_ids"),
        F.col("timestamp").alias("first_seen"),
        F.col("timestamp").alias("last_seen"),
        F.lit(1).cast("long").alias("event_count"),
        fields["description"].alias("description"),
        F.concat("_iocs.ips", "_iocs.domains", "_iocs.hashes").alias("iocs"),
        fields["mitre_tactics"].alias("mitre_tactics"),
        fields["recommended_actions"].alias("recommended_actions"),
        F.lit(True).alias("is_active"),
    )


def keyed_threats(classified: DataFrame) -> DataFrame:
    """Threat logs with their indicators and incident key (threat type, first address or device). The
    incident operators take classified logs or these, so that indicators are looked for once."""
    if "origin" in classified.columns:
        return classified
    logs = threat_logs(classified)
    first_ip = F.try_element_at("_iocs.ips", F.lit(1))
    return logs.withColumn("origin", F.coalesce(first_ip, F.col("source")))


def security_incidents(classified: DataFrame) -> DataFrame:
    """Threat logs consolidated by threat type and origin.

    A log stands for itself and for each of its addresses, so one pass gives the incident's figures (rows
    without an address) and its distinct addresses. Both combine on the map side, and only the first twenty addresses
    by rank are kept, so an incident with a third of all logs never gathers in one task. The logs
    of an incident are the relation ``incident_logs``.
    """
    keys = ["threat_type", "origin"]
    item = "struct<pos:int,ip:string>"
    itself = F.array(F.lit(None).cast(item))
    addresses = F.transform("_iocs.ips", lambda ip, pos: F.struct(pos.cast("int").alias("pos"), ip.alias("ip")))
    logs = keyed_threats(classified).withColumn("_item", F.explode(F.concat(itself, addresses.cast(f"array<{item}>"))))
    alone = F.col("_item").isNull()
    first = F.struct(
        "timestamp", "log_id", "source", "source_ip", F.substring("description", 1, 300).alias("description"),
        F.col("threat_score").alias("score"), F.slice("_iocs.ips", 1, 3).alias("ips"),
        F.slice("_iocs.ports", 1, 10).alias("ports"), F.slice("_iocs.domains", 1, 20).alias("domains"))
    cells = logs.groupBy(*keys, F.col("_item.ip").alias("ip")).agg(
        F.count("*").alias("event_count"), F.max("threat_score").alias("_max_score"), F.max("timestamp").alias("last_seen"),
        F.min(F.when(alone, first)).alias("_first"), F.min(F.struct("timestamp", "log_id", "_item.pos")).alias("seen"))
    rank = Window.partitionBy(*keys).orderBy(F.col("ip").isNotNull(), "seen", "ip")
    few = cells.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= 21)
    of_incident = lambda c: F.max_by(c, F.col("ip").isNull()).alias(c)
    joined = few.groupBy(*keys).agg(
        *[of_incident(c) for c in ("event_count", "_max_score", "last_seen", "_first")],
        F.array_sort(F.collect_list(F.when(F.col("ip").isNotNull(), F.struct("rank", "ip")))).alias("_ips")).withColumns({
            "_ips": F.col("_ips.ip"),
            "score": rounded(F.least(
                F.col("_max_score") + rules.EVENT_SCORE_STEP * (F.col("event_count") - 1), F.lit(1.0)), 3)})
    fields = _assessment({
        "score": F.col("_first.score"), "source_ip": F.col("_first.source_ip"), "source": F.col("_first.source"),
        "description": F.col("_first.description"), "threat_type": F.col("threat_type"),
        "ips": F.col("_first.ips"), "ports": F.col("_first.ports"),
    })
    return joined.select(
        surrogate_id("THR", "_first.log_id").alias("threat_id"),
        "threat_type",
        "origin",
        incident_severity("score").alias("severity"),
        "score",
        F.slice("_ips", 1, 10).alias("source_ips"),
        fields["target_ips"].alias("target_ips"),
        fields["target_ports"].alias("target_ports"),
        fields["affected_devices"].alias("affected_devices"),
        F.col("_first.timestamp").alias("first_seen"),
        "last_seen",
        "event_count",
        fields["description"].alias("description"),
        F.slice(F.array_distinct(F.concat("_ips", "_first.domains")), 1, 20).alias("iocs"),
        fields["mitre_tactics"].alias("mitre_tactics"),
        fields["recommended_actions"].alias("recommended_actions"),
        F.lit(True).alias("is_active"),
    )


def incident_logs(classified: DataFrame) -> DataFrame:
    """(threat_id, log_id): the logs behind each incident, all of them.

    The incident side holds one row per key; a hot key on the log side is split
    by the adaptive skew join.
    """
    logs = keyed_threats(classified).select("threat_type", "origin", "timestamp", "log_id")
    ids = logs.groupBy("threat_type", "origin").agg(F.min(F.struct("timestamp", "log_id")).alias("_first"))
    return logs.join(ids, ["threat_type", "origin"]).select(
        surrogate_id("THR", "_first.log_id").alias("threat_id"), "log_id")


def incident_addresses(classified: DataFrame) -> DataFrame:
    """(threat_id, ip): all addresses in the logs of each incident; the incident itself lists
    the first few."""
    logs = keyed_threats(classified).select("threat_type", "origin", "timestamp", "log_id", F.col("_iocs.ips").alias("ips"))
    ids = logs.groupBy("threat_type", "origin").agg(F.min(F.struct("timestamp", "log_id")).alias("_first"))
    found = logs.select("threat_type", "origin", F.explode("ips").alias("ip")).distinct()
    return found.join(ids, ["threat_type", "origin"]).select(
        surrogate_id("THR", "_first.log_id").alias("threat_id"), "ip")


def threats_by_score(threats: DataFrame) -> DataFrame:
    return threats.orderBy(F.desc("score"), "threat_id")


def threat_summary(threats: DataFrame) -> DataFrame:
    """(kind, key, count): total, active, by type, and all four severities."""
    zero = threats.sparkSession.createDataFrame(
        [("severity", s, 0) for s in rules.THREAT_SEVERITIES] + [("total", "", 0), ("active", "", 0)],
        "kind string, key string, count long")
    counted = threats.groupingSets(
        [["threat_type"], ["severity"], []], "threat_type", "severity",
    ).agg(
        F.count("*").alias("count"),
        F.count_if("is_active").alias("active"),
        F.grouping_id("threat_type", "severity").alias("gid"),
    )
    # grouping id 1 = by type, 2 = by severity, 3 = everything
    rows = counted.select(F.explode(F.when(F.col("gid") == 1, F.array(_entry("type", "threat_type", "count")))
                                    .when(F.col("gid") == 2, F.array(_entry("severity", "severity", "count")))
                                    .otherwise(F.array(_entry("total", None, "count"),
                                                       _entry("active", None, "active")))).alias("e")).select("e.*")
    return rows.unionByName(zero).groupBy("kind", "key").agg(F.sum("count").alias("count"))


def _entry(kind: str, key: str | None, count: str) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        (F.col(key) if key else F.lit("")).alias("key"),
        F.col(count).alias("count"),
    )


def top_source_ips(threats: DataFrame, n: int = 10) -> DataFrame:
    return (
        threats.select(F.explode("source_ips").alias("ip")).groupBy("ip").count()
        .orderBy(F.desc("count"), "ip").limit(n)
    )
