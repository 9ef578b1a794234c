"""Hand-derived results for one night of a campus network."""

from datetime import datetime

from tests.conftest import night_rows
from netsilt import rules
from netsilt.functions import text as X
from netsilt.operators import anomaly, cascade, classify, maintenance, patterns, report, security
from netsilt.plans import analysis
from netsilt.schema import CLASSIFIED_COLUMNS, RAW_LOG
from pyspark.sql import functions as F

MORNING = "2025-03-10 00:00:00"


def by_id(df, *cols):
    return {r["log_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_classification(night_classified):
    assert night_classified.columns == CLASSIFIED_COLUMNS
    got = by_id(night_classified, "category", "subcategory", "classification_confidence", "threat_type", "threat_score")
    assert got == {
        "N-1": ("DNS", "dns_amplification", 0.85, "", 0.0),
        "N-2": ("SECURITY", "ids_alert", 0.85, "dos_attack", 0.95),
        "N-3": ("SECURITY", "ids_alert", 0.85, "dos_attack", 0.70),     # warning, and load above 80
        "N-4": ("HARDWARE", "high_memory", 0.85, "", 0.0),
        "N-5": ("VPN", "tunnel_down", 0.85, "", 0.0),
        "N-6": ("STP", "topology_change", 0.85, "", 0.0),
        "N-7": ("QOS", "queue_overflow", 0.85, "", 0.0),
        "N-8": ("GENERAL", "informational", 0.50, "", 0.0),
    }
    assert night_classified.filter("classification_method <> 'rule' or security_threat <> (threat_score > 0)").count() == 0


def test_components_and_actions(night_classified):
    got = by_id(night_classified, "impacted_components", "version", "recommended_action")
    assert got["N-2"][0] == ["198.51.100.9", "10.20.0.7"] and got["N-5"][0] == ["192.0.2.200", "VPN"]
    assert got["N-6"][0] == ["STP", "INTERFACE"] and got["N-8"][0] == ["DHCP"]
    assert {v[1] for v in got.values()} == {"Unknown"} and got["N-4"][2].startswith("Identify memory consumers")


def test_features(night):
    row = classify.log_features(night).filter("log_id = 'N-2'").first()
    assert len(classify.FEATURES) == 27
    assert row["cpu_usage"] == 0.22 and row["threat_dos_attack"] == 1 and row["kw_bgp"] == 0 and row["severity_num"] == 5
    assert row["has_ip_address"] == 1 and row["has_percent_code"] == 0 and row["has_port_number"] == 1
    assert row["msg_length"] == len("payload 198.51.100.9:4444 to 10.20.0.7 at files.bad-host.net") / 500


def test_substring_words_are_kept(spark):
    df = spark.createDataFrame([("blacklisted report bids",)], "_lower string")
    got = df.select(X.keyword_hits("_lower", ["list", "port", "ids", "acl"]).alias("n")).first()
    assert got["n"] == 3


def test_template(spark):
    df = spark.createDataFrame([("Peer 10.4.0.1 lost on TenGigE0/1/7",), ("  id DEADBEEF\t x 42 ",)],
                               "m string")
    got = [r[0] for r in df.select(X.message_template("m")).collect()]
    assert got == ["peer <ip> lost on <iface>", "id <hex> x <num>"]


def test_iocs(night_classified):
    row = night_classified.filter("log_id = 'N-2'").select(X.iocs(X.search_text()).alias("i")).first()["i"]
    assert row["ips"] == ["198.51.100.9", "10.20.0.7"] and row["ports"] == [4444]
    assert row["domains"] == ["files.bad-host.net"] and row["hashes"] == []


def test_ioc_details(spark):
    text = "évil.example.com A.B.org :70000 :443 :443 " + "a" * 32 + " " + "B" * 65
    row = spark.createDataFrame([(text,)], "t string").select(X.iocs("t").alias("i")).first()["i"]
    assert row["ports"] == [443] and row["hashes"] == ["a" * 32]
    # the accented letter is a word character, so the name starts after the dot
    assert row["domains"] == ["example.com", "A.B.org"]


def test_two_events_are_one_incident(night_classified):
    row, = security.security_incidents(night_classified).collect()
    assert (row["threat_type"], row["origin"], row["event_count"], row["score"], row["severity"]) == (
        "dos_attack", "198.51.100.9", 2, 1.0, "CRITICAL")            # 0.95 and a step for the second event
    assert row["source_ips"] == ["198.51.100.9", "10.20.0.7"] and row["target_ips"] == ["172.30.0.20"]
    assert row["target_ports"] == [4444] and row["affected_devices"] == ["probe-k"]
    assert row["iocs"] == ["198.51.100.9", "10.20.0.7", "files.bad-host.net"]
    assert row["mitre_tactics"] == ["TA0040 - Impact", "T1498 - Network DoS"]
    assert row["recommended_actions"][2] == "Rate-limit traffic from 198.51.100.9, 10.20.0.7."
    assert {r["log_id"] for r in security.incident_logs(night_classified).collect()} == {"N-2", "N-3"}
    once = security.keyed_threats(night_classified)
    assert security.security_incidents(once).collect() == [row]


def test_summary_has_all_severities(night_classified):
    rows = security.threat_summary(security.security_incidents(night_classified)).collect()
    got = {(r["kind"], r["key"]): r["count"] for r in rows}
    assert got == {("total", ""): 1, ("active", ""): 1, ("type", "dos_attack"): 1, ("severity", "CRITICAL"): 1,
                   ("severity", "HIGH"): 0, ("severity", "MEDIUM"): 0, ("severity", "LOW"): 0}
    empty = security.threat_summary(security.security_incidents(night_classified.filter("false"))).collect()
    assert sum(r["count"] for r in empty) == 0 and len(empty) == 6


def test_cascades(night_classified):
    """The flood of questions before both alerts, each alert before the full memory; the rest has no cause or is too late."""
    rows = cascade.cascade_correlations(night_classified).collect()
    assert {(r["root_event_id"], r["first_effect_id"], r["last_effect_id"], r["related_count"], r["confidence"]) for r in rows} == {
        ("N-1", "N-2", "N-3", 2, 0.72), ("N-2", "N-4", "N-4", 1, 0.80), ("N-3", "N-4", "N-4", 1, 0.80)}
    found = cascade.cascade_sources(night_classified).groupBy("correlation_id").agg(F.sort_array(F.collect_set("source")).alias("s"))
    assert sorted(r["s"] for r in found.collect()) == [["box-m", "probe-k"], ["box-m", "probe-k"], ["ns-lab", "probe-k"]]


def test_cascades_follow_time_order(spark):
    moved = classify.classify(spark.createDataFrame(night_rows({"N-1": 6, "N-4": 64}), RAW_LOG))
    rows = cascade.cascade_correlations(moved).collect()
    assert {(r["root_event_id"], r["first_effect_id"]) for r in rows} == {("N-2", "N-4"), ("N-3", "N-4")}
    late = classify.classify(spark.createDataFrame(night_rows({"N-4": 65}), RAW_LOG))
    assert {r["root_event_id"] for r in cascade.cascade_correlations(late).collect()} == {"N-1", "N-3"}


def test_untrained_anomaly_scores(night_classified):
    got = by_id(anomaly.anomaly_scores(night_classified), "anomaly_score", "is_anomaly", "anomaly_type")
    boosts = {"N-2": 0.30, "N-3": 0.05}     # the mean of 0 and the boost
    assert got == {f"N-{k}": (boosts.get(f"N-{k}", 0.0) / 2, False, "none") for k in range(1, 9)}


def test_enrichment_keeps_rows(night_classified):
    found = anomaly.anomaly_scores(night_classified, threshold=0.02)
    rich = anomaly.enrich_logs(night_classified, found)
    assert rich.columns == CLASSIFIED_COLUMNS
    assert by_id(rich.filter("is_anomaly"), "anomaly_score") == {"N-2": (0.15,), "N-3": (0.025,)}


def test_health(night_classified):
    """15 off for the critical incident, half a point for each of three critical and error logs."""
    out = analysis.analyse_classified(night_classified, analysis.at(MORNING))
    row = out.report(analysis.at(MORNING)).first()
    assert row["overall_health_score"] == 83.5
    assert row["recommendations"] == ["🔴 1 critical security threat(s) active. Engage SOC team immediately."]
    assert row["summary"]["total_logs"] == 8 and row["summary"]["total_threats"] == 1
    assert row["logs_by_severity"] == {"CRITICAL": 1, "ERROR": 2, "WARNING": 3, "NOTICE": 1, "INFO": 1}
    assert [a["type"] for a in row["critical_alerts"]] == ["SECURITY"]
    sections = report.report_sections(out.report(analysis.at(MORNING))).collect()
    assert ("maintenance", 1, "No maintenance alerts.") in [(r["section"], r["rank"], r["key"]) for r in sections]
    assert out.counts() == {"log_count": 8, "anomalies": 0, "threats": 1, "patterns": 0, "maintenance_alerts": 0}


def test_empty_log_table(night_classified):
    out = analysis.analyse_classified(night_classified.filter("false"), analysis.at(MORNING))
    row = out.report(analysis.at(MORNING)).first()
    assert row["overall_health_score"] == 100.0 and row["health_status"] == "HEALTHY"
    assert row["period_start"] == datetime(2025, 3, 10) and row["recommendations"][0].startswith("✅")


def test_toggles(night_classified):
    out = analysis.analyse_classified(night_classified, analysis.at(MORNING), run_anomaly=False,
                                      run_patterns=False, run_prediction=False)
    assert list(out.tables) == ["threats"]
    row = out.report(analysis.at(MORNING)).first()
    assert row["summary"]["total_threats"] == 1 and row["summary"]["total_patterns"] == 0
    assert out.enriched().count() == 8


def test_patterns_need_three(night_classified):
    assert patterns.recurring_patterns(night_classified).count() == 0
    found = {r["template"]: r["frequency"] for r in patterns.recurring_patterns(night_classified, min_frequency=1).collect()}
    assert found.pop("signature <hex>, syn flood out of <ip>") == 2 and len(found) == 6 and set(found.values()) == {1}


def test_risk_and_windows(spark):
    df = spark.createDataFrame([(p,) for p in (0.9, 0.7, 0.5, 0.1)], "p double").withColumn(
        "risk", maintenance.risk_level("p"))
    now = F.lit("2025-09-01 22:30:00").cast("timestamp")
    got = {r["risk"]: r["w"] for r in df.select("risk", maintenance.maintenance_window(F.col("risk"), now).alias("w")).collect()}
    assert got == {
        "CRITICAL": "Within 4 hours (by 2025-09-02 02:30 UTC)",
        "HIGH": "Next maintenance window: 2025-09-02 02:00-04:00 UTC",
        "MEDIUM": "Routine maintenance before 2025-09-08 UTC",
        "LOW": "Routine maintenance before 2025-09-08 UTC"}


def test_templates_are_made_once(spark):
    """The most common category comes from the same pass as the rest; among equals the one seen first."""
    at = lambda i: datetime(2025, 9, 1, 0, i)
    second, first = sorted(rules.PATTERN_ACTION)[:2]
    rows = [(at(i), f"d{i}", c, "ERROR", "port 1 lost") for i, c in enumerate([first, second, second, first, "Z"])]
    df = spark.createDataFrame(rows, "timestamp timestamp, source string, category string, severity string, description string")
    found = patterns.recurring_patterns(df, 3)
    assert str(found._jdf.queryExecution().executedPlan()).count("Scan ExistingRDD") == 1
    (one,) = found.collect()
    assert (one["frequency"], one["source_count"], one["categories"]) == (5, 5, [second, first, "Z"])
    assert one["recommended_action"] == rules.PATTERN_ACTION[first] != rules.PATTERN_ACTION[second]
