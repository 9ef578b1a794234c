"""Oracles: counters, search, report, sections, sources."""

from __future__ import annotations

from netsilt import rules
from oracles.analysis import ALERTS, ANOMALIES, PATTERNS, THREATS, TOP_DEVICES, short_id, text_of
from oracles.base import CLASSIFIED, LOGS, case_of, has, q, with_ctes
from oracles.classification import ACTION

SQL: dict[str, str] = {}

COUNTERS = """
counters AS (
  SELECT 'severity' AS dimension, severity AS key, count(*) AS count FROM classified GROUP BY severity
  UNION ALL SELECT 'category', category, count(*) FROM classified GROUP BY category
  UNION ALL SELECT 'source', source, count(*) FROM classified GROUP BY source
),
device_counts AS (SELECT key, count FROM counters WHERE dimension = 'source' ORDER BY count DESC, key LIMIT 20)"""
SQL["log_counters"] = with_ctes(LOGS, CLASSIFIED, COUNTERS, select="SELECT * FROM counters")
SQL["top_sources"] = with_ctes(LOGS, CLASSIFIED, COUNTERS, select="SELECT * FROM device_counts")

_HITS = "SELECT * FROM classified WHERE category = 'SECURITY' AND severity = 'CRITICAL' AND contains(lower(source), 'dev-01')"
SQL["log_search"] = with_ctes(LOGS, CLASSIFIED, f"hits AS ({_HITS})", select="""
SELECT * FROM (SELECT log_id, ts AS "timestamp", source, category, severity, threat_type, NULL::BIGINT AS total
  FROM hits ORDER BY ts, log_id LIMIT 100 OFFSET 20)
UNION ALL SELECT '', NULL, '', '', '', '', count(*) FROM hits""")
SQL["log_by_id"] = with_ctes(LOGS, CLASSIFIED, select=f"""
SELECT log_id, source, category, severity, {ACTION} AS recommended_action FROM classified WHERE log_id = 'LOG-00000123'""")
SQL["anomaly_view"] = with_ctes(LOGS, CLASSIFIED, ANOMALIES, select="""
SELECT log_id, source, anomaly_score, anomaly_type, severity_upgrade FROM anomalies WHERE is_anomaly""")

ALL = (LOGS, CLASSIFIED, ANOMALIES, TOP_DEVICES, THREATS, PATTERNS, ALERTS)
SQL["analysis_counts"] = with_ctes(*ALL, select="""
SELECT 'anomalies' AS analysis, count(*) AS count FROM anomalies WHERE is_anomaly
UNION ALL SELECT 'threats', count(*) FROM threats UNION ALL SELECT 'patterns', count(*) FROM patterns
UNION ALL SELECT 'maintenance_alerts', count(*) FROM alerts""")
SQL["system_stats"] = with_ctes(*ALL, COUNTERS, select="""
SELECT 'by_' || dimension AS statistic, key, count AS value FROM counters WHERE dimension <> 'source'
UNION ALL SELECT 'by_source', key, count FROM device_counts
UNION ALL SELECT 'total_logs', '', count(*) FROM classified
UNION ALL SELECT 'anomaly_count', '', count(*) FROM anomalies WHERE is_anomaly
UNION ALL SELECT 'threat_count', '', count(*) FROM classified WHERE security_threat
UNION ALL SELECT 'analyzed_logs', '', count(*) FROM anomalies
UNION ALL SELECT 'active_threats', '', count(*) FROM threats
UNION ALL SELECT 'patterns_found', '', count(*) FROM patterns
UNION ALL SELECT 'maintenance_alerts', '', count(*) FROM alerts""")

URGENT = """
urgent AS (
  SELECT 'SECURITY' AS type, threat_id AS id, substr(description, 1, 150) AS description, severity, actions[1] AS action,
    score AS weight, 0 AS kind FROM threats WHERE severity IN ('CRITICAL', 'HIGH')
  UNION ALL
  SELECT 'MAINTENANCE', alert_id, 'Predicted ' || predicted_failure_type || ' on ' || device, risk_level, actions[1],
    failure_probability, 1 FROM alerts WHERE risk_level IN ('CRITICAL', 'HIGH')
)"""
SQL["critical_alerts"] = with_ctes(*ALL, URGENT, select="SELECT type, id, description, severity, action FROM urgent")

FACTS = f"""
facts AS (
  SELECT
    (SELECT min(ts) FROM classified) AS period_start, (SELECT max(ts) FROM classified) AS period_end,
    (SELECT count(*) FROM classified) AS total_logs,
    (SELECT count(*) FROM classified WHERE severity IN ('CRITICAL', 'ERROR')) AS severe,
    (SELECT count(*) FROM anomalies WHERE is_anomaly) AS total_anomalies,
    (SELECT count(*) FROM anomalies WHERE is_anomaly AND anomaly_score > 0.80::DOUBLE) AS high_anomalies,
    (SELECT count(*) FROM threats) AS total_threats,
    (SELECT count(*) FROM threats WHERE severity = 'CRITICAL') AS critical_threats,
    (SELECT coalesce(sum({case_of('severity', rules.THREAT_DEDUCTION, '2.0::DOUBLE')}), 0) FROM threats) AS threat_cost,
    (SELECT count(*) FROM patterns) AS total_patterns,
    (SELECT count(*) FROM patterns WHERE list_contains(category_list, 'SECURITY')) AS security_patterns,
    (SELECT count(*) FROM alerts) AS maintenance_alerts,
    (SELECT coalesce(sum({case_of('risk_level', rules.RISK_DEDUCTION, '1.0::DOUBLE')}), 0) FROM alerts) AS alert_cost,
    (SELECT coalesce(string_agg(device, ', ' ORDER BY failure_probability DESC, device), '') FROM (
      SELECT * FROM alerts WHERE risk_level = 'CRITICAL' ORDER BY failure_probability DESC, device LIMIT 3)) AS endangered
),
health AS (
  SELECT *, greatest(0, least(100, 100.0::DOUBLE - least(total_anomalies * 3, 20) - threat_cost - alert_cost
    - least(severe * 0.5::DOUBLE, 15))) AS score FROM facts
),
judged_health AS (
  SELECT *, CASE WHEN score >= 80 THEN 'HEALTHY' WHEN score >= 50 THEN 'DEGRADED' ELSE 'CRITICAL' END AS health_status,
    list_filter([
      CASE WHEN score < 50 THEN {q(rules.REC_CRITICAL_HEALTH)} END,
      CASE WHEN critical_threats > 0 THEN replace({q(rules.REC_THREATS)}, '%d', critical_threats::VARCHAR) END,
      CASE WHEN endangered <> '' THEN replace({q(rules.REC_DEVICES)}, '%s', endangered) END,
      CASE WHEN high_anomalies >= 3 THEN replace({q(rules.REC_ANOMALIES)}, '%d', high_anomalies::VARCHAR) END,
      CASE WHEN security_patterns > 0 THEN replace({q(rules.REC_PATTERNS)}, '%d', security_patterns::VARCHAR) END
    ], lambda x: x IS NOT NULL) AS found
  FROM health
),
advised AS (SELECT *, CASE WHEN len(found) = 0 THEN [{q(rules.REC_NORMAL)}] ELSE found END AS recs FROM judged_health)"""
SQL["recommendations"] = with_ctes(*ALL, FACTS, select="""
SELECT round(score, 1) AS overall_health_score, health_status, unnest(range(len(recs)))::INTEGER AS position,
  unnest(recs) AS recommendation FROM advised""")


def _joined(expr: str, source: str, order: str) -> str:
    return f"(SELECT coalesce(string_agg({expr}, '|' ORDER BY {order}), '') FROM {source})"


_ALERT_TOP = "(SELECT * FROM alerts ORDER BY failure_probability DESC, device LIMIT 10)"
_PATTERN_TOP = "(SELECT * FROM patterns ORDER BY frequency DESC, impact_score DESC, pattern_id LIMIT 5)"
_URGENT_TOP = "(SELECT * FROM urgent ORDER BY kind, weight DESC, id LIMIT 20)"
SQL["health_report"] = with_ctes(*ALL, COUNTERS, URGENT, FACTS, select=f"""
SELECT {short_id('RPT', "'2024-02-01 00:00:00'")} AS report_id, TIMESTAMP '2024-02-01' AS generated_at, period_start, period_end,
  round(score, 1) AS overall_health_score, health_status, total_logs, total_anomalies, total_threats, total_patterns,
  maintenance_alerts,
  {_joined("key || '=' || count", "counters WHERE dimension = 'severity'", "key")} AS logs_by_severity,
  {_joined("key || '=' || count", "counters WHERE dimension = 'category'", "key")} AS logs_by_category,
  {_joined("key || '=' || count", "device_counts", "key")} AS logs_by_device,
  {_joined("device || '~' || anomaly_count", "top_devices", "avg_score DESC, device")} AS top_anomalous_devices,
  total_threats AS threats_total,
  {_joined("threat_type || '=' || n", "(SELECT threat_type, count(*) AS n FROM threats GROUP BY 1)", "threat_type")} AS threats_by_type,
  {_joined("severity || '=' || n", "(SELECT severity, count(*) AS n FROM threats GROUP BY 1)", "severity")} AS threats_by_severity,
  critical_threats,
  {_joined("pattern_id || '~' || substr(description, 1, 100) || '~' || frequency || '~' || severity", _PATTERN_TOP,
           "frequency DESC, impact_score DESC, pattern_id")} AS pattern_summary,
  {_joined("device || '~' || risk_level || '~' || predicted_failure_type", _ALERT_TOP,
           "failure_probability DESC, device")} AS maintenance_summary,
  {_joined("type || '~' || id || '~' || description || '~' || severity || '~' || action", _URGENT_TOP,
           "kind, weight DESC, id")} AS critical_alerts,
  {text_of('recs')} AS recommendations
FROM advised""")

SQL["report_files"] = with_ctes(*ALL, COUNTERS, URGENT, FACTS, select="""
SELECT round(score, 1) AS overall_health_score, total_logs, total_threats, total_patterns, maintenance_alerts,
  (SELECT count(*) FROM counters WHERE dimension IN ('category', 'severity')) AS section_rows FROM advised""")
SQL["result_views"] = with_ctes(*ALL, select="""
SELECT 'anomalies' AS view, count(*) AS total, count(*) AS listed FROM anomalies WHERE is_anomaly
UNION ALL SELECT 'threats', count(*), count(*) FROM threats UNION ALL SELECT 'patterns', count(*), count(*) FROM patterns
UNION ALL SELECT 'maintenance', count(*), count(*) FROM alerts""")


def _section(name: str, source: str, order: str, key: str, value: str, badge: str, none: str) -> str:
    return f"""
SELECT '{name}' AS section, rank::INTEGER AS rank, key, value, badge FROM (
  SELECT row_number() OVER (ORDER BY {order}) AS rank, {key} AS key, {value} AS value, {badge} AS badge FROM {source})
UNION ALL SELECT '{name}', 1, {q(none)}, '', '' WHERE NOT EXISTS (SELECT 1 FROM {source})"""


SQL["report_sections"] = with_ctes(*ALL, COUNTERS, URGENT, FACTS, select=" UNION ALL ".join([
    _section("recommendations", "(SELECT unnest(range(len(recs))) AS i, unnest(recs) AS r FROM advised)", "i", "r", "''",
             "''", rules.NO_RECOMMENDATIONS),
    _section("critical_alerts", "(SELECT * FROM urgent ORDER BY kind, weight DESC, id LIMIT 8)", "kind, weight DESC, id",
             "type || ' — ' || description", "action", "severity", rules.NO_CRITICAL_ALERTS),
    _section("categories", "(SELECT * FROM counters WHERE dimension = 'category')", "count DESC, key", "key",
             "count::VARCHAR", "''", rules.NO_DATA),
    _section("severities", "(SELECT * FROM counters WHERE dimension = 'severity')", "count DESC, key", "key",
             "count::VARCHAR", "''", rules.NO_DATA),
    _section("anomalous_devices", "top_devices", "avg_score DESC, device", "device",
             "format('{:d} / {:.3f}', anomaly_count, avg_score)", "''", rules.NO_ANOMALOUS_DEVICES),
    _section("maintenance", _ALERT_TOP, "failure_probability DESC, device", "device",
             "format('{} {:.1f}%', predicted_failure_type, failure_probability * 100)", "risk_level",
             rules.NO_MAINTENANCE_ALERTS),
]))


# ---------------------------------------------------------------- sources

_COMPONENT = "CASE " + " ".join(f"WHEN {has(p, 'message')} THEN {q(n)}" for n, p in rules.SYSLOG_COMPONENTS) + " ELSE 'UNKNOWN' END"
_SEVERITY = case_of("(event_id % 8)", dict(enumerate(rules.SYSLOG_SEVERITIES)), "'INFO'")
SQL["syslog_parse"] = with_ctes(LOGS, f"""
messages AS (SELECT event_id, '<' || (event_id % 8 + 128) || '>' || raw_message AS message FROM logs),
parsed AS (SELECT *, {_SEVERITY} AS severity, {_COMPONENT} AS component, substr(message, 1, 200) AS description FROM messages)""",
    select=f"""
SELECT 'file' AS source_ip, 'syslog' AS platform,
  component, severity, description, message AS raw_message FROM parsed""")

SQL["enriched_syslog"] = with_ctes(LOGS, CLASSIFIED.replace("FROM logs", "FROM (SELECT * REPLACE (substr(raw_message, 1, 200) AS description) FROM logs)"), select="""
SELECT category, count(*) AS logs, count(DISTINCT log_id) AS ids FROM classified GROUP BY category""")

_RECORDS = """
records AS (
  SELECT *, mem::INTEGER AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS sec FROM logs
),
shaped AS (
  SELECT *, CASE WHEN event_id % 2 = 0
    THEN json_object('log_id', log_id, 'timestamp', sec, 'source', source, 'source_ip', source_ip, 'platform', platform,
      'component', 'BGP', 'version', 'IOS 15.2', 'severity', lower(severity), 'description', description,
      'raw_message', raw_message, 'metrics', json_object('cpu_usage', k))::VARCHAR
    ELSE json_object('source', source, 'message', description, 'metrics', json_object('cpu_usage', k))::VARCHAR END AS record
  FROM records
)"""
_FULL = "event_id % 2 = 0"


def _raw(platform: str, component: str, severity: str, description: str, raw_message: str, more: str = "") -> str:
    return f"""source, {platform} AS platform, {component} AS component,
  CASE WHEN {_FULL} THEN 'IOS 15.2' ELSE '' END AS version, {severity} AS severity, {description} AS description,
  {raw_message} AS raw_message, 'cpu_usage=' || k AS metrics{more}"""


SQL["json_logs"] = with_ctes(LOGS, _RECORDS, select="SELECT " + _raw(
    f"CASE WHEN {_FULL} THEN platform ELSE 'file' END", f"CASE WHEN {_FULL} THEN 'BGP' ELSE 'UNKNOWN' END",
    f"CASE WHEN {_FULL} THEN severity ELSE 'INFO' END", f"CASE WHEN {_FULL} THEN description ELSE '' END",
    f"CASE WHEN {_FULL} THEN raw_message ELSE record END",
    f", CASE WHEN {_FULL} THEN source_ip ELSE '' END AS source_ip, CASE WHEN {_FULL} THEN log_id END AS log_id") + " FROM shaped")
SQL["api_logs"] = with_ctes(LOGS, _RECORDS, select="SELECT " + _raw(
    f"CASE WHEN {_FULL} THEN platform ELSE 'api' END", f"CASE WHEN {_FULL} THEN 'BGP' ELSE '' END",
    f"CASE WHEN {_FULL} THEN lower(severity) ELSE 'INFO' END", f"CASE WHEN {_FULL} THEN description ELSE '' END",
    f"CASE WHEN {_FULL} THEN raw_message ELSE '' END",
    f", CASE WHEN {_FULL} THEN source_ip ELSE '' END AS source_ip, CASE WHEN {_FULL} THEN log_id ELSE '' END AS log_id") + " FROM shaped")
_REST = "(SELECT * FROM shaped UNION ALL SELECT * FROM shaped WHERE event_id % 3 = 2)"
SQL["normalise_rest"] = with_ctes(LOGS, _RECORDS, f"rest AS (SELECT event_id, " + _raw(
    "'api'", f"CASE WHEN {_FULL} THEN 'BGP' ELSE 'UNKNOWN' END", f"CASE WHEN {_FULL} THEN severity ELSE 'INFO' END",
    "description", "record") + f" FROM {_REST})", select=f"""
SELECT * EXCLUDE (event_id) FROM rest""")
_SW = """
sw AS (
  SELECT *, json_object('EventTime', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'NetObjectID', source, 'NetObjectType', 'Interface',
    'Message', description)::VARCHAR AS item, date_trunc('second', ts) AS at_second FROM logs
)"""
SQL["normalise_solarwinds"] = with_ctes(LOGS, _SW, select="""
SELECT source, 'nms_solarwinds' AS platform, 'Interface' AS component, '' AS version, 'INFO' AS severity, description,
  item AS raw_message, '' AS metrics, at_second AS "timestamp" FROM sw""")
SQL["solarwinds_last_day"] = with_ctes(LOGS, _SW, select=f"""
SELECT at_second AS "timestamp", source, description FROM sw
WHERE at_second > TIMESTAMP '2024-01-30'""")
_Z = case_of("(event_id % 7)", rules.ZABBIX_SEVERITY, "'INFO'")
SQL["normalise_zabbix"] = with_ctes(LOGS, f"""
zabbix AS (
  SELECT *, (us // 1000000) AS sec, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE source END AS host,
    CASE WHEN event_id % 5 = 0 THEN '[]' ELSE '[{{"host":"' || source || '"}}]' END AS hosts FROM logs
)""", select=f"""
SELECT host AS source, 'nms_zabbix' AS platform, '' AS component, '' AS version, {_Z} AS severity, 'DHCP lease' AS description,
  '{{"clock":"' || sec || '","hosts":' || hosts || ',"severity":"' || (event_id % 7) || '","name":"DHCP lease"}}' AS raw_message,
  '' AS metrics, sec AS epoch_seconds FROM zabbix""")
SQL["merged_sources"] = with_ctes(LOGS, f"""
merged AS (
  SELECT 'syslog' AS platform, 'INFO' AS severity FROM logs
  UNION ALL SELECT CASE WHEN {_FULL} THEN platform ELSE 'file' END, CASE WHEN {_FULL} THEN severity ELSE 'INFO' END FROM logs
  UNION ALL SELECT CASE WHEN {_FULL} THEN platform ELSE 'api' END, CASE WHEN {_FULL} THEN lower(severity) ELSE 'INFO' END FROM logs
  UNION ALL SELECT 'nms_solarwinds', 'INFO' FROM logs
)""", select="SELECT platform, severity, count(*) AS count FROM merged GROUP BY platform, severity")
SQL["read_syslog_files"] = SQL["syslog_parse"]
SQL["read_json_files"] = SQL["json_logs"]
