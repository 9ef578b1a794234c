"""Oracles: templates, patterns, IOCs, incidents, anomalies, cascades, maintenance."""

from __future__ import annotations

from netsilt import rules
from oracles.base import CLASSIFIED, LOGS, case_of, q, rounded, with_ctes
from oracles.classification import distinct_list

SQL: dict[str, str] = {}


def short_id(prefix: str, key: str) -> str:
    return f"'{prefix}-' || upper(md5({key}))"


def list_case(expr: str, mapping: dict, default: list) -> str:
    lit = lambda v: "[" + ", ".join(q(x) for x in v) + "]"
    arms = " ".join(f"WHEN {q(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {expr} {arms} ELSE {lit(default)} END"


def text_of(items: str) -> str:
    return f"array_to_string({items}, '|')"


# ---------------------------------------------------------------- templates and patterns

TEMPLATE = (
    f"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(description, "
    f"{q(rules.IPV4)}, '<IP>', 'g'), {q(rules.TEMPLATE_HEX)}, '<HEX>', 'gi'), "
    f"{q(rules.TEMPLATE_INTERFACE)}, '<IFACE>', 'gi'), {q(rules.TEMPLATE_NUMBER)}, '<NUM>', 'g'), '\\s+', ' ', 'g')))")
SQL["template_tokens"] = with_ctes(LOGS, select=f"SELECT log_id, {TEMPLATE} AS template FROM logs")

_ORDER = {s: i for i, s in enumerate(rules.WORST_SEVERITY_ORDER)}
PATTERNS = f"""
templated AS (
  SELECT *, {TEMPLATE} AS template, {case_of('severity', _ORDER, '0')} AS sev_rank,
    {case_of('upper(severity)', rules.IMPACT_WEIGHT, '0.2::DOUBLE')} AS weight FROM classified
),
top_category AS (
  SELECT template, category FROM (
    SELECT template, category, row_number() OVER (PARTITION BY template ORDER BY count(*) DESC, min(us)) AS rn
    FROM templated GROUP BY template, category) WHERE rn = 1
),
patterns AS (
  SELECT {short_id('PAT', 't.template')} AS pattern_id, substr(t.template, 1, 150) AS description,
    count(*) AS frequency, count(DISTINCT source) AS source_count,
    list_sort(list(DISTINCT t.category)) AS category_list,
    min(ts) AS first_seen, max(ts) AS last_seen,
    arg_max(severity, sev_rank * 1e18 - us) AS severity, true AS is_recurring,
    {rounded('sum(round(weight * 1000)::BIGINT) / count(*) / 1000.0::DOUBLE', 3)} AS impact_score,
    {case_of('any_value(c.category)', rules.PATTERN_ACTION, q(rules.DEFAULT_PATTERN_ACTION))} AS recommended_action,
    t.template
  FROM templated t JOIN top_category c ON t.template = c.template
  GROUP BY t.template HAVING count(*) >= {rules.MIN_PATTERN_FREQUENCY}
)"""
SQL["recurring_patterns"] = with_ctes(LOGS, CLASSIFIED, PATTERNS, select=f"""
SELECT pattern_id, description, frequency, source_count, {text_of('category_list')} AS categories, first_seen, last_seen,
  severity, is_recurring, impact_score, recommended_action FROM patterns""")
SQL["pattern_sources"] = with_ctes(LOGS, CLASSIFIED, PATTERNS, select="""
SELECT DISTINCT p.pattern_id, t.source FROM templated t JOIN patterns p ON t.template = p.template""")


# ---------------------------------------------------------------- IOCs

def ioc_lists(text: str) -> dict[str, str]:
    ports = f"list_filter(list_transform(regexp_extract_all({text}, {q(rules.PORT)}, 1), lambda p: p::INTEGER), lambda p: p <= 65535)"
    return {
        "ips": distinct_list(f"regexp_extract_all({text}, {q(rules.IPV4)})"),
        "ports": distinct_list(ports),
        "domains": distinct_list(f"regexp_extract_all({text}, {q(rules.DOMAIN)}, 0, 'i')"),
        "hashes": distinct_list(f"regexp_extract_all({text}, {q(rules.FILE_HASH)}, 0, 'i')"),
    }


def _ioc_query(table: str, key: str, text: str, *ctes: str) -> str:
    cols = ", ".join(f"{text_of(v)} AS {k}" for k, v in ioc_lists(text).items())
    sql = f"SELECT {key}, {cols} FROM {table}"
    return with_ctes(*ctes, select=sql) if ctes else sql


SQL["ioc_logs"] = _ioc_query("texts", "log_id", "txt", LOGS,
                             "texts AS (SELECT log_id, description || ' ' || raw_message AS txt FROM logs)")
SQL["ioc_documents"] = _ioc_query("documents", "doc_id", "text")
SQL["ioc_pages"] = _ioc_query("pages", "page_id", "html")


# ---------------------------------------------------------------- incidents

def severity_of(score: str) -> str:
    return ("CASE " + " ".join(f"WHEN {score} >= {b}::DOUBLE THEN {q(n)}" for n, b in rules.INCIDENT_SEVERITY)
            + " ELSE 'LOW' END")


def actions_of(threat: str, severity: str, ips: str) -> str:
    ip_list = f"coalesce(nullif(array_to_string(list_slice({ips}, 1, 3), ', '), ''), 'unknown source')"
    steps = (f"list_transform({list_case(threat, rules.INCIDENT_ACTIONS, rules.DEFAULT_INCIDENT_ACTIONS)}, "
             f"lambda s: replace(s, '%s', {ip_list}))")
    return (f"CASE WHEN {severity} = 'CRITICAL' THEN list_concat([{q(rules.CRITICAL_INCIDENT_ACTION)}], {steps}) "
            f"ELSE {steps} END")


_I = ioc_lists("txt")
THREATS = f"""
threat_logs AS (
  SELECT *, {_I['ips']} AS ips, {_I['ports']} AS ports, {_I['domains']} AS domains, {_I['hashes']} AS hashes
  FROM classified WHERE security_threat AND threat_score >= 0.30::DOUBLE
),
keyed AS (SELECT *, coalesce(ips[1], source) AS origin FROM threat_logs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY threat_type, origin ORDER BY us, log_id) AS nth FROM keyed),
grouped AS (
  SELECT threat_type, origin, count(*) AS event_count, max(ts) AS last_seen,
    {rounded('least(max(threat_score) + 0.05::DOUBLE * (count(*) - 1), 1.0::DOUBLE)', 3)} AS score
  FROM ranked GROUP BY threat_type, origin
),
addresses AS (
  SELECT threat_type, origin, ip, min(seen) AS seen FROM (
    SELECT threat_type, origin, unnest(ips) AS ip, {{'us': us, 'id': log_id, 'p': unnest(range(len(ips)))}} AS seen
    FROM keyed) GROUP BY threat_type, origin, ip
),
address_lists AS (SELECT threat_type, origin, list(ip ORDER BY seen, ip) AS all_ips FROM addresses GROUP BY ALL),
threats AS (
  SELECT {short_id('THR', 'f.log_id')} AS threat_id, g.threat_type, g.origin, {severity_of('g.score')} AS severity, g.score,
    coalesce(list_slice(all_ips, 1, 10), []) AS source_ip_list,
    CASE WHEN f.source_ip = '' THEN [] ELSE [f.source_ip] END AS target_ip_list,
    list_slice(f.ports, 1, 10) AS target_port_list, f.source AS device, f.ts AS first_seen, g.last_seen, g.event_count,
    substr(f.description, 1, 300) AS description,
    list_slice(list_concat(coalesce(list_slice(all_ips, 1, 20), []), f.domains), 1, 20) AS ioc_list,
    {list_case('g.threat_type', rules.MITRE_TACTICS, rules.DEFAULT_MITRE)} AS tactics,
    {actions_of('g.threat_type', severity_of('f.threat_score'), 'f.ips')} AS actions
  FROM grouped g JOIN ranked f ON f.nth = 1 AND f.threat_type = g.threat_type AND f.origin = g.origin
  LEFT JOIN address_lists a ON a.threat_type = g.threat_type AND a.origin = g.origin
)"""
_INCIDENT_COLUMNS = f"""threat_id, threat_type, severity, score, {text_of('source_ip_list')} AS source_ips,
  {text_of('target_ip_list')} AS target_ips, {text_of('target_port_list')} AS target_ports, device AS affected_devices,
  {text_of('ioc_list')} AS iocs, {text_of('tactics')} AS mitre_tactics, {text_of('actions')} AS recommended_actions,
  first_seen, last_seen, event_count, description, true AS is_active"""
SQL["security_incidents"] = with_ctes(LOGS, CLASSIFIED, THREATS, select=f"SELECT {_INCIDENT_COLUMNS} FROM threats")
SQL["threat_assessments"] = with_ctes(LOGS, CLASSIFIED, THREATS, select=f"""
SELECT {short_id('THR', 'log_id')} AS threat_id, threat_type, {severity_of('threat_score')} AS severity,
  threat_score AS score, {text_of('list_slice(ips, 1, 5)')} AS source_ips, source_ip AS target_ips,
  {text_of('list_slice(ports, 1, 10)')} AS target_ports, source AS affected_devices,
  {text_of('list_concat(list_concat(ips, domains), hashes)')} AS iocs,
  {text_of(list_case('threat_type', rules.MITRE_TACTICS, rules.DEFAULT_MITRE))} AS mitre_tactics,
  {text_of(actions_of('threat_type', severity_of('threat_score'), 'ips'))} AS recommended_actions,
  ts AS first_seen, ts AS last_seen, 1::BIGINT AS event_count, substr(description, 1, 300) AS description,
  true AS is_active FROM threat_logs""")
SQL["incident_logs"] = with_ctes(LOGS, CLASSIFIED, THREATS, select=f"""
SELECT {short_id('THR', 'f.log_id')} AS threat_id, k.log_id FROM keyed k
JOIN ranked f ON f.nth = 1 AND f.threat_type = k.threat_type AND f.origin = k.origin""")
THREAT_SUMMARY = """
summary AS (
  SELECT 'total' AS kind, '' AS key, count(*) AS count FROM threats
  UNION ALL SELECT 'active', '', count(*) FROM threats
  UNION ALL SELECT 'type', threat_type, count(*) FROM threats GROUP BY threat_type
  UNION ALL SELECT 'severity', s, count(t.severity)
    FROM (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS s) LEFT JOIN threats t ON t.severity = s GROUP BY s
)"""
SQL["threat_summary"] = with_ctes(LOGS, CLASSIFIED, THREATS, THREAT_SUMMARY, select="SELECT kind, key, count FROM summary")
SQL["top_source_ips"] = with_ctes(LOGS, CLASSIFIED, THREATS, select="""
SELECT ip, count(*) AS count FROM (SELECT unnest(source_ip_list) AS ip FROM threats) GROUP BY ip
ORDER BY count DESC, ip LIMIT 10""")


# ---------------------------------------------------------------- anomalies

SAMPLES = """
samples AS (
  SELECT log_id, us, source, 'cpu_usage' AS metric, 0 AS pos, cpu AS value FROM logs WHERE cpu IS NOT NULL
  UNION ALL SELECT log_id, us, source, 'memory_usage', 1, mem FROM logs WHERE mem IS NOT NULL
  UNION ALL SELECT log_id, us, source, 'interface_errors', 2, err FROM logs WHERE err IS NOT NULL
)"""
ZSCORES = f"""{SAMPLES},
rolled AS (
  SELECT *, count(*) OVER w AS samples, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS std FROM samples
  WINDOW w AS (PARTITION BY source, metric ORDER BY us, log_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)
),
zscores AS (
  SELECT *, CASE WHEN samples < 10 OR std < 1e-6 THEN 0.0::DOUBLE ELSE abs((value - mean) / std) END AS z_score FROM rolled
)"""
SQL["rolling_zscore"] = with_ctes(LOGS, ZSCORES, select="""
SELECT log_id, source, metric, value, samples, round(mean, 9) AS mean, round(std, 9) AS std, round(z_score, 9) AS z_score
FROM zscores""")
SQL["seeded_zscore"] = with_ctes(LOGS, ZSCORES.replace("ORDER BY us, log_id", "ORDER BY us < epoch_us(TIMESTAMP '2024-01-16'), us, log_id"), select="""
SELECT log_id, source, metric, value, samples, round(mean, 9) AS mean, round(std, 9) AS std, round(z_score, 9) AS z_score
FROM zscores WHERE us < epoch_us(TIMESTAMP '2024-01-16')""")
SQL["baseline_table"] = with_ctes(LOGS, SAMPLES, select="""
SELECT source, metric, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS std, count(*) AS samples FROM (
  SELECT *, row_number() OVER (PARTITION BY source, metric ORDER BY us DESC, log_id DESC) AS rn FROM samples)
WHERE rn <= 100 GROUP BY source, metric""")
DEVIATION = f"""{ZSCORES},
deviation AS (
  SELECT log_id, max(z_score) AS max_z,
    coalesce(list(format('{{}} z-score={{:.1f}}σ (value={{:.1f}})', metric, z_score, value) ORDER BY pos)
      FILTER (WHERE z_score > 2.5), []) AS factors
  FROM zscores GROUP BY log_id
)"""
SQL["log_deviation"] = with_ctes(LOGS, DEVIATION, select=f"""
SELECT log_id, round(max_z, 9) AS max_z, {text_of('factors')} AS metric_factors FROM deviation""")

W = 12 * 3600 * 1_000_000
BURSTS = f"""
counted AS (
  SELECT log_id, source,
    count(*) OVER (PARTITION BY source ORDER BY us RANGE BETWEEN {W - 1}::BIGINT PRECEDING AND CURRENT ROW) AS n1,
    count(*) OVER (PARTITION BY source ORDER BY us RANGE BETWEEN {6 * W - 1}::BIGINT PRECEDING AND CURRENT ROW) AS n6
  FROM logs
),
based AS (SELECT *, greatest((n6 - n1) / 5.0::DOUBLE, 1.0::DOUBLE) AS baseline FROM counted),
bursts AS (
  SELECT log_id, source, n1 AS current_count, baseline,
    {rounded('CASE WHEN n6 >= 5 THEN n1 / baseline ELSE 1.0::DOUBLE END', 2)} AS burst_ratio,
    n6 >= 5 AND n1 / baseline >= 3.0::DOUBLE AS is_burst FROM based
)"""
SQL["burst_ratio"] = with_ctes(LOGS, BURSTS, select="SELECT log_id, source, current_count, baseline, burst_ratio, is_burst FROM bursts")
SQL["rate_in_window"] = with_ctes(LOGS, select=f"""
SELECT log_id, source, round(count(*) OVER (PARTITION BY source ORDER BY us
  RANGE BETWEEN {W - 1}::BIGINT PRECEDING AND CURRENT ROW) / 720.0::DOUBLE, 9) AS rate_per_minute FROM logs""")
SQL["rate_by_category"] = with_ctes(LOGS, CLASSIFIED, select=f"""
SELECT log_id, source || ':' || category AS device_category,
  round(count(*) OVER (PARTITION BY source, category ORDER BY us
  RANGE BETWEEN {W - 1}::BIGINT PRECEDING AND CURRENT ROW) / 720.0::DOUBLE, 9) AS rate_per_minute FROM classified""")

_BOOST = "CASE WHEN category IN ('SECURITY', 'IDS') THEN CASE upper(severity) WHEN 'CRITICAL' THEN 0.30::DOUBLE WHEN 'ERROR' THEN 0.15::DOUBLE WHEN 'WARNING' THEN 0.05::DOUBLE END END"
ANOMALIES = f"""{DEVIATION},{BURSTS},
parts_of AS (
  SELECT c.log_id, c.ts, c.source, c.category, c.severity, coalesce(d.max_z, 0) AS max_z, coalesce(d.factors, []) AS factors,
    b.burst_ratio, b.is_burst, {_BOOST} AS boost
  FROM classified c LEFT JOIN deviation d USING (log_id) LEFT JOIN bursts b USING (log_id)
),
scored AS (
  SELECT *, (0.0::DOUBLE + CASE WHEN max_z > 0 THEN least(max_z / 5.0::DOUBLE, 1.0::DOUBLE) ELSE 0 END
      + CASE WHEN is_burst THEN least(burst_ratio / 10.0::DOUBLE, 1.0::DOUBLE) ELSE 0 END + coalesce(boost, 0))
    / (1 + (max_z > 0)::INTEGER + is_burst::INTEGER + (boost IS NOT NULL)::INTEGER) AS raw_score FROM parts_of
),
anomalies AS (
  SELECT *, {rounded('raw_score', 3)} AS anomaly_score, raw_score >= 0.25::DOUBLE AS is_anomaly,
    CASE WHEN raw_score < 0.25::DOUBLE THEN 'none' WHEN max_z > 2.5 THEN 'metric' WHEN is_burst THEN 'frequency'
         ELSE 'pattern' END AS anomaly_type,
    raw_score >= 0.25::DOUBLE AND severity IN ('INFO', 'WARNING') AND raw_score > 0.80::DOUBLE AS severity_upgrade,
    list_concat(list_concat(factors,
      CASE WHEN is_burst THEN [format('Log burst: {{:.1f}}x normal rate', burst_ratio)] ELSE [] END),
      CASE WHEN boost IS NOT NULL THEN [format('Security category severity boost (+{{:.0f}}%)', boost * 100)] ELSE [] END) AS all_factors
  FROM scored
)"""
SQL["anomaly_scores"] = with_ctes(LOGS, CLASSIFIED, ANOMALIES, select=f"""
SELECT log_id, ts AS "timestamp", source, anomaly_score, is_anomaly, anomaly_type, {text_of('all_factors')} AS contributing_factors,
  {rounded('max_z', 2)} AS baseline_deviation, severity_upgrade FROM anomalies""")
SQL["enriched_logs"] = with_ctes(LOGS, CLASSIFIED, ANOMALIES, select="""
SELECT log_id, c.source, c.category, c.severity, a.is_anomaly, a.anomaly_score, c.security_threat
FROM classified c JOIN anomalies a USING (log_id)""")
TOP_DEVICES = f"""
top_devices AS (
  SELECT source AS device, count(*) AS anomaly_count, {rounded('sum(round(anomaly_score * 1000)::BIGINT) / count(*) / 1000.0::DOUBLE', 3)} AS avg_score
  FROM anomalies WHERE is_anomaly GROUP BY source ORDER BY avg_score DESC, device LIMIT 10
)"""
SQL["top_anomalous_devices"] = with_ctes(LOGS, CLASSIFIED, ANOMALIES, TOP_DEVICES, select="SELECT * FROM top_devices")


# ---------------------------------------------------------------- cascades

_RULES = ", ".join(f"({q(c)}, {q(e)}, {q(h)}, {p}::DOUBLE)" for c, e, h, p in rules.CASCADE_RULES)
CASCADES = f"""
cascade_rules(cause, effect, hypothesis, confidence) AS (VALUES {_RULES}),
edges AS (
  SELECT {short_id('CORR', "r.log_id || '|' || k.effect")} AS correlation_id, r.log_id AS root_event_id, r.source AS root_source,
    k.effect AS effect_category, e.log_id AS effect_event_id, e.source AS effect_source, e.us AS effect_us,
    k.hypothesis, k.confidence
  FROM classified r JOIN cascade_rules k ON r.category = k.cause
  JOIN classified e ON e.category = k.effect AND e.us >= r.us AND e.us <= r.us + 3600000000
    AND (e.us > r.us OR e.log_id > r.log_id)
)"""
SQL["cascade_correlations"] = with_ctes(LOGS, CLASSIFIED, CASCADES, select="""
SELECT correlation_id, root_event_id, root_source, effect_category, count(*) AS related_count,
  arg_min(effect_event_id, effect_us) AS first_effect_id, arg_max(effect_event_id, effect_us) AS last_effect_id,
  hypothesis AS root_cause_hypothesis, confidence, 3600.0::DOUBLE AS time_window_seconds
FROM edges GROUP BY ALL""")
SQL["cascade_edges"] = with_ctes(LOGS, CLASSIFIED, CASCADES, select="""
SELECT correlation_id, root_event_id, root_source, effect_event_id, effect_source,
  row_number() OVER (PARTITION BY correlation_id ORDER BY effect_us, effect_event_id) AS position FROM edges""")
SQL["cascade_sources"] = with_ctes(LOGS, CLASSIFIED, CASCADES, select="""
SELECT correlation_id, root_source AS source FROM edges UNION SELECT correlation_id, effect_source FROM edges""")


# ---------------------------------------------------------------- maintenance

DEVICES = f"""
device_samples AS (
  SELECT source AS device, us, log_id, 'cpu' AS signal, cpu AS v FROM logs WHERE cpu IS NOT NULL
  UNION ALL SELECT source, us, log_id, 'mem', mem FROM logs WHERE mem IS NOT NULL
  UNION ALL SELECT source, us, log_id, 'err', err FROM logs WHERE err IS NOT NULL
  UNION ALL SELECT source, us, log_id, 'sev', {case_of('upper(severity)', rules.DEVICE_SEVERITY_RANK, '1.0::DOUBLE')} FROM logs
  UNION ALL SELECT source, us, log_id, 'cnt', coalesce(err, 0) FROM logs
),
latest AS (
  SELECT *, row_number() OVER (PARTITION BY device, signal ORDER BY us, log_id) AS i FROM (
    SELECT *, row_number() OVER (PARTITION BY device, signal ORDER BY us DESC, log_id DESC) AS rn FROM device_samples)
  WHERE rn <= 50
),
stats AS (
  SELECT device, signal, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std,
    CASE WHEN count(*) > 2 THEN regr_slope(v, i) ELSE 0 END AS trend, arg_max(v, i) AS last
  FROM latest GROUP BY device, signal
),
features AS (
  SELECT device,
    coalesce(max(mean) FILTER (signal = 'cpu'), 0) / 100.0::DOUBLE AS cpu_mean,
    coalesce(max(std) FILTER (signal = 'cpu'), 0) / 100.0::DOUBLE AS cpu_std,
    coalesce(max(trend) FILTER (signal = 'cpu'), 0) / 10.0::DOUBLE AS cpu_trend,
    coalesce(max(last) FILTER (signal = 'cpu'), 0) / 100.0::DOUBLE AS cpu_last,
    coalesce(max(mean) FILTER (signal = 'mem'), 0) / 100.0::DOUBLE AS mem_mean,
    coalesce(max(std) FILTER (signal = 'mem'), 0) / 100.0::DOUBLE AS mem_std,
    coalesce(max(trend) FILTER (signal = 'mem'), 0) / 10.0::DOUBLE AS mem_trend,
    coalesce(max(last) FILTER (signal = 'mem'), 0) / 100.0::DOUBLE AS mem_last,
    coalesce(max(mean) FILTER (signal = 'err'), 0) / 100.0::DOUBLE AS err_mean,
    coalesce(max(std) FILTER (signal = 'err'), 0) / 100.0::DOUBLE AS err_std,
    coalesce(max(trend) FILTER (signal = 'err'), 0) / 10.0::DOUBLE AS err_trend,
    coalesce(max(last) FILTER (signal = 'err'), 0) / 100.0::DOUBLE AS err_last,
    coalesce(max(mean) FILTER (signal = 'sev'), 0) / 7.0::DOUBLE AS sev_mean,
    coalesce(max(trend) FILTER (signal = 'sev'), 0) / 2.0::DOUBLE AS sev_trend,
    coalesce(max(last) FILTER (signal = 'sev'), 0) / 7.0::DOUBLE AS sev_last,
    coalesce(max(mean) FILTER (signal = 'cnt'), 0) / 20.0::DOUBLE AS cnt_mean,
    coalesce(max(trend) FILTER (signal = 'cnt'), 0) / 5.0::DOUBLE AS cnt_trend
  FROM stats GROUP BY device HAVING max(n) FILTER (signal = 'cpu') >= 5
)"""
_FEATURE_NAMES = ("cpu_mean cpu_std cpu_trend cpu_last mem_mean mem_std mem_trend mem_last err_mean err_std err_trend "
                  "err_last sev_mean sev_trend sev_last cnt_mean cnt_trend").split()
SQL["device_features"] = with_ctes(LOGS, DEVICES, select="SELECT device, " + ", ".join(
    f"round({n}, 9) AS {n}" for n in _FEATURE_NAMES) + " FROM features")

_RISK = "CASE WHEN p >= 0.85::DOUBLE THEN 'CRITICAL' WHEN p >= 0.65::DOUBLE THEN 'HIGH' WHEN p >= 0.40::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END"
ALERTS = f"""{DEVICES},
probable AS (
  SELECT *, greatest(0, least(1, cpu_last * 0.3::DOUBLE + mem_last * 0.3::DOUBLE
    + least(abs(err_trend), 1) * 0.2::DOUBLE + sev_last * 0.2::DOUBLE)) AS p FROM features
),
typed AS (
  SELECT *, {_RISK} AS risk_level,
    CASE WHEN abs(err_trend) > 0.05::DOUBLE THEN 'interface_down'
         WHEN cpu_last > 0.80::DOUBLE OR mem_last > 0.85::DOUBLE THEN 'hardware_failure'
         ELSE 'routing_instability' END AS failure
  FROM probable WHERE p >= 0.3::DOUBLE
),
alerts AS (
  SELECT {short_id('MAINT', "device || '|' || failure")} AS alert_id, device, {rounded('p', 3)} AS failure_probability,
    failure AS predicted_failure_type, 24::INTEGER AS time_horizon_hours, {rounded('p', 3)} AS confidence, risk_level,
    list_filter([
      CASE WHEN cpu_last > 0.75::DOUBLE THEN format('CPU at {{:.0f}}% (mean {{:.0f}}%)', cpu_last * 100, cpu_mean * 100) END,
      CASE WHEN cpu_trend > 0.02::DOUBLE THEN format('CPU increasing at +{{:.1f}}%/sample', cpu_trend * 100) END,
      CASE WHEN mem_last > 0.80::DOUBLE THEN format('Memory at {{:.0f}}% (mean {{:.0f}}%)', mem_last * 100, mem_mean * 100) END,
      CASE WHEN err_last > 0.05::DOUBLE THEN format('Interface errors at {{:.0f}}/sample', err_last * 100) END,
      CASE WHEN err_trend > 0.01::DOUBLE THEN format('Error count trending up (+{{:.1f}}/sample)', err_trend * 100) END
    ], lambda x: x IS NOT NULL) AS signals,
    list_concat(CASE risk_level WHEN 'CRITICAL' THEN [{q(rules.CRITICAL_MAINTENANCE_ACTION)}]
                                WHEN 'HIGH' THEN [{q(rules.HIGH_MAINTENANCE_ACTION)}] ELSE [] END,
      {list_case('failure', rules.MAINTENANCE_ACTIONS, [])}) AS actions,
    CASE risk_level WHEN 'CRITICAL' THEN 'Within 4 hours (by 2024-02-01 04:00 UTC)'
                    WHEN 'HIGH' THEN 'Next maintenance window: 2024-02-02 02:00-04:00 UTC'
                    ELSE 'Routine maintenance before 2024-02-08 UTC' END AS maintenance_window,
    TIMESTAMP '2024-02-01' AS created_at
  FROM typed
)"""
SQL["maintenance_alerts"] = with_ctes(LOGS, ALERTS, select=f"""
SELECT alert_id, device, failure_probability, predicted_failure_type, time_horizon_hours, confidence, risk_level,
  CASE WHEN len(signals) = 0 THEN {q(rules.DEFAULT_SIGNAL)} ELSE {text_of('signals')} END AS contributing_signals,
  {text_of('actions')} AS recommended_actions, maintenance_window, created_at FROM alerts""")
SQL["incident_addresses"] = with_ctes(LOGS, CLASSIFIED, THREATS, select=f"""
SELECT {short_id('THR', 'f.log_id')} AS threat_id, a.ip FROM addresses a
JOIN ranked f ON f.nth = 1 AND f.threat_type = a.threat_type AND f.origin = a.origin""")
SQL["threat_view"] = with_ctes(LOGS, CLASSIFIED, THREATS, THREAT_SUMMARY, select="""
SELECT kind, key, count FROM summary UNION ALL SELECT 'listed', '', count(*) FROM threats""")
