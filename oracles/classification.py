"""Oracles: rules, features, components, versions, threats, actions."""

from __future__ import annotations

from netsilt import rules
from oracles.base import CLASSIFIED, LOGS, case_of, has, q, with_ctes

SQL: dict[str, str] = {}

SQL["rule_classify"] = with_ctes(
    LOGS, CLASSIFIED, select="SELECT log_id, category, subcategory, confidence, rule_action AS recommended_action FROM classified")


def _rank(ranks):
    return f"({case_of('upper(severity)', ranks, '1')})::INTEGER"


SQL["severity_rank"] = with_ctes(LOGS, select=f"""
SELECT log_id, severity, {_rank(rules.FEATURE_SEVERITY_RANK)} AS feature_rank,
  {_rank(rules.ANOMALY_SEVERITY_RANK)} AS anomaly_rank, {_rank(rules.DEVICE_SEVERITY_RANK)} AS device_rank FROM logs""")


def _hits(words):
    return "(" + " + ".join(f"contains(low, {q(w)})::INTEGER" for w in words) + ")"


_FEATURES = ",\n".join(
    [f"{_rank(rules.FEATURE_SEVERITY_RANK)} AS severity_num"]
    + [f"{_hits(w)} AS kw_{n.lower()}" for n, w in rules.COMPONENT_KEYWORDS.items()]
    + [f"{_hits(w)} AS sev_{n.lower()}" for n, w in rules.SEVERITY_KEYWORDS.items()]
    + [f"{has(p, 'low')}::INTEGER AS threat_{n}" for n, p in rules.THREAT_PATTERNS]
    + ["coalesce(cpu, 0) / 100.0::DOUBLE AS cpu_usage", "coalesce(mem, 0) / 100.0::DOUBLE AS memory_usage",
       "least(coalesce(err, 0), 100) / 100.0::DOUBLE AS interface_errors",
       "least(length(raw_message), 500) / 500.0::DOUBLE AS msg_length",
       f"{has(rules.IPV4_LOOSE, 'low', 'c')}::INTEGER AS has_ip_address",
       "contains(raw_message, '%')::INTEGER AS has_percent_code",
       f"{has(rules.PORT_PRESENT, 'low', 'c')}::INTEGER AS has_port_number"]
)
SQL["log_features"] = with_ctes(
    LOGS, "texts AS (SELECT *, lower(description || ' ' || raw_message) AS low FROM logs)",
    select=f"SELECT log_id, {_FEATURES} FROM texts")

# distinct values in order of first occurrence
def distinct_list(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


_IF = f"regexp_extract_all(txt, {q(rules.NAMED_INTERFACE)}, 0, 'i')"
_IPS = f"list_slice(regexp_extract_all(txt, {q(rules.IPV4)}), 1, 3)"
_COMPONENTS = "[" + ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(lower(txt), {q(w)})" for w in words) + f" THEN {q(name)} END"
    for name, words in rules.COMPONENT_KEYWORDS.items()) + "]"
COMPONENTS = (f"array_to_string(list_slice(list_concat(list_concat({distinct_list(_IF)}, {distinct_list(_IPS)}), "
              f"list_filter({_COMPONENTS}, lambda x: x IS NOT NULL)), 1, 10), '|')")
SQL["impacted_components"] = with_ctes(
    LOGS, "texts AS (SELECT *, description || ' ' || raw_message AS txt FROM logs)",
    select=f"SELECT log_id, {COMPONENTS} AS impacted_components FROM texts")

VERSION = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(txt, {q(p)}, 0, 'i'), '')" for p in rules.VERSION_PATTERNS) + ", 'Unknown')"
SQL["version_extract"] = with_ctes(
    LOGS, "texts AS (SELECT *, description || ' ' || raw_message AS txt FROM logs)",
    select=f"SELECT log_id, {VERSION} AS version FROM texts")

SQL["threat_detect"] = with_ctes(
    LOGS, CLASSIFIED, select="SELECT log_id, security_threat, threat_type, threat_score FROM classified")

ACTION = (
    f"CASE WHEN threat_type <> '' THEN {case_of('threat_type', rules.THREAT_ACTION, q(rules.DEFAULT_THREAT_ACTION))} "
    f"WHEN category = 'HARDWARE' THEN {case_of('subcategory', rules.HARDWARE_ACTION, q(rules.DEFAULT_HARDWARE_ACTION))} "
    f"ELSE {case_of('category', rules.CATEGORY_ACTION, q(rules.DEFAULT_ACTION))} END")
SQL["recommended_action"] = with_ctes(
    LOGS, CLASSIFIED, select=f"SELECT log_id, category, subcategory, {ACTION} AS recommended_action FROM classified")

SQL["classified_logs"] = with_ctes(LOGS, CLASSIFIED, select=f"""
SELECT log_id, ts AS "timestamp", source, source_ip, platform, raw_message, description,
  'cpu_usage=' || trunc(cpu)::BIGINT || CASE WHEN err IS NULL THEN '' ELSE '|interface_errors=' || err::BIGINT END
    || '|memory_usage=' || mem::BIGINT AS metrics,
  category, subcategory, severity, {COMPONENTS} AS impacted_components, {VERSION} AS version,
  round(confidence, 3) AS classification_confidence, 'rule' AS classification_method, false AS is_anomaly,
  0.0::DOUBLE AS anomaly_score, security_threat, threat_type, threat_score, {ACTION} AS recommended_action
FROM classified""")


# ---------------------------------------------------------------- what is exact about the models

SPLIT = """
ranked AS (
  SELECT log_id, category AS label, count(*) OVER (PARTITION BY category) AS size,
    row_number() OVER (PARTITION BY category ORDER BY ('0x' || substr(md5(log_id || '|42'), 1, 8))::BIGINT, log_id) AS rank FROM classified),
split AS (
  SELECT log_id, label, CASE WHEN rank <= floor(size * 0.2::DOUBLE + 0.5) THEN 'test' ELSE 'train' END AS part, ((rank - 1) % 5)::INTEGER AS fold
  FROM ranked)"""
SQL["split_members"] = with_ctes(LOGS, CLASSIFIED, SPLIT, select="SELECT * FROM split")
SQL["classifier_split"] = with_ctes(LOGS, CLASSIFIED, SPLIT, select="""
SELECT label, part, fold, count(*) AS count FROM split GROUP BY ALL""")
SQL["evaluation_report"] = with_ctes(LOGS, CLASSIFIED, """
guesses AS (SELECT category AS actual, CASE WHEN event_id % 7 = 0 THEN 'SECURITY' ELSE category END AS guess FROM classified),
rates AS (
  SELECT c.class, count(*) FILTER (actual = c.class AND guess = c.class)::DOUBLE AS hits,
    count(*) FILTER (actual = c.class) AS support, count(*) FILTER (guess = c.class) AS guessed
  FROM guesses JOIN (SELECT DISTINCT actual AS class FROM guesses) c ON c.class IN (actual, guess) GROUP BY c.class),
ratios AS (
  SELECT *, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0.0::DOUBLE END AS p, hits / support AS r FROM rates)""", select="""
SELECT class, round(p, 9) AS precision, round(r, 9) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END, 9) AS f1, support FROM ratios""")
SQL["prediction_fallback"] = with_ctes(LOGS, CLASSIFIED, select="""
SELECT log_id, CASE WHEN event_id % 3 = 0 THEN 'DNS' ELSE category END AS category, subcategory,
  CASE WHEN event_id % 3 = 0 THEN 0.9::DOUBLE ELSE confidence END AS classification_confidence,
  CASE WHEN event_id % 3 = 0 THEN 'ml' ELSE 'rule' END AS classification_method FROM classified""")
_INPUTS = f"""
inputs AS (
  SELECT log_id, coalesce(cpu, 0) / 100.0::DOUBLE AS cpu_usage, coalesce(mem, 0) / 100.0::DOUBLE AS memory_usage,
    least(coalesce(err, 0), 100) / 100.0::DOUBLE AS interface_errors, {_rank(rules.ANOMALY_SEVERITY_RANK)} / 7.0::DOUBLE AS severity_num,
    CASE WHEN source_ip <> '' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_ip_address FROM logs)"""
SQL["iforest_features"] = with_ctes(LOGS, _INPUTS, select="""
SELECT log_id, round(cpu_usage, 9) AS cpu_usage, round(memory_usage, 9) AS memory_usage, round(interface_errors, 9) AS interface_errors,
  round(severity_num, 9) AS severity_num, has_ip_address FROM inputs""")
# expected path length among four points: 2 (ln 3 + Euler's constant) - 2 * 3 / 4
SQL["iforest_fixed_forest"] = with_ctes(LOGS, _INPUTS, """
paths AS (
  SELECT log_id, (CASE WHEN cpu_usage <= 0.5 THEN 1.5::DOUBLE ELSE 2.5::DOUBLE END
    + CASE WHEN memory_usage <= 0.3 THEN 1.0::DOUBLE WHEN has_ip_address <= 0.5 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END) / 2 AS path
  FROM inputs)""", select="""
SELECT log_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  0.5::DOUBLE + pow(2.0::DOUBLE, -path / (2 * (ln(3.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 1.5::DOUBLE)) - 0.5::DOUBLE)), 9) AS ml_score
FROM paths""")
SQL["forest_cut_off"] = with_ctes(LOGS, _INPUTS, """
paths AS (
  SELECT (CASE WHEN cpu_usage <= 0.5 THEN 1.5::DOUBLE ELSE 2.5::DOUBLE END
    + CASE WHEN memory_usage <= 0.3 THEN 1.0::DOUBLE WHEN has_ip_address <= 0.5 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END) / 2 AS path
  FROM inputs),
vals AS (
  SELECT 'forest' AS kind, -pow(2.0::DOUBLE, -path / (2 * (ln(3.0::DOUBLE) + 0.5772156649015329::DOUBLE) - 1.5::DOUBLE)) AS x FROM paths
  UNION ALL SELECT 'load', cpu FROM logs WHERE cpu IS NOT NULL)""", select="""
SELECT kind, share, round(CASE share WHEN 0.01 THEN quantile_cont(x, 0.01) WHEN 0.05 THEN quantile_cont(x, 0.05)
  WHEN 0.37 THEN quantile_cont(x, 0.37) ELSE quantile_cont(x, 0.5) END, 9) AS cut_off
FROM vals, (SELECT unnest([0.01, 0.05, 0.37, 0.5]::DOUBLE[]) AS share) GROUP BY kind, share""")
