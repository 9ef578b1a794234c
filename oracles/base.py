"""SQL text shared by the oracles: the derived log table and its classification.

Each constant is the body of a WITH list; ``with_ctes`` strings them together.
The SQL is written for DuckDB and independent of the Spark operators; only the
fixed values (word lists, patterns, lookup tables) come from ``netsilt.rules``.
"""

from __future__ import annotations

from netsilt import rules
from netsilt.plans.derived import PLATFORMS, SEVERITIES, TEMPLATES


def q(text: str) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def case_of(expr: str, mapping: dict, otherwise: str) -> str:
    arms = " ".join(f"WHEN {q(k) if isinstance(k, str) else k} THEN {q(v) if isinstance(v, str) else f'{v}::DOUBLE'}"
                    for k, v in mapping.items())
    return f"CASE {expr} {arms} ELSE {otherwise} END"


def _fill(template: str) -> str:
    return q(template).replace("{A}", "' || a || '").replace("{B}", "' || b || '")


def _templates(position: int) -> str:
    arms = "\n    ".join(f"WHEN {i} THEN {_fill(t[position])}" for i, t in enumerate(TEMPLATES))
    return f"CASE event_id % 15 {arms} END"


def has(pattern: str, text: str = "txt", flags: str = "i") -> str:
    return f"regexp_matches({text}, {q(pattern)}, {q(flags)})"


def rounded(expr: str, digits: int) -> str:
    """Rounded by the exact binary value, ties to even: print and read back."""
    return f"format('{{:.{digits}f}}', ({expr})::DOUBLE)::DOUBLE"


LOGS = f"""
parts AS (
  SELECT *, (user_id % 10)::VARCHAR AS a, (event_id % 250)::VARCHAR AS b FROM events
),
logs AS (
  SELECT
    'LOG-' || CASE WHEN length(event_id::VARCHAR) < 8 THEN lpad(event_id::VARCHAR, 8, '0')
                   ELSE event_id::VARCHAR END AS log_id,
    ts, epoch_us(ts) AS us, event_id,
    'dev-' || CASE WHEN length(user_id::VARCHAR) < 3 THEN lpad(user_id::VARCHAR, 3, '0')
                   ELSE user_id::VARCHAR END AS source,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE '10.9.' || (user_id % 250) || '.1' END AS source_ip,
    {case_of('event_id % 4', dict(enumerate(PLATFORMS)), 'NULL')} AS platform,
    {case_of('event_type', SEVERITIES, 'NULL')} AS severity,
    {_templates(0)} AS description,
    {_templates(1)} AS raw_message,
    least(value, 100.0::DOUBLE) AS cpu,
    json_extract_string(props, '$.k')::DOUBLE AS mem,
    CASE WHEN event_id % 4 = 0 THEN NULL
         WHEN user_id % 5 = 0 THEN floor(2 * ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0::DOUBLE))
         ELSE (event_id % 20)::DOUBLE END AS err
  FROM parts
)"""

_RULE_ARMS = " ".join(f"WHEN {has(r[0])} THEN {i}" for i, r in enumerate(rules.CLASSIFICATION_RULES))
_THREAT_ARMS = " ".join(f"WHEN {has(p, 'lower(txt)')} THEN {q(n)}" for n, p in rules.THREAT_PATTERNS)


def _rule_value(position: int, otherwise: str) -> str:
    return case_of("rule", {i: r[position] for i, r in enumerate(rules.CLASSIFICATION_RULES)}, q(otherwise))


CLASSIFIED = f"""
texts AS (SELECT *, description || ' ' || raw_message AS txt FROM logs),
ruled AS (SELECT *, CASE {_RULE_ARMS} END AS rule FROM texts),
named AS (
  SELECT *,
    {_rule_value(1, rules.NO_RULE[0])} AS category,
    {_rule_value(2, rules.NO_RULE[1])} AS subcategory,
    CASE WHEN rule IS NULL THEN 0.50::DOUBLE ELSE 0.85::DOUBLE END AS confidence,
    {_rule_value(3, rules.NO_RULE[2])} AS rule_action
  FROM ruled
),
judged AS (
  SELECT *, CASE WHEN category = 'SECURITY' THEN coalesce(CASE {_THREAT_ARMS} END, '') ELSE '' END AS threat_type
  FROM named
),
classified AS (
  SELECT *, threat_type <> '' AS security_threat,
    CASE WHEN threat_type = '' THEN 0.0::DOUBLE
         ELSE {rounded(f"least({case_of('upper(severity)', rules.THREAT_SCORE, '0.60::DOUBLE')}"
                       "+ CASE WHEN cpu > 80 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE)", 3)}
         END AS threat_score
  FROM judged
)"""


def with_ctes(*bodies: str, select: str) -> str:
    return "WITH " + ",".join(b.strip() for b in bodies) + "\n" + select.strip()
