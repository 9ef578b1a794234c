"""Log classification: rules, features, threats, actions.

All of it is a narrow pass over the log table (no shuffle). The numbers of the
matched rule and threat are computed once per row, whatever is filtered later.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsilt import rules
from netsilt.functions import text as X
from netsilt.functions.columns import clip, computed_once, lookup, metric, numbered, rounded
from netsilt.schema import CLASSIFIED_COLUMNS

FEATURES = (
    ["severity_num"]
    + [f"kw_{name.lower()}" for name in rules.COMPONENT_KEYWORDS]
    + [f"sev_{name.lower()}" for name in rules.SEVERITY_KEYWORDS]
    + [f"threat_{name}" for name, _ in rules.THREAT_PATTERNS]
    + ["cpu_usage", "memory_usage", "interface_errors", "msg_length", "has_ip_address", "has_percent_code",
       "has_port_number"]
)


def severity_rank(ranks: dict[str, int], severity: str | Column = "severity") -> Column:
    severity = F.col(severity) if isinstance(severity, str) else severity
    return lookup(ranks, F.upper(severity), rules.DEFAULT_SEVERITY_RANK)


def with_text(logs: DataFrame) -> DataFrame:
    """Adds ``_text`` (description and raw message) and ``_lower``."""
    return logs.withColumn("_text", X.search_text()).withColumn("_lower", F.lower("_text"))


def feature_columns() -> dict[str, Column]:
    """The 27 numeric features of a log with ``_lower`` (see ``with_text``), by name."""
    flag = lambda c: c.cast("int")
    cols = {"severity_num": severity_rank(rules.FEATURE_SEVERITY_RANK)}
    for name, words in rules.COMPONENT_KEYWORDS.items():
        cols[f"kw_{name.lower()}"] = X.keyword_hits("_lower", words)
    for name, words in rules.SEVERITY_KEYWORDS.items():
        cols[f"sev_{name.lower()}"] = X.keyword_hits("_lower", words)
    for name, pattern in rules.THREAT_PATTERNS:
        cols[f"threat_{name}"] = flag(X.found("_lower", pattern, plain=X.plain_text("_lower", "_lower")))
    zero = F.lit(0.0)
    cols["cpu_usage"] = F.coalesce(metric("cpu_usage"), zero) / 100.0
    cols["memory_usage"] = F.coalesce(metric("memory_usage"), zero) / 100.0
    cols["interface_errors"] = F.least(F.coalesce(metric("interface_errors"), zero), F.lit(100.0)) / 100.0
    raw = F.coalesce("raw_message", F.lit(""))
    cols["msg_length"] = F.least(F.length(raw), F.lit(500)) / F.lit(500.0)
    cols["has_ip_address"] = flag(F.col("_lower").rlike(X.rx(rules.IPV4_LOOSE)))
    cols["has_percent_code"] = flag(raw.contains("%"))
    cols["has_port_number"] = flag(F.col("_lower").rlike(X.rx(rules.PORT_PRESENT)))
    return {name: cols[name] for name in FEATURES}


def log_features(logs: DataFrame) -> DataFrame:
    """log_id plus the 27 numeric features of a log."""
    return with_text(logs).select("log_id", *[c.alias(name) for name, c in feature_columns().items()])


def with_rule(logs: DataFrame) -> DataFrame:
    """Adds rule_category, rule_subcategory, rule_confidence, rule_action from the
    first rule that matches the text (needs ``_text`` and ``_lower``)."""
    table = rules.CLASSIFICATION_RULES
    plain = logs.withColumn("_plain", X.plain_text("_text", "_lower"))
    matched = computed_once(plain, _rule=X.first_match("_text", [r[0] for r in table], plain="_plain"))

    def pick(position: int, default: str) -> Column:
        return numbered([r[position] for r in table], "_rule", default)

    category, subcategory, action = rules.NO_RULE
    return matched.select(
        *logs.columns,
        pick(1, category).alias("rule_category"),
        pick(2, subcategory).alias("rule_subcategory"),
        F.when(F.col("_rule").isNull(), F.lit(rules.NO_RULE_CONFIDENCE))
        .otherwise(F.lit(rules.RULE_CONFIDENCE)).alias("rule_confidence"),
        pick(3, action).alias("rule_action"),
    )


def rule_classify(logs: DataFrame) -> DataFrame:
    """category, subcategory, confidence and action of each log by rules alone."""
    return with_rule(with_text(logs)).select(
        "log_id",
        F.col("rule_category").alias("category"),
        F.col("rule_subcategory").alias("subcategory"),
        F.col("rule_confidence").alias("confidence"),
        F.col("rule_action").alias("recommended_action"),
    )


def with_threat(logs: DataFrame, category: str = "category") -> DataFrame:
    """Adds security_threat, threat_type, threat_score (needs ``_lower``).

    The score depends on severity and CPU load only, so the best threat is the
    first pattern that matches.
    """
    patterns = [p for _, p in rules.THREAT_PATTERNS]
    matched = computed_once(
        logs.withColumn("_plain", X.plain_text("_lower", "_lower")),
        _threat=F.when(F.col(category) == "SECURITY", X.first_match("_lower", patterns, plain="_plain")))
    base = lookup(rules.THREAT_SCORE, F.upper("severity"), rules.DEFAULT_THREAT_SCORE)
    hot = F.coalesce(metric("cpu_usage"), F.lit(0.0)) > rules.THREAT_CPU_LIMIT
    score = F.when(hot, clip(base + rules.THREAT_CPU_BONUS)).otherwise(base)
    names = [name for name, _ in rules.THREAT_PATTERNS]
    return matched.select(
        *logs.columns,
        F.col("_threat").isNotNull().alias("security_threat"),
        numbered(names, "_threat", "").alias("threat_type"),
        F.when(F.col("_threat").isNotNull(), rounded(score, 3)).otherwise(F.lit(0.0)).alias("threat_score"),
    )


def recommended_action(category: Column, subcategory: Column, threat_type: Column) -> Column:
    by_category = (
        F.when(category == "HARDWARE", lookup(rules.HARDWARE_ACTION, subcategory, rules.DEFAULT_HARDWARE_ACTION))
        .otherwise(lookup(rules.CATEGORY_ACTION, category, rules.DEFAULT_ACTION))
    )
    return (
        F.when(threat_type != "", lookup(rules.THREAT_ACTION, threat_type, rules.DEFAULT_THREAT_ACTION))
        .otherwise(by_category)
    )


def classify(logs: DataFrame, predictions: DataFrame | None = None,
             answer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Raw logs to classified logs.

    A trained model's answers come as ``answer`` (``log_classifier.answering``), which adds
    them row by row and so works on streams too, or as a table ``predictions`` (log_id,
    category, confidence, method). Logs without one take the rule's answer. The
    subcategory always comes from the rules.
    """
    ruled = with_rule(with_text(logs))
    if answer is not None:
        judged = answer(ruled).withColumns({
            "category": F.coalesce("_ml_category", "rule_category"),
            "_confidence": F.coalesce("_ml_confidence", "rule_confidence"),
            "_method": F.when(F.col("_ml_category").isNull(), F.lit("rule")).otherwise(F.lit("ml")),
        })
    elif predictions is None:
        judged = ruled.withColumns({
            "category": F.col("rule_category"),
            "_confidence": F.col("rule_confidence"),
            "_method": F.lit("rule"),
        })
    else:
        answers = predictions.select(
            "log_id",
            F.col("category").alias("_ml_category"),
            F.col("confidence").alias("_ml_confidence"),
            F.col("method").alias("_ml_method"),
        )
        joined = ruled.join(answers, "log_id", "left")
        judged = joined.withColumns({
            "category": F.coalesce("_ml_category", "rule_category"),
            "_confidence": F.coalesce("_ml_confidence", "rule_confidence"),
            "_method": F.coalesce("_ml_method", F.lit("rule")),
        })
    threatened = with_threat(judged)
    out = threatened.withColumns({
        "subcategory": F.col("rule_subcategory"),
        "impacted_components": X.impacted_components("_text", "_lower"),
        "version": X.software_version("version", "_text"),
        "classification_confidence": rounded("_confidence", 3),
        "classification_method": F.col("_method"),
        "is_anomaly": F.lit(False),
        "anomaly_score": F.lit(0.0),
        "recommended_action": recommended_action(
            F.col("category"), F.col("rule_subcategory"), F.col("threat_type")),
    })
    return out.select(*CLASSIFIED_COLUMNS)
