"""Device health features and failure alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsilt import rules
from netsilt.functions.columns import bucket, clip, fixed, list_lookup, metric, rounded, string_array, surrogate_id
from netsilt.operators.classify import severity_rank

FEATURES = rules.DEVICE_FEATURES
FEATURE_NAMES = [f[0] for f in FEATURES]
METRIC_SIGNALS = ["cpu_usage", "memory_usage", "interface_errors"]


def device_samples(classified: DataFrame) -> DataFrame:
    """(device, timestamp, log_id, signal, value): the health signals of every log that has a time."""
    errors = F.coalesce(metric("interface_errors"), F.lit(0.0))
    rank = severity_rank(rules.DEVICE_SEVERITY_RANK).cast("double")
    signals = [F.struct(F.lit(s).alias("signal"), metric(s).alias("value")) for s in METRIC_SIGNALS]
    signals += [F.struct(F.lit("severity_num").alias("signal"), rank.alias("value")),
                F.struct(F.lit("error_count").alias("signal"), errors.alias("value"))]
    return classified.filter(F.col("timestamp").isNotNull()).select(
        F.col("source").alias("device"), "timestamp", "log_id", F.inline(F.array(*signals)),
    ).filter(F.col("value").isNotNull())


def latest_samples(samples: DataFrame, n: int = rules.DEVICE_WINDOW) -> DataFrame:
    """The last ``n`` samples per device and signal, ``age`` 1 = newest.

    The rank filter also runs before the shuffle (window group limit): a map task
    sends at most ``n`` rows per device and signal.
    """
    newest = Window.partitionBy("device", "signal").orderBy(F.desc("timestamp"), F.desc("log_id"))
    return samples.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= n)


def device_features(classified: DataFrame, window_size: int = rules.DEVICE_WINDOW) -> DataFrame:
    """device plus the 17 health features; devices with too few CPU samples are left out."""
    return features_of(latest_samples(device_samples(classified), window_size))


def features_of(latest: DataFrame) -> DataFrame:
    """Features from (device, signal, age, value) rows, ``age`` 1 = newest.

    A mean is summed in time order, oldest first, so one near a rounding border does not depend on the
    order in which rows are met.
    """
    index = -F.col("age")  # rises with time; the slope does not depend on the origin
    in_time = F.transform(F.array_sort(F.collect_list(F.struct(index.alias("i"), "value"))), lambda s: s["value"])
    stats = latest.groupBy("device", "signal").agg(
        F.count("*").alias("n"),
        in_time.alias("_values"),
        F.stddev_pop("value").alias("std"),
        F.regr_slope(F.col("value"), index.cast("double")).alias("slope"),
        F.min_by("value", "age").alias("last"),
    ).withColumns({
        "mean": F.aggregate("_values", F.lit(0.0), lambda total, v: total + v) / F.col("n"),
        "trend": F.when(F.col("n") > 2, F.col("slope")).otherwise(F.lit(0.0))})
    cells = []
    for name, signal, statistic, divisor in FEATURES:
        value = F.max(F.when(F.col("signal") == signal, F.col(statistic)))
        cells.append((F.coalesce(value, F.lit(0.0)) / F.lit(divisor)).alias(name))
    cpu_samples = F.max(F.when(F.col("signal") == "cpu_usage", F.col("n"))).alias("_n")
    return stats.groupBy("device").agg(cpu_samples, *cells).filter(
        F.col("_n") >= rules.DEVICE_MIN_SAMPLES).drop("_n")


def heuristic_score() -> Column:
    return clip(
        F.col("cpu_last") * 0.3 + F.col("mem_last") * 0.3
        + F.least(F.abs("err_trend"), F.lit(1.0)) * 0.2 + F.col("sev_last") * 0.2)


def risk_level(probability: str | Column) -> Column:
    return bucket(probability, rules.RISK_LEVELS, rules.LOWEST_RISK)


def failure_type() -> Column:
    return (
        F.when(F.abs("err_trend") > 0.05, "interface_down")
        .when((F.col("cpu_last") > 0.80) | (F.col("mem_last") > 0.85), "hardware_failure")
        .otherwise("routing_instability")
    )


def contributing_signals() -> Column:
    pct = lambda name, digits=0: fixed(F.col(name) * 100, digits)
    texts = [
        F.when(F.col(feature) > limit, F.format_string(text, *[pct(name, digits) for name, digits in shown]))
        for feature, limit, text, shown in rules.DEVICE_SIGNALS
    ]
    found = F.array_compact(F.array(*texts))
    return F.when(F.size(found) == 0, string_array([rules.DEFAULT_SIGNAL])).otherwise(found)


def maintenance_actions(failure: Column, risk: Column) -> Column:
    steps = list_lookup(rules.MAINTENANCE_ACTIONS, failure, rules.DEFAULT_MAINTENANCE_ACTIONS)
    return (
        F.when(risk == "CRITICAL", F.concat(string_array([rules.CRITICAL_MAINTENANCE_ACTION]), steps))
        .when(risk == "HIGH", F.concat(string_array([rules.HIGH_MAINTENANCE_ACTION]), steps))
        .otherwise(steps)
    )


def maintenance_window(risk: Column, as_of: Column) -> Column:
    within = F.date_format(as_of + F.expr("INTERVAL 4 HOURS"), "yyyy-MM-dd HH:mm")
    next_day = F.date_format(as_of + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd")
    next_week = F.date_format(as_of + F.expr("INTERVAL 7 DAYS"), "yyyy-MM-dd")
    return (
        F.when(risk == "CRITICAL", F.format_string(rules.CRITICAL_WINDOW, within))
        .when(risk == "HIGH", F.format_string(rules.HIGH_WINDOW, next_day))
        .otherwise(F.format_string(rules.ROUTINE_WINDOW, next_week))
    )


def maintenance_alerts(features: DataFrame, as_of: datetime | Column, threshold: float = rules.ALERT_THRESHOLD,
                       probabilities: DataFrame | None = None, horizon_hours: int = rules.HORIZON_HOURS) -> DataFrame:
    """Alerts for devices whose failure probability reaches the threshold.

    ``probabilities`` (device, failure_probability) comes from a trained model;
    without it the heuristic score is used. ``as_of`` stands for now.
    """
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    if probabilities is None:
        scored = features.withColumn("_p", heuristic_score())
    else:
        scored = features.join(
            probabilities.select("device", F.col("failure_probability").alias("_p")), "device")
    alerts = scored.filter(F.col("_p") >= threshold).withColumns({
        "risk_level": risk_level("_p"),
        "predicted_failure_type": failure_type(),
    })
    return alerts.select(
        surrogate_id("MAINT", "device", "predicted_failure_type").alias("alert_id"),
        "device",
        rounded("_p", 3).alias("failure_probability"),
        "predicted_failure_type",
        F.lit(horizon_hours).alias("time_horizon_hours"),
        rounded("_p", 3).alias("confidence"),
        "risk_level",
        contributing_signals().alias("contributing_signals"),
        maintenance_actions(F.col("predicted_failure_type"), F.col("risk_level")).alias("recommended_actions"),
        maintenance_window(F.col("risk_level"), as_of).alias("maintenance_window"),
        as_of.alias("created_at"),
    )


def alerts_by_probability(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.desc("failure_probability"), "device")
