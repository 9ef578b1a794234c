"""Anomaly scoring: rolling baselines, bursts, combined score."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsilt import rules
from netsilt.functions.columns import clip, fixed, lookup, mean_of_thousandths, micros, rounded
from netsilt.operators.ordered import SLICE_WIDTH, over_previous_rows


SLICE_REACHES = 4         # a slice of ``window_counts`` is at least so many times what its widest window reaches back
BEFORE_ALL = -(1 << 62)   # places of samples a training run has seen: before every time stamp


def metric_samples(logs: DataFrame) -> DataFrame:
    """(log_id, timestamp, source, metric, position, value): one row per metric of a log
    that has a time."""
    return logs.filter(F.col("timestamp").isNotNull()).select(
        "log_id", "timestamp", "source", F.posexplode("metrics").alias("position", "metric", "value"),
    ).filter(F.col("value").isNotNull())


def rolling_zscore(logs: DataFrame, window_size: int = rules.BASELINE_WINDOW, history: DataFrame | None = None,
                   **slicing) -> DataFrame:
    """Deviation of each sample from the last ``window_size`` samples of its
    device and metric, itself included. ``history``: logs a training run has seen, whose
    samples come before all others, whatever their time."""
    return sample_zscores(metric_samples(logs), window_size, None if history is None else metric_samples(history), **slicing)


def _latest_samples(samples: DataFrame, size: int) -> DataFrame:
    """The last ``size`` samples per device and metric, with ``_n`` from 1 for the last one. The rank filter is
    applied before the shuffle too, so each map task sends at most so many rows per key."""
    latest = Window.partitionBy("source", "metric").orderBy(F.desc("timestamp"), F.desc("log_id"))
    return samples.withColumn("_n", F.row_number().over(latest)).filter(F.col("_n") <= size)


def sample_zscores(samples: DataFrame, window_size: int = rules.BASELINE_WINDOW, history: DataFrame | None = None,
                   **slicing) -> DataFrame:
    value, columns, order = F.col("value"), samples.columns, "timestamp"
    if history is not None:
        order = "_x"
        seeds = _latest_samples(history, window_size).withColumn("_x", F.lit(BEFORE_ALL) - F.col("_n")).drop("_n")
        samples = samples.withColumn("_x", micros("timestamp")).unionByName(seeds)
    rolled = over_previous_rows(
        samples, ["source", "metric"], [order, "log_id"], window_size,
        {"samples": F.count(value), "mean": F.avg(value), "std": F.stddev_pop(value)}, **slicing)
    if history is not None:
        rolled = rolled.filter(F.col("_x") >= BEFORE_ALL).select(*columns, "samples", "mean", "std")
    flat = (F.col("samples") < rules.BASELINE_MIN_SAMPLES) | (F.col("std") < rules.BASELINE_MIN_STD)
    z = F.when(flat, F.lit(0.0)).otherwise(F.abs((value - F.col("mean")) / F.col("std")))
    return rolled.withColumn("z_score", z)


def baseline_table(logs: DataFrame, window_size: int = rules.BASELINE_WINDOW) -> DataFrame:
    """Mean and deviation per device and metric over its latest samples."""
    return (
        _latest_samples(metric_samples(logs), window_size).groupBy("source", "metric")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("samples"))
    )


def log_deviation(logs: DataFrame, **kw) -> DataFrame:
    """Per log: largest z-score over its metrics, and one text per metric above the limit."""
    z = rolling_zscore(logs, **kw)
    factor = F.concat("metric", F.lit(" z-score="), fixed("z_score", 1), F.lit("σ (value="), fixed("value", 1), F.lit(")"))
    over = F.when(F.col("z_score") > rules.Z_SCORE_LIMIT, F.struct("position", factor.alias("text")))
    return z.groupBy("log_id").agg(
        F.max("z_score").alias("max_z"),
        F.array_sort(F.collect_list(over)).alias("_factors"),
    ).select("log_id", "max_z", F.col("_factors.text").alias("metric_factors"))


def window_counts(logs: DataFrame, key: str = "source", window: timedelta | None = None, spans: tuple[int, ...] = (1,),
                  more: tuple[str, ...] = (), slice_width: int = SLICE_WIDTH) -> DataFrame:
    """Per log: how many logs of its key lie in (t - n * window, t], for each n in ``spans``. ``more`` columns are kept.

    A key is cut into slices of time; a log that windows of the next slice reach back to goes there too, as
    context. A log's number in its slice less the logs up to the start of its window is the count: both
    frames only grow (a sliding frame's work grows with frame length times rows).
    """
    width = int((window or timedelta(minutes=rules.BURST_WINDOW_MINUTES)) / timedelta(microseconds=1))
    reach = max(spans) * width
    slice_width = max(slice_width, SLICE_REACHES * reach)
    at = F.floor(F.col("_us") / F.lit(slice_width))
    place = lambda shift: F.struct((at + shift).alias("slice"), F.lit(shift == 1).alias("context"))
    spread = (
        logs.filter(F.col("timestamp").isNotNull())
        .select("log_id", F.col(key).alias("_key"), micros("timestamp").alias("_us"), *more)
        .withColumn("_in", F.explode(F.when(F.col("_us") + reach > (at + 1) * slice_width, F.array(place(0), place(1)))
                                     .otherwise(F.array(place(0)))))
    )
    of_slice = Window.partitionBy("_key", "_in.slice")
    number = F.row_number().over(of_slice.orderBy("_us", "log_id"))
    before = lambda s: F.count("*").over(
        of_slice.orderBy("_us").rangeBetween(Window.unboundedPreceding, -s * width))
    return spread.select(
        "log_id", F.col("_key").alias(key), *more, "_in", *[(number - before(s)).alias(f"n_{s}") for s in spans],
    ).filter(~F.col("_in.context")).drop("_in")


def burst_ratio(logs: DataFrame, key: str = "source", window: timedelta | None = None, more: tuple[str, ...] = (),
                **slicing) -> DataFrame:
    """Per log: events of its key in the current window against the mean of the five before."""
    history = rules.BURST_HISTORY_WINDOWS
    counts = window_counts(logs, key, window, (1, history + 1), more, **slicing)
    return counts.select("log_id", key, *more, *burst_columns(F.col("n_1"), F.col(f"n_{history + 1}")))


def burst_columns(current, total):
    """current, baseline, burst_ratio, is_burst from the counts of one and of six windows."""
    baseline = F.greatest((total - current) / F.lit(float(rules.BURST_HISTORY_WINDOWS)), F.lit(1.0))
    known = total >= rules.BURST_MIN_EVENTS
    ratio = F.when(known, current / baseline).otherwise(F.lit(1.0))
    return [
        current.alias("current_count"),
        baseline.alias("baseline"),
        rounded(ratio, 2).alias("burst_ratio"),
        (known & (ratio >= rules.BURST_RATIO)).alias("is_burst"),
    ]


def rate_in_window(logs: DataFrame, key: str = "source", window: timedelta | None = None, **slicing) -> DataFrame:
    """Per log: events per minute of its key in the window that ends at the log."""
    window = window or timedelta(minutes=rules.BURST_WINDOW_MINUTES)
    minutes = window / timedelta(minutes=1)
    counts = window_counts(logs, key, window, (1,), **slicing)
    return counts.select("log_id", key, (F.col("n_1") / F.lit(minutes)).alias("rate_per_minute"))


def anomaly_scores(classified: DataFrame, ml_scores: DataFrame | None = None,
                   threshold: float = rules.ANOMALY_THRESHOLD, burst_window: timedelta | None = None,
                   window_size: int = rules.BASELINE_WINDOW, history: DataFrame | None = None, **slicing) -> DataFrame:
    """One anomaly row per log: the mean of the parts that apply to it.

    ``history``: the logs that training has seen. They seed the baselines, as the detector's training does.

    ``ml_scores`` (log_id, ml_score) is the isolation forest's answer; without it
    the part is 0, as for an untrained forest. The inputs meet on log_id.
    """
    deviation = log_deviation(classified, window_size=window_size, history=history, **slicing)
    kept = ("timestamp", "category", "severity")
    bursts = burst_ratio(classified, "source", burst_window, kept, **slicing).drop("current_count", "baseline")
    timeless = classified.filter(F.col("timestamp").isNull()).select("log_id", "source", *kept)
    joined = bursts.unionByName(timeless, allowMissingColumns=True).join(deviation, "log_id", "left")
    if ml_scores is None:
        joined = joined.withColumn("ml_score", F.lit(0.0))
    else:
        joined = joined.join(ml_scores.select("log_id", "ml_score"), "log_id", "left")
    return combine_scores(joined, threshold)


def combine_scores(parts: DataFrame, threshold: float = rules.ANOMALY_THRESHOLD) -> DataFrame:
    """Anomaly rows from (log_id, timestamp, source, category, severity, ml_score,
    max_z, metric_factors, burst_ratio, is_burst)."""
    filled = parts.withColumns({
        "ml_score": F.coalesce("ml_score", F.lit(0.0)),
        "max_z": F.coalesce("max_z", F.lit(0.0)),
        "is_burst": F.coalesce("is_burst", F.lit(False)),
        "_boost": F.when(
            F.col("category").isin(rules.SECURITY_CATEGORIES), lookup(rules.SECURITY_BOOST, F.upper("severity"))),
    })
    z_part = F.when(F.col("max_z") > 0, F.least(F.col("max_z") / 5.0, F.lit(1.0)))
    burst_part = F.when(F.col("is_burst"), F.least(F.col("burst_ratio") / 10.0, F.lit(1.0)))
    present = [F.col("ml_score"), z_part, burst_part, F.col("_boost")]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in present[1:]), present[0])
    count = sum((p.isNotNull().cast("int") for p in present[1:]), F.lit(1))
    scored = filled.withColumn("_score", clip(total / count))
    flagged = scored.withColumn("is_anomaly", F.col("_score") >= threshold)
    by_ml = F.col("ml_score") > threshold
    by_metric = F.col("max_z") > rules.Z_SCORE_LIMIT
    kind = (
        F.when(~F.col("is_anomaly"), "none")
        .when(by_ml & by_metric, "combined")
        .when(by_ml, "pattern")
        .when(by_metric, "metric")
        .when(F.col("is_burst"), "frequency")
        .otherwise("pattern")
    )
    no_text = F.array().cast("array<string>")
    factors = F.concat(
        F.when(by_ml, F.array(F.concat(F.lit("ML anomaly score="), fixed("ml_score", 2)))).otherwise(no_text),
        F.coalesce("metric_factors", no_text),
        F.when(F.col("is_burst"), F.array(F.concat(
            F.lit("Log burst: "), fixed("burst_ratio", 1), F.lit("x normal rate"))))
        .otherwise(no_text),
        F.when(F.col("_boost").isNotNull(), F.array(F.concat(
            F.lit("Security category severity boost (+"), fixed(F.col("_boost") * 100, 0), F.lit("%)")))).otherwise(no_text),
    )
    return flagged.select(
        "log_id", "timestamp", "source",
        rounded("_score", 3).alias("anomaly_score"),
        "is_anomaly",
        kind.alias("anomaly_type"),
        factors.alias("contributing_factors"),
        rounded("max_z", 2).alias("baseline_deviation"),
        (F.col("is_anomaly") & F.col("severity").isin("INFO", "WARNING")
         & (F.col("_score") > rules.SEVERITY_UPGRADE_SCORE)).alias("severity_upgrade"),
    )


def enrich_logs(classified: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Classified logs with is_anomaly and anomaly_score filled in."""
    found = anomalies.select("log_id", F.col("is_anomaly").alias("_flag"), F.col("anomaly_score").alias("_value"))
    joined = classified.join(found, "log_id", "left")
    return joined.withColumns({
        "is_anomaly": F.coalesce("_flag", "is_anomaly"),
        "anomaly_score": F.coalesce("_value", "anomaly_score"),
    }).select(*classified.columns)


def top_anomalous_devices(anomalies: DataFrame, n: int = 10) -> DataFrame:
    return (
        anomalies.filter("is_anomaly").groupBy("source")
        .agg(F.count("*").alias("anomaly_count"), mean_of_thousandths(F.col("anomaly_score"), F.lit(1)).alias("_mean"))
        .select(F.col("source").alias("device"), "anomaly_count", rounded("_mean", 3).alias("avg_score"))
        .orderBy(F.desc("avg_score"), "device").limit(n)
    )
