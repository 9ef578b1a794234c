"""Isolation forest: trees built in parallel from small samples, scored in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netsilt import rules
from netsilt.functions.columns import clip, metric
from netsilt.functions.quantiles import exact_quantile, exact_quantiles
from netsilt.operators.classify import severity_rank

FEATURES = ["cpu_usage", "memory_usage", "interface_errors", "severity_num", "has_ip_address"]
TREE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, path double"


def anomaly_features(logs: DataFrame) -> DataFrame:
    """log_id and the five inputs of the forest."""
    zero = F.lit(0.0)
    return logs.select(
        "log_id",
        (F.coalesce(metric("cpu_usage"), zero) / 100.0).alias("cpu_usage"),
        (F.coalesce(metric("memory_usage"), zero) / 100.0).alias("memory_usage"),
        (F.least(F.coalesce(metric("interface_errors"), zero), F.lit(100.0)) / 100.0).alias("interface_errors"),
        (severity_rank(rules.ANOMALY_SEVERITY_RANK) / F.lit(7.0)).alias("severity_num"),
        F.when(F.coalesce("source_ip", F.lit("")) != "", 1.0).otherwise(0.0).alias("has_ip_address"),
    )


def standardise(rows: DataFrame, columns: list[str], moments: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns shifted to mean 0 and scaled to deviation 1; a constant column becomes 0."""
    return rows.withColumns({
        c: (F.col(c) - F.lit(moments[c][0])) / F.lit(moments[c][1] or 1.0) for c in columns})


def column_moments(rows: DataFrame, columns: list[str]) -> tuple[int, dict[str, tuple[float, float]]]:
    """Row count, and mean and population deviation per column (one small row).

    Rounded, so that the order of summation does not show in a fitted model.
    """
    row = rows.agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return row["n"], {c: (round(row[f"m_{c}"] or 0.0, 12), round(row[f"s_{c}"] or 0.0, 12)) for c in columns}


def mean_path(n: float) -> float:
    """Expected path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(tree: int, x: np.ndarray, seed: int) -> pd.DataFrame:
    """Random splits of one small sample down to single points or the depth limit."""
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list] = []
    waiting = [(np.arange(len(x)), 0, -1, 0)]  # rows, depth, parent, side
    while waiting:
        rows, depth, parent, side = waiting.pop()
        node = len(nodes)
        if parent >= 0:
            nodes[parent][4 + side] = node
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        open_features = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(open_features) == 0:
            nodes.append([tree, node, -1, 0.0, -1, -1, depth + mean_path(len(rows))])
            continue
        feature = int(rng.choice(open_features))
        cut = float(rng.uniform(low[feature], high[feature]))
        nodes.append([tree, node, feature, cut, -1, -1, 0.0])
        below = x[rows, feature] <= cut
        waiting.append((rows[~below], depth + 1, node, 1))
        waiting.append((rows[below], depth + 1, node, 0))
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "threshold", "left", "right", "path"])


@dataclass
class IsolationForest:
    """A fitted forest: at most trees * (2 * sample - 1) nodes, whatever the data size."""

    nodes: pd.DataFrame
    moments: dict[str, tuple[float, float]]
    sample: int
    offset: float
    n_samples: int = 0


def _tree_samples(rows: DataFrame, total: int, trees: int, sample: int, seed: int) -> DataFrame:
    """``sample`` rows for each tree, chosen among all rows by a hash of the id and the tree.

    A row first picks its trees, each with the same small probability, so about four
    samples a tree reach the ranking whatever the number of rows.
    """
    chance = min(1.0, 4.0 * sample / max(total, 1))
    draw = lambda t: F.pmod(F.xxhash64("log_id", t, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < chance)
    spread = rows.withColumn("tree", F.explode(picked))
    rank = Window.partitionBy("tree").orderBy(F.xxhash64("tree", "log_id", F.lit(seed)), "log_id")
    return spread.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= sample).drop("_r")


def fit(logs: DataFrame, trees: int = rules.ISOLATION_TREES, sample: int = rules.ISOLATION_SAMPLE,
        contamination: float = rules.CONTAMINATION, seed: int = 42) -> IsolationForest:
    """Fit on all logs; each tree sees ``sample`` of them."""
    rows = anomaly_features(logs)
    total, moments = column_moments(rows, FEATURES)
    if total < rules.MIN_TRAINING_LOGS:
        raise ValueError(f"need at least {rules.MIN_TRAINING_LOGS} logs to train, got {total}")
    scaled = standardise(rows, FEATURES, moments)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        # row order from a shuffle is not fixed; the id order is
        pdf = pdf.sort_values("log_id")
        return grow_tree(int(pdf["tree"].iloc[0]), pdf[FEATURES].to_numpy(), seed)

    grown = _tree_samples(scaled, total, trees, sample, seed).groupBy("tree").applyInPandas(build, TREE_SCHEMA)
    nodes = grown.toPandas().sort_values(["tree", "node"], ignore_index=True)
    forest = IsolationForest(nodes, moments, min(sample, total), 0.0, total)
    # threshold: the share ``contamination`` of the training logs lies below it
    raw = raw_scores(logs, forest).select("raw").persist()
    forest.offset = cut_off(raw, contamination)
    raw.unpersist()
    return forest


def cut_off(raw: DataFrame, contamination: float) -> float:
    """The exact share ``contamination`` of the scores in ``raw(raw)``, negated as decisions are, lies below it."""
    return exact_quantile(raw, -F.col("raw"), contamination)


def cut_offs(raw: DataFrame, contaminations: Sequence[float]) -> list[float]:
    """``cut_off`` for several shares, in the passes of one."""
    return exact_quantiles(raw, -F.col("raw"), contaminations)


def raw_scores(logs: DataFrame, forest: IsolationForest) -> DataFrame:
    """(log_id, raw): 2^(-mean path / expected path), high for isolated logs."""
    scaled = standardise(anomaly_features(logs), FEATURES, forest.moments)
    groups = [g for _, g in forest.nodes.groupby("tree", sort=True)]
    tables = [(g["feature"].to_numpy(), g["threshold"].to_numpy(), g["left"].to_numpy(), g["right"].to_numpy(),
               g["path"].to_numpy()) for g in groups]
    shared = logs.sparkSession.sparkContext.broadcast(tables)
    depth = math.ceil(math.log2(max(forest.sample, 2)))

    @F.pandas_udf("double")
    def mean_depth(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        forest_tables = shared.value
        for columns in parts:
            x = np.column_stack([c.to_numpy() for c in columns])
            every = np.arange(len(x))
            total = np.zeros(len(x))
            for feature, threshold, left, right, path in forest_tables:
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(depth):
                    f = feature[at]
                    below = x[every, np.maximum(f, 0)] <= threshold[at]
                    at = np.where(f < 0, at, np.where(below, left[at], right[at]))
                total += path[at]
            yield pd.Series(total / len(forest_tables))

    expected = mean_path(forest.sample)
    return scaled.select(
        "log_id", F.pow(F.lit(2.0), -mean_depth(*FEATURES) / F.lit(expected or 1.0)).alias("raw"))


def score(logs: DataFrame, forest: IsolationForest | None) -> DataFrame:
    """(log_id, ml_score) in [0, 1]; 0 without a trained forest."""
    if forest is None:
        return logs.select("log_id", F.lit(0.0).alias("ml_score"))
    # decision value = -raw - offset, negative for anomalies
    decision = -F.col("raw") - F.lit(forest.offset)
    return raw_scores(logs, forest).select("log_id", clip(F.lit(0.5) - decision).alias("ml_score"))


def save_forest(spark: SparkSession, forest: IsolationForest, path: str) -> None:
    spark.createDataFrame(forest.nodes, TREE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    row = [(forest.moments, forest.sample, float(forest.offset), forest.n_samples)]
    row = [({k: list(v) for k, v in row[0][0].items()}, *row[0][1:])]
    spark.createDataFrame(row, "moments map<string,array<double>>, sample int, offset double, n_samples long") \
        .write.mode("overwrite").parquet(f"{path}/settings")


def load_forest(spark: SparkSession, path: str) -> IsolationForest | None:
    """The saved forest, or None where there is none that can be read."""
    try:
        nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"], ignore_index=True)
        s = spark.read.parquet(f"{path}/settings").first()
    except Exception:  # noqa: BLE001 - absent and unreadable models are the same to the caller
        return None
    return IsolationForest(nodes, {k: tuple(v) for k, v in s["moments"].items()}, s["sample"], s["offset"], s["n_samples"])
