"""End-to-end analysis: raw logs to all result tables and the report."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsilt import rules
from netsilt.operators import anomaly, cascade, classify, maintenance, patterns, report, security
from netsilt.sources.readers import with_ids


@dataclass(frozen=True)
class Settings:
    """All parameters of a run; the defaults are the specified ones."""

    anomaly_threshold: float = rules.ANOMALY_THRESHOLD
    burst_window: timedelta = timedelta(minutes=rules.BURST_WINDOW_MINUTES)
    baseline_window: int = rules.BASELINE_WINDOW
    min_pattern_frequency: int = rules.MIN_PATTERN_FREQUENCY
    cascade_window: timedelta = timedelta(minutes=rules.CASCADE_WINDOW_MINUTES)
    alert_threshold: float = rules.ALERT_THRESHOLD
    horizon_hours: int = rules.HORIZON_HOURS


# what the analyses and the report read of a classified log
ANALYSIS_COLUMNS = [
    "log_id", "timestamp", "source", "source_ip", "description", "raw_message", "metrics", "category", "severity",
    "security_threat", "threat_type", "threat_score", "is_anomaly", "anomaly_score",
]


@dataclass
class Analysis:
    """Lazy result tables; ``counts`` and the report are the only small outputs.

    ``classified`` has all columns; ``base`` is what the analyses read. ``release``
    frees what the run and its report keep.
    """

    classified: DataFrame
    base: DataFrame
    settings: Settings = field(default_factory=Settings)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    kept: list[DataFrame] = field(default_factory=list)

    def _keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def release(self) -> None:
        for df in [self.base, *self.kept]:
            df.unpersist()
        self.kept.clear()

    def correlations(self) -> DataFrame:
        return cascade.cascade_correlations(self.base, self.settings.cascade_window)

    def counts(self) -> dict[str, int]:
        """Log count and the count of each result that was run."""
        small = {"log_count": self.base}
        if "anomalies" in self.tables:
            small["anomalies"] = self.tables["anomalies"].filter("is_anomaly")
        for name in ("threats", "patterns", "maintenance_alerts"):
            if name in self.tables:
                small[name] = self.tables[name]
        return {name: df.count() for name, df in small.items()}

    def enriched(self) -> DataFrame:
        """Classified logs with their anomaly scores, as they were where none were made."""
        return anomaly.enrich_logs(self.classified, self.tables["anomalies"]) if "anomalies" in self.tables else self.classified

    def _table(self, name: str) -> DataFrame:
        """A result, empty where its analysis was not run."""
        if name not in self.tables:
            none, s = self.base.filter("false"), self.settings
            return {
                "anomalies": lambda: anomaly.combine_scores(none.withColumns({
                    "max_z": F.lit(0.0), "metric_factors": F.array().cast("array<string>"), "ml_score": F.lit(0.0),
                    "burst_ratio": F.lit(1.0), "is_burst": F.lit(False)}), s.anomaly_threshold),
                "threats": lambda: security.security_incidents(none),
                "patterns": lambda: patterns.recurring_patterns(none),
                "maintenance_alerts": lambda: maintenance.maintenance_alerts(
                    maintenance.device_features(none), F.current_timestamp(), s.alert_threshold, None, s.horizon_hours),
            }[name]()
        return self.tables[name]

    def report(self, as_of: Column) -> DataFrame:
        """The one-row report. It reads each result several times, so the results
        are kept: anomalies only as far as the report reads them."""
        flagged = self._table("anomalies").filter("is_anomaly").select("source", "is_anomaly", "anomaly_score")
        inputs = [self._keep(df) for df in (flagged, *map(self._table, ("threats", "patterns", "maintenance_alerts")))]
        return report.health_report(self.base, *inputs, as_of)


def analyse(raw: DataFrame, as_of: Column, settings: Settings | None = None, *, run_anomaly: bool = True,
            run_security: bool = True, run_patterns: bool = True, run_prediction: bool = True,
            predictions: DataFrame | None = None, ml_scores: DataFrame | None = None,
            probabilities: DataFrame | None = None, reuse: bool = True) -> Analysis:
    """Classify raw logs and run any subset of the analyses on them.

    ``reuse`` keeps the columns all analyses read (in memory, beyond that on the
    executors' disks), so that patterns are matched once per log and not once per
    analysis; call ``release()`` when done. For input far beyond the
    cluster's storage write the classified logs with ``append_logs`` and analyse
    that table through ``analyse_classified``.
    """
    classified = classify.classify(with_ids(raw), predictions)
    base = classified.select(*ANALYSIS_COLUMNS)
    if reuse:
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
    return analyse_classified(
        classified, as_of, settings, run_anomaly=run_anomaly, run_security=run_security, run_patterns=run_patterns,
        run_prediction=run_prediction, ml_scores=ml_scores, probabilities=probabilities, base=base)


def analyse_classified(classified: DataFrame, as_of: Column, settings: Settings | None = None, *,
                       run_anomaly: bool = True, run_security: bool = True, run_patterns: bool = True,
                       run_prediction: bool = True, ml_scores: DataFrame | None = None,
                       probabilities: DataFrame | None = None, base: DataFrame | None = None) -> Analysis:
    """The analyses over classified logs, for example a stored table of them."""
    s = settings or Settings()
    base = classified.select(*ANALYSIS_COLUMNS) if base is None else base
    out = Analysis(classified, base, s)
    if run_anomaly:
        out.tables["anomalies"] = anomaly.anomaly_scores(
            base, ml_scores, s.anomaly_threshold, s.burst_window, s.baseline_window)
    if run_security:
        out.tables["threats"] = security.security_incidents(base)
    if run_patterns:
        out.tables["patterns"] = patterns.recurring_patterns(base, s.min_pattern_frequency)
    if run_prediction:
        out.tables["maintenance_alerts"] = maintenance.maintenance_alerts(
            maintenance.device_features(base), as_of, s.alert_threshold, probabilities, s.horizon_hours)
    return out


def at(time: str) -> Column:
    return F.lit(time).cast("timestamp")
