"""Session settings and the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Session setting: deal the rows of an input into so many parts before patterns run. For
#: small files of one row group only, as in tests and the bench; unset, no input is shuffled.
SPREAD_SETTING = "spark.netsilt.inputPartitions"


def local_session(cores: int | str = "*", app: str = "netsilt", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. A cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        .config(SPREAD_SETTING, str(shuffle_partitions))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent and Spark runs in one process (tests, bench)
    does this fall back to a fresh temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="netsilt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder
