"""Streaming ingest: read, classify, dispatch to tables and handlers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from netsilt.session import shared_folder
from netsilt.sources import readers
from netsilt.sources.places import located, with_line_places

Handler = Callable[[DataFrame, int], None]


def run_folder(spark: SparkSession) -> str:
    """A new folder for one streaming run, in the shared folder of the session."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def json_log_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files landing in a folder, as raw logs."""
    return readers.json_lines(with_line_places(spark.readStream.text(path)))


def syslog_stream(spark: SparkSession, path: str) -> DataFrame:
    """Syslog text files landing in a folder, as raw logs."""
    return readers.syslog_lines(with_line_places(spark.readStream.text(path)))


def land_logs(spark: SparkSession, path: str, folder: str, checkpoint: str, fmt: str = "jsonl") -> StreamingQuery:
    """Land the files of a folder as a table of raw logs, with the ids that the batch readers give
    the same files. Streams that start from the table agree on the ids however they are planned."""
    parse = {"jsonl": readers.json_lines, "syslog": readers.syslog_lines}[fmt]

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(parse(with_line_places(batch)), folder, batch_id)

    return start_available(located(spark.readStream.text(path)), each, checkpoint)


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table as a stream of its files: a folder of part files or a single file.

    A plain path must be a folder, a pattern need not; so the last letter becomes one.
    """
    path = path.rstrip("/")
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def start_available(stream: DataFrame, each: Handler, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that has arrived, then stop; the next start goes on from there."""
    return (
        stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def batch_path(folder: str, batch_id: int) -> str:
    return f"{folder}/batch={batch_id}"


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    """One folder per micro-batch: a repeated batch overwrites its own output only."""
    df.write.mode("overwrite").parquet(batch_path(folder, batch_id))


def _handled(spark: SparkSession, ledger: str, batch_id: int) -> set[int]:
    """The handlers that are through with a batch, one small row each."""
    path = spark._jvm.org.apache.hadoop.fs.Path(batch_path(ledger, batch_id))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return set()
    return {r.handler for r in spark.read.schema("handler int").parquet(batch_path(ledger, batch_id)).collect()}


def dispatch(stream: DataFrame, bronze: str, handlers: Sequence[Handler], checkpoint: str) -> StreamingQuery:
    """Land every micro-batch in the bronze table, then hand it to each subscriber.

    A failing handler fails the batch; on restart the batch runs again from the
    checkpoint, so nothing is lost and landed rows are not doubled. A ledger beside the
    checkpoint has a row per handler that is through with a batch, so those before a failing one
    do not run again. Handlers keep their place in the list from run to run.
    """
    ledger = f"{checkpoint.rstrip('/')}-handled"

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        through = _handled(spark, ledger, batch_id)
        if not through:
            write_batch(batch, bronze, batch_id)
        landed = spark.read.schema(batch.schema).parquet(batch_path(bronze, batch_id))
        for place, handler in enumerate(handlers):
            if place not in through:
                handler(landed, batch_id)
                spark.createDataFrame([(place,)], "handler int").coalesce(1).write.mode("append").parquet(batch_path(ledger, batch_id))

    return start_available(stream, each, checkpoint)


def land_on_time(stream: DataFrame, folder: str, checkpoint: str, delay: timedelta) -> StreamingQuery:
    """Land logs in ``<folder>/on_time`` and those that come too late in ``<folder>/late``: at or before the latest
    time of all earlier batches less ``delay``. Logs without a time are on time. The latest time goes from batch to batch
    as a table of one row, so a batch that runs again decides alike. Three writes read the batch, which is kept for them."""
    def each(batch: DataFrame, batch_id: int) -> None:
        latest = None
        if batch_id > 0:
            latest = batch.sparkSession.read.schema("latest timestamp").parquet(batch_path(f"{folder}/clock", batch_id - 1)).first()[0]
        is_late = F.lit(False) if latest is None else F.coalesce(F.col("timestamp") <= F.lit(latest - delay), F.lit(False))
        logs = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            write_batch(logs.filter(~is_late), f"{folder}/on_time", batch_id)
            write_batch(logs.filter(is_late), f"{folder}/late", batch_id)
            newest = logs.agg(F.greatest(F.max("timestamp"), F.lit(latest).cast("timestamp")).alias("latest"))
            write_batch(newest.coalesce(1), f"{folder}/clock", batch_id)
        finally:
            logs.unpersist()

    return start_available(stream, each, checkpoint)


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append a streaming frame to a Parquet folder (exactly once, by the file sink's log)."""
    return (
        stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
