"""Resumable ingest of append-only files as a stream."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one where it names none in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (named or "file://" + tempfile.mkdtemp(prefix="spark-")).rstrip("/")


def append_new(source: DataFrame, key: str, at: str, target: str, checkpoint: str, delay: str) -> None:
    """Append the rows of a stream whose key has not been seen within ``delay``
    of event time ``at``, and stop when the present files are read.

    The checkpoint holds the files done and the keys seen, so a second call with
    the same folders goes on where the first one ended.
    """
    timed = source.withColumn("_event_time", F.col(at).cast("timestamp")).withWatermark("_event_time", delay)
    fresh = timed.dropDuplicatesWithinWatermark([key]).drop("_event_time")
    fresh.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(target).awaitTermination()


def ingest(spark: SparkSession, path: str, key: str, at: str, delay: str = "3650 days") -> DataFrame:
    """``path`` after one pass of ``append_new`` into new folders.

    A pattern that fits only ``path`` lets it be a single file as well as a folder.
    """
    schema = spark.read.parquet(path).schema
    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    append_new(spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]"), key, at, f"{base}/rows", f"{base}/state", delay)
    return spark.read.schema(schema).parquet(f"{base}/rows")
