"""Pairs that are complete, as a stream with keyed state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ingest import shared_dir

#: Times keep their microseconds on the way.
FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
STATE = "done boolean, seen array<string>, bodies array<string>"


def complete(source: DataFrame, key: str, candidate: str, at: str, n: int, wait: str = "7 days") -> DataFrame:
    """The rows of a stream whose ``key`` has ``n`` distinct candidates or more.

    Rows of a key wait in its state until the ``n``-th candidate is there; then all of
    them come out, and each further new candidate at once.  A candidate that repeats counts
    and comes once (the first).  A key that hears nothing for ``wait`` of event time ``at``
    leaves with what it holds; rows that late, and rows without key, candidate or time, are
    left out.  The state is bounded by the candidates of one key; rows travel as JSON.
    """
    fields = source.select(*source.columns).schema
    rows = (
        source.where(F.col(key).isNotNull() & F.col(candidate).isNotNull()).withColumn("_at", F.col(at).cast("timestamp")).where("_at is not null").withWatermark("_at", wait)
        .select(F.col(key).cast("string").alias("_key"), F.col(candidate).cast("string").alias("_candidate"), "_at", F.to_json(F.struct(*source.columns), FORMAT | {"ignoreNullFields": "false"}).alias("_body"))
    )
    pause = int(pd.Timedelta(wait).total_seconds() * 1000)

    def step(key_of: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, seen, bodies = state.get if state.exists else (False, [], [])
        seen, bodies, last = list(seen), list(bodies), 0
        known = set(seen)
        for batch in batches:
            last = max(last, int(batch["_at"].max().timestamp() * 1000))
            for c, body in zip(batch["_candidate"], batch["_body"], strict=True):
                if c not in known:
                    known.add(c)
                    seen.append(c)
                    bodies.append(body)
        if done or len(seen) >= n:
            done = True
            if bodies:
                yield pd.DataFrame({"_body": bodies})
            bodies = []
        state.update((done, seen, bodies))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + pause)

    out = rows.groupBy("_key").applyInPandasWithState(step, "_body string", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.from_json("_body", fields, FORMAT).alias("r")).select("r.*")


def append_complete(source: DataFrame, key: str, candidate: str, at: str, n: int, target: str, checkpoint: str, wait: str = "7 days") -> None:
    """Append what ``complete`` finds to ``target`` and stop when the present files are
    read; a later call with the same folders goes on where this one ended."""
    found = complete(source, key, candidate, at, n, wait)
    found.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").start(target).awaitTermination()


def complete_table(spark: SparkSession, path: str, key: str, candidate: str, at: str, n: int) -> DataFrame:
    """The complete rows of ``path`` after one pass of the stream into new folders."""
    schema = spark.read.parquet(path).schema
    base = f"{shared_dir(spark)}/complete-{uuid.uuid4().hex}"
    append_complete(spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]"), key, candidate, at, n, f"{base}/rows", f"{base}/state", "3650 days")
    return spark.read.schema(schema).parquet(f"{base}/rows")
