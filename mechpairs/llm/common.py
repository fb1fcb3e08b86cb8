"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; a temporary one only where the
    session names none in local mode (tests); on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.mechpairs.local.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.mechpairs.local.dir", named)
    return named.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Fewer rows in an Arrow batch than Spark's default, as rows of texts are long;
    a number that the session has set itself stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and survives lost executors, as the files are in shared
    storage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tallied(df: DataFrame, number: Column) -> tuple[DataFrame, int]:
    """``durable(df)``, and an aggregate of its rows that the write itself computes."""
    seen = Observation()
    table = durable(df.observe(seen, number.alias("n")))
    return table, int(seen.get.get("n") or 0)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``durable(df)`` and the number of its rows."""
    return tallied(df, F.count(F.lit(1)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def crc_mod4(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def learning_rows(labels: DataFrame, target: str, cap: int) -> DataFrame:
    """(doc_id, y) of at most ``cap`` labelled rows outside the held-out fold.

    The rows with the smallest hash of doc_id are taken, so the sample does not
    depend on partitioning.  The bound is what lets callers broadcast it.
    Several labels of one document: the largest counts.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & (crc_mod4(F.col("doc_id")) != 2))
        .groupBy("doc_id").agg(F.max(target).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(cap)
    )


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``rows``, so that what Python holds beside Arrow stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_column(docs: DataFrame, name: str, kind: str, measure: Callable[[], Callable[[list], list]]) -> DataFrame:
    """``docs`` with ``name`` measured from whole texts; a column of that name gives way.

    ``measure`` is called once in each task and returns a function of a list of texts.
    Other columns stay in Arrow, so ids are the same whatever stands beside them.
    """
    small_batches(docs.sparkSession)
    schema = docs.withColumn(name, F.lit(None).cast(kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = measure()
        for batch in slices(batches):
            made = pa.array(function(batch.column("text").to_pylist()))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {name: made}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, schema)


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of equal keys out of sorted batches; one group is held at a time."""
    held: list[pd.DataFrame] = []
    last: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        ids = batch[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(ids[start])
            if held and key != last:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(batch.iloc[start:end])
            last = key
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


class Forest:
    """Union-find over the items of one group."""

    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = self.root[k]
        return k

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart until now."""
        a, b = self.find(a), self.find(b)
        self.root[a] = b
        return a != b
