"""Embedding near-duplicates: cross-polytope hashing.

Vectors are rotated pseudo-randomly (sign flips and fast Hadamard transforms,
three times); the nearest signed axis is the hash, several of them make a bucket
key, and the next best axes are probed too.  Vectors of one label that share a
bucket are candidates, and every candidate pair is verified by its cosine in
double precision.

*Skew.*  Equal vectors of a label are one class.  Buckets are split into blocks
of at most ``BLOCK`` rows on average and the blocks meet pairwise, so a task
holds two blocks at a time; no bucket is cut off.  A pair is counted only in the
least bucket that both share.  Blocks return counts and a spanning forest of
their links, never all pairs.

Every row is indexed.  Recall against brute force is measured in the tests.

Defined results: vectors that are null, zero, or hold null or non-finite parts,
and those without a label, have no links and are their own component, and so do rows
without an id, whose component is null; vectors of
different length never meet; repeated rows count as vectors of their own; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, durable, read_table, runs
from .components import components

MIN_COSINE = 0.93
TABLES, HASHES, PROBES = 10, 2, 3
BLOCK = 512
SEED = 20240607


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def rotations(x: np.ndarray, count: int, seed: int) -> Iterator[np.ndarray]:
    """``count`` pseudo-random rotations of the rows, padded to a power of two."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    padded = np.zeros((len(x), d))
    padded[:, : x.shape[1]] = x
    rng = np.random.RandomState(seed)
    for _ in range(count):
        y = padded
        for _ in range(3):
            y = hadamard(y * rng.choice((-1.0, 1.0), d))
        yield y


def bucket_keys(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables * probes) bucket numbers of unit vectors.

    A hash ranks the axes by size; the best key takes each hash's best axis, and
    each further probe changes the one hash whose next axis costs least.
    """
    out = []
    turned = rotations(x, tables * hashes, seed)
    for table in range(tables):
        axis, loss = [], []
        for _ in range(hashes):
            y = next(turned)
            order = np.argsort(-np.abs(y), axis=1)[:, : min(probes, y.shape[1])]
            top = np.take_along_axis(y, order, axis=1)
            axis.append(2 * order + (top < 0))
            loss.append(np.abs(top[:, :1]) - np.abs(top))
        options = []  # (loss, key) of changing one hash
        width = 2 * (1 << 20)
        best = sum(a[:, 0] * width**j for j, a in enumerate(axis))
        for j, a in enumerate(axis):
            for p in range(1, a.shape[1]):
                options.append((loss[j][:, p], best + (a[:, p] - a[:, 0]) * width**j))
        keys = [best]
        if options:
            cost = np.stack([o[0] for o in options], axis=1)
            other = np.stack([o[1] for o in options], axis=1)
            pick = np.argsort(cost, axis=1, kind="stable")[:, : probes - 1]
            keys += list(np.take_along_axis(other, pick, axis=1).T)
        out += [k * tables + table for k in keys]
    return np.stack(out, axis=1).astype(np.int64)


def classes(vectors: DataFrame) -> DataFrame:
    """(cid, label, e, m): distinct usable vectors of each label."""
    e = F.col("embedding").cast("array<double>")
    bad = F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (
        vectors.select("vec_id", "label", e.alias("e")).where("vec_id is not null and label is not null and e is not null")
        .where(~bad & F.exists("e", lambda v: v != 0))
        .groupBy("label", "e").agg(F.min("vec_id").alias("cid"), F.count("*").alias("m"))
    )


def unit(rows: pd.Series) -> np.ndarray:
    x = np.vstack([np.asarray(v, float) for v in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def keyed(found: DataFrame) -> DataFrame:
    """``found`` with the bucket numbers of each class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, some in batch.groupby(batch["e"].map(len), sort=True):
                yield some.assign(keys=list(bucket_keys(unit(some["e"]))))

    lab = found.schema["label"].dataType.simpleString()
    return found.mapInPandas(run, f"label {lab}, e array<double>, cid long, m long, keys array<long>")


def share_earlier(keys: np.ndarray, key: int, width: int = 1024) -> np.ndarray:
    """Which two rows of ``keys`` have a bucket number below ``key`` in common."""
    values, at, rows = np.unique(keys, return_inverse=True, return_counts=True)
    useful = np.flatnonzero((values < key) & (rows > 1))
    place = np.full(len(values), -1)
    place[useful] = np.arange(len(useful))
    row, number = np.repeat(np.arange(len(keys)), keys.shape[1]), place[at.ravel()]
    shared = np.zeros((len(keys), len(keys)), bool)
    for start in range(0, len(useful), width):
        mine = (number >= start) & (number < start + width)
        has = np.zeros((len(keys), width), np.float32)
        has[row[mine], number[mine] - start] = 1
        shared |= has @ has.T > 0
    return shared


def group_links(rows: pd.DataFrame, least_cosine: float) -> list[tuple[int, int | None, int]]:
    """(a, b, links) of one pair of blocks: forest edges, then counts (b null)."""
    i, j, key = (rows[c].iloc[0] for c in ("bi", "bj", "key"))
    x, keys = unit(rows["e"]), np.vstack(rows["keys"])
    cid, m, block = (rows[c].to_numpy() for c in ("cid", "m", "block"))
    if i == j:
        a, b = np.nonzero(np.triu(x @ x.T >= least_cosine, 1))
    else:
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = np.nonzero(x[left] @ x[right].T >= least_cosine)
        a, b = left[a], right[b]
    if not len(a):
        return []
    met = np.union1d(a, b)
    earlier = share_earlier(keys[met], key)
    here = ~earlier[np.searchsorted(met, a), np.searchsorted(met, b)]
    a, b = a[here], b[here]
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, a, m[b])
    np.add.at(links, b, m[a])
    forest, out = Forest(len(rows)), []
    for p, q in zip(a.tolist(), b.tolist(), strict=True):
        if forest.join(p, q):
            out.append((int(cid[p]), int(cid[q]), 0))
    return out + [(int(cid[k]), None, int(links[k])) for k in np.flatnonzero(links)]


def block_links(placed: DataFrame, least_cosine: float) -> DataFrame:
    """Runs group_links over every (key, bi, bj), streaming sorted partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(batches, ["key", "bi", "bj"]):
            if out := group_links(rows, least_cosine):
                a, b, links = zip(*out, strict=True)  # a null beside long numbers would make them doubles
                yield pd.DataFrame({"a": a, "b": pd.array(b, "Int64"), "links": links})

    return placed.mapInPandas(run, "a long, b long, links long")


def near_duplicates(vectors: DataFrame, least_cosine: float = MIN_COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    base = durable(keyed(classes(vectors)))
    # Labels and lengths keep apart by being part of the bucket number.
    salted = base.withColumn(
        "keys", F.transform("keys", lambda k: F.xxhash64(F.col("label"), F.size("e"), k))
    )
    entries = salted.select("cid", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(
        "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
    )
    # One row for each pair of blocks that a member takes part in.
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    seats = (
        entries.join(sizes, "key").withColumn("block", block)
        .select("cid", "key", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("cid", "key", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    )
    placed = (
        seats.join(salted.select("cid", "e", "m", "keys"), "cid")
        .repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "cid")
    )
    found = durable(block_links(placed, least_cosine))
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    comp = components(found.where("b is not null").select("a", "b"))
    of_class = (
        base.select("cid", "label", "e", "m").join(counts, "cid", "left")
        .join(comp.withColumnRenamed("node", "cid"), "cid", "left")
        .select("label", "e", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("comp", "cid").alias("component_id"))
    )
    e = F.col("embedding").cast("array<double>")
    return (
        vectors.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("label")).alias("label"), e.alias("e")).join(of_class, ["label", "e"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op9_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
