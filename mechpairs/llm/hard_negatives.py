"""Hard negatives: inner-product search by coordinate pruning in length buckets.

For each anchor the best rows of its label are its positives; for each positive the best
rows of other labels whose score lies in a window below the positive's are its hard
negatives.  Rows are kept in blocks of one label and one length class.  A block holds a
sorted list of each coordinate; the bound that an anchor needs narrows the range that a
row's value may have in the anchor's largest (focus) coordinates, the lists give the rows
in those ranges, their intersection is cut once more by the part of the product that the
focus leaves open, and what remains is scored exactly in whole numbers.

Three passes, each a join of anchors to blocks: the longest block of the anchor's label,
whose fifth best score bounds the second pass over the label's other blocks, then the
blocks of other labels, bounded by the least window.  A block whose length cannot reach
the bound is never visited.

*Scale.*  Blocks have about ``BLOCK`` rows and chunks about ``CHUNK`` anchors, so a task
holds one of each at a time whatever a label's share, and a visit is one shipped anchor
for ``BLOCK`` rows.  Nothing is collected, broadcast by force, or cut off.

Defined results: rows without id, label or vector, or with a null or non-finite part, or a
part whose whole number exceeds 32 bits, take no part; of several rows of one id the least
by (label, vector) does; vectors of different length never meet; vectors of zeros score 0;
scores that 64 bits cannot hold raise an error; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import counted, durable, read_table, tallied

POSITIVES, NEGATIVES = 5, 3
#: Window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
BLOCK, CHUNK = 4096, 4096
#: Blocks that one join task pairs with a chunk of anchors.
PART = 1024
FOCUS, SEEDS = 4, 64
#: Rows of a length class differ in length by at most this factor.
STEP = 1.1
SALTS = 64
#: Slack of the bounds for rounding; the scores themselves are exact.
SLACK = 1e-9


class Block:
    """Vectors of one block with their sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.x = rows.astype(float)
        self.squares = (self.x**2).sum(axis=1)
        self.top = float(np.sqrt(self.squares.max(initial=0.0)))
        self.most = int(np.abs(rows).max(initial=0))
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of coordinate ``f`` in order, and their rows."""
        if f not in self.lists:
            order = np.argsort(self.x[:, f], kind="stable")
            self.lists[f] = (self.x[order, f], order)
        return self.lists[f]

    def feasible(self, q: np.ndarray, least: int | None) -> np.ndarray:
        """Rows that may score ``least`` or more with ``q``; a superset of those that do."""
        length = float(np.sqrt((q.astype(float) ** 2).sum()))
        if least is None or least <= 0 or not length:
            return np.arange(len(self.ids))
        need = least * (1 - SLACK) / length
        if need > self.top * (1 + SLACK):
            return np.arange(0)
        unit = q / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        width = np.sqrt(np.maximum(0.0, self.top**2 - need**2) * np.maximum(0.0, 1 - unit[focus] ** 2)) + SLACK * self.top
        # A row may reach the end of the ball where the anchor itself points there.
        low = np.where(-unit[focus] * self.top >= need, -np.inf, need * unit[focus] - width)
        high = np.where(unit[focus] * self.top >= need, np.inf, need * unit[focus] + width)
        spans = []
        for f, lo, hi in zip(focus.tolist(), low, high, strict=True):
            values, order = self.sorted_list(f)
            spans.append(order[np.searchsorted(values, lo, "left") : np.searchsorted(values, hi, "right")])
        rows = min(spans, key=len)
        mine = self.x[np.ix_(rows, focus)]
        inside = ((mine >= low) & (mine <= high)).all(axis=1)
        rest = np.sqrt(np.maximum(0.0, self.squares[rows] - (mine**2).sum(axis=1)))
        left = np.sqrt(max(0.0, 1 - float((unit[focus] ** 2).sum())))
        reach = mine @ unit[focus] + rest * left + SLACK * self.top
        return rows[inside & (reach >= need)]

    def scores(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact inner products: by doubles while they are whole, else by whole numbers."""
        bound = self.most * int(np.abs(q).max(initial=0)) * len(q)
        if bound < 1 << 53:
            return (self.x[rows] @ q.astype(float)).astype(np.int64)
        if bound < 1 << 63:
            return self.rows[rows] @ q
        return (self.rows[rows].astype(object) @ q.astype(object)).astype(np.int64)

    def seed(self, q: np.ndarray, k: int) -> int | None:
        """A score that at least ``k`` rows reach: of the rows furthest along the focus."""
        if len(self.ids) <= SEEDS:
            return None
        f = int(np.abs(q).argmax())
        _, order = self.sorted_list(f)
        tried = self.scores(q, order[-SEEDS:] if q[f] > 0 else order[:SEEDS])
        return int(np.partition(tried, -k)[-k])


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best by score, ties by id."""
    return np.lexsort((ids, -scores))[:k]


def positives_of(block: Block, anchor: int, q: np.ndarray, need: dict, k: int) -> list[tuple]:
    """(anchor, row, score) of the block's ``k`` best rows other than the anchor."""
    seed = block.seed(q, k + 1)
    bounds = [b for b in (need["least"], seed) if b is not None]
    rows = block.feasible(q, max(bounds, default=None))
    rows = rows[block.ids[rows] != anchor]
    scores = block.scores(q, rows)
    return [(anchor, None, int(block.ids[rows[p]]), int(scores[p])) for p in best(block.ids[rows], scores, k)]


def negatives_of(block: Block, anchor: int, q: np.ndarray, need: dict, k: int) -> list[tuple]:
    """(anchor, positive, row, score) of the block's ``k`` best rows of each window."""
    rows = block.feasible(q, min(w["low"] for w in need["windows"]))
    scores, out = block.scores(q, rows), []
    for window in need["windows"]:
        held = (scores >= window["low"]) & (scores <= window["high"])
        mine, own = rows[held], scores[held]
        out += [(anchor, window["id"], int(block.ids[mine[p]]), int(own[p])) for p in best(block.ids[mine], own, k)]
    return out


WINDOWS = "array<struct<id:bigint,low:bigint,high:bigint>>"


def visited(rows: DataFrame, seats: DataFrame, search: Callable, k: int) -> DataFrame:
    """(anchor_id, positive_id, other_id, score): ``search`` in every block for the anchors
    that have a seat there.  ``seats`` holds block, chunk, vec_id, v, least and windows."""
    held = rows.join(seats.select("block", "chunk").distinct(), "block").select(
        "block", "chunk", "vec_id", "v", F.lit(False).alias("anchor"), F.lit(None).cast("bigint").alias("least"), F.lit(None).cast(WINDOWS).alias("windows")
    )
    asked = seats.select("block", "chunk", "vec_id", "v", F.lit(True).alias("anchor"), "least", "windows")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids = group["vec_id"].to_numpy()
        flat = pa.concat_arrays(group["v"].chunks).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        v = flat.reshape(len(ids), -1) if len(ids) else flat.reshape(0, 0)
        asks = group["anchor"].to_numpy().astype(bool)
        block = Block(ids[~asks], v[~asks])
        needs = group.select(["least", "windows"]).filter(pa.array(asks)).to_pylist()
        found = [x for a, q, need in zip(ids[asks].tolist(), v[asks], needs, strict=True) for x in search(block, a, q, need, k)]
        columns = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "positive_id", "other_id", "score"])

    return held.unionByName(asked).groupBy("block", "chunk").applyInArrow(run, "anchor_id bigint, positive_id bigint, other_id bigint, score bigint")


def in_blocks(vectors: DataFrame) -> DataFrame:
    """``vectors(vec_id, label, v)`` with size, length and block, one row for each id."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    once = (
        vectors.where("vec_id is not null and label is not null and v is not null")
        .groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(F.min(F.struct("label", "v")).alias("r"))
        .select("vec_id", "r.label", "r.v").withColumn("length", length)
        .select("*", F.size("v").alias("size"), F.when(F.col("length") > 0, F.floor(F.log("length") / F.log(F.lit(STEP)))).otherwise(-1).alias("class"))
    )
    table = durable(once)
    kind = ["label", "size", "class"]
    counts = table.groupBy(*kind).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = table.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int")).join(counts, [*kind, "salt"])
    # Salts and blocks come from different hashes, so each block has its share of every salt.
    number = F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.col("blocks"))
    return durable(salted.select("vec_id", "label", "size", "length", "v", F.xxhash64(*kind, number).alias("block")))


def ranked(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for
    ``vectors(vec_id, label, v)`` with whole-number vectors; ``is_anchor`` tells anchors."""
    rows = in_blocks(vectors)
    blocks, n_blocks = counted(rows.groupBy("block", "label", "size").agg(F.max("length").alias("top")))
    anchors, n_anchors = counted(rows.where(is_anchor).drop("block"))
    chunks, parts = -(-max(1, n_anchors) // CHUNK), -(-max(1, n_blocks) // PART)
    anchors = anchors.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "vec_id"), F.lit(chunks)).cast("int"))
    spread = blocks.withColumn("part", F.pmod(F.col("block"), F.lit(parts)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def seats(asking: DataFrame, same_label: bool) -> DataFrame:
        """Every anchor with each block of its label, or of any other."""
        asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        other = spread.withColumnRenamed("label", "of_label")
        test = F.col("label") == F.col("of_label") if same_label else F.col("label") != F.col("of_label")
        return asking.join(other, ["size", "chunk", "part"]).where(test)

    no_windows = F.lit(None).cast(WINDOWS)
    longest = blocks.groupBy("label", "size").agg(F.max_by("block", F.struct("top", "block")).alias("first"))
    asking = anchors.join(longest, ["label", "size"])
    first = asking.withColumnRenamed("first", "block").select("*", F.lit(None).cast("bigint").alias("least"), no_windows.alias("windows"))
    begun = durable(visited(rows, first, positives_of, positives))
    bound = begun.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.when(F.count("*") >= positives, F.min("score")).alias("least"))
    later = (
        seats(asking.join(bound, "vec_id", "left"), True).where("block <> first")
        .where(F.col("least").isNull() | (F.col("length") * F.col("top") * (1 + SLACK) >= F.col("least"))).withColumn("windows", no_windows)
    )
    pairs = durable(
        ranked(begun.unionByName(visited(rows, later, positives_of, positives)), ["anchor_id"], positives)
        .select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    )
    score = F.col("positive_score").cast("decimal(20,0)")
    window = F.struct(F.col("positive_id").alias("id"), F.ceil(score * low / 100).cast("bigint").alias("low"), F.floor(score * high / 100).cast("bigint").alias("high"))
    windows = (
        pairs.select(F.col("anchor_id").alias("vec_id"), window.alias("w")).where("w.low <= w.high")
        .groupBy("vec_id").agg(F.collect_list("w").alias("windows"), F.min("w.low").alias("least"))
    )
    wanted = seats(anchors.join(windows, "vec_id"), False).where(F.col("length") * F.col("top") * (1 + SLACK) >= F.col("least"))
    found = ranked(visited(rows, wanted, negatives_of, negatives), ["anchor_id", "positive_id"], negatives)
    return found.join(pairs, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the contract: parts as floor(256 * x), other rows left out."""
    parts = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(~F.isnan(x) & (F.abs(x) < 2**31 / 256), F.floor(256 * x).cast("int")))
    return vectors.select("vec_id", "label", parts.alias("v")).where(~F.exists("v", lambda x: x.isNull()))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(read_table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def oracle() -> str:
    return f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM r WHERE vec_id % 50 = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score FROM a JOIN r ON a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN (SELECT * FROM s WHERE NOT same) USING (anchor_id)
WHERE {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= {NEGATIVES}"""
