"""Similar entities and similar pairs, through inverted indexes and top lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved

TOP = 50
#: Entities of a block, and blocks that one token may meet in one task.
BLOCK, PARTS = 2048, 64


def token_similarity(sets: DataFrame, hub: int = 1000) -> DataFrame:
    """(x, y, shared, jaccard) of entities that share a token of ``sets(entity, token)``.

    Work grows with the squares of token frequencies; rows of a token that more than
    ``hub`` entities have are spread over salted parts, so no part holds more than
    about ``hub`` of them on one side.
    """
    rows = sets.distinct()
    freq = rows.groupBy("token").agg(F.count("*").alias("f"))
    sizes = rows.groupBy("entity").agg(F.count("*").alias("size"))
    tagged = rows.join(freq, "token").where("f > 1").withColumn("parts", F.ceil(F.col("f") / hub).cast("int"))
    left = tagged.select("token", F.col("entity").alias("x"), F.pmod(F.xxhash64("entity"), "parts").cast("int").alias("salt"))
    right = tagged.select("token", F.col("entity").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    # Dealt by x once: counting and the top list of an entity need no other shuffle.
    shared = left.join(right, ["token", "salt"]).where("x <> y").select("x", "y").repartition("x").groupBy("x", "y").agg(F.count("*").alias("shared"))
    a, b = (sizes.select(F.col("entity").alias(c), F.col("size").alias(f"n{c}")) for c in "xy")
    return shared.join(a, "x").join(b, "y").select("x", "y", "shared", (F.col("shared") / (F.col("nx") + F.col("ny") - F.col("shared"))).alias("jaccard"))


def combined(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """(x, y, sim): weighted sum of several ``(x, y, jaccard)`` tables."""
    rows = None
    for df, w in parts:
        p = df.select("x", "y", (F.col("jaccard") * w).alias("s"))
        rows = p if rows is None else rows.unionByName(p)
    return rows.groupBy("x", "y").agg(F.sum("s").alias("sim")).where("sim > 0")


def top_similar(sim: DataFrame, m: int = TOP) -> DataFrame:
    """The ``m`` most similar entities of each, by id on a tie."""
    w = Window.partitionBy("x").orderBy(F.desc("sim"), "y")
    return sim.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)


def lists(column: pa.Array) -> list[np.ndarray]:
    values, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
    return np.split(values, ends[1:-1] - ends[0])


def met(cell: list[tuple[np.ndarray, np.ndarray]], same: bool, least: np.ndarray, m: int, block: int) -> np.ndarray:
    """Rows (place of x, place of y, similarity) of a cell's entities that may be among the
    ``m`` most similar: above ``least`` of x and not below the m-th of the cell.

    ``cell`` holds, for each shared token, the codes (size * block + place) on both sides.
    """
    sizes = np.zeros((2, block), np.int64)
    for sides in cell:
        for k, codes in enumerate(sides):
            sizes[k, codes % block] = codes // block
    places = [(a % block, b % block) for a, b in cell]
    if 4 * sum(len(a) * len(b) for a, b in places) < block * block:
        keys, n = np.unique(np.concatenate([(a[:, None] * block + b).ravel() for a, b in places]), return_counts=True)
        x, y = keys // block, keys % block
        sim = n / (sizes[0, x] + sizes[1, y] - n)
        kept = sim > least[x]
        if same:
            kept &= x != y
        return np.stack([x[kept], y[kept], sim[kept]])
    shared = np.zeros((block, block), np.int32)
    for a, b in places:
        shared[a[:, None], b] += 1
    if same:
        np.fill_diagonal(shared, 0)
    # Entities outside the cell have size 0 and share nothing; their quotient is of no use.
    sim = shared / np.maximum(sizes[0][:, None] + sizes[1] - shared, 1)
    floor = np.partition(sim, block - m, axis=1)[:, block - m] if m < block else np.zeros(block)
    x, y = np.nonzero((sim > least[:, None]) & (sim >= floor[:, None]))
    return np.stack([x, y, sim[x, y]])


def best_met(batches: Iterator[pa.RecordBatch], m: int, block: int) -> Iterator[pa.RecordBatch]:
    """The top lists of whole blocks of entities, from cells in the order of (bx, by)."""
    kept, least = np.zeros((3, 0)), np.zeros(block)

    def told(bx: int) -> pa.RecordBatch:
        x, y, sim = kept
        starts = np.searchsorted(x, x)
        made = [pa.array(bx * block + x.astype(np.int64)), pa.array(y.astype(np.int64)), pa.array(sim), pa.array((np.arange(len(x)) - starts + 1).astype(np.int32))]
        return pa.RecordBatch.from_arrays(made, ["x", "y", "sim", "rank"])

    def closed(bx: int, by: int, cell: list) -> None:
        nonlocal kept, least
        new = met(cell, bx == by, least, m, block)
        new[1] += by * block
        rows = np.concatenate([kept, new], axis=1)
        rows = rows[:, np.lexsort((rows[1], -rows[2], rows[0]))]
        place = np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0])
        kept = rows[:, place < m]
        least = np.zeros(block)
        last = place[place < m] == m - 1
        least[kept[0, last].astype(int)] = kept[2, last]

    at, cell = None, []
    for batch in filter(len, batches):
        keys = zip(batch.column("bx").to_pylist(), batch.column("by").to_pylist(), strict=True)
        for key, a, b in zip(keys, lists(batch.column("px")), lists(batch.column("py")), strict=True):
            if at is not None and key != at:
                closed(*at, cell)
                cell = []
                if key[0] != at[0]:
                    yield told(at[0])
                    kept, least = np.zeros((3, 0)), np.zeros(block)
            at = key
            cell.append((a, b))
    if at is not None:
        closed(*at, cell)
        yield told(at[0])


def top_by_tokens(sets: DataFrame, m: int = TOP, block: int = BLOCK, parts: int = PARTS) -> DataFrame:
    """``top_similar`` of the ``token_similarity`` of ``sets(entity, token)``, without a row
    for each two entities that meet: (x, y, sim, rank).

    Entities are numbered in their order and cut into blocks; a token's entities are one
    list for each block.  Two blocks that share a token make a cell, whose shared tokens are
    counted in a table of ``block`` by ``block`` numbers; the cells of a block come one after
    the other, and its top lists are all that stays of them.  What is shuffled grows with
    lists and not with entities that meet.
    """
    rows = sets.distinct()
    sizes = rows.where("entity is not null").groupBy("entity").agg(F.count("*").alias("size"))
    ranges = 1 + sizes.count() // (16 * block)
    entities = saved(sizes.repartitionByRange(ranges, "entity").sortWithinPartitions("entity").select("entity", "size", F.monotonically_increasing_id().alias("id")))
    code = (F.col("size") * block + F.col("id") % block).alias("code")
    by_block = rows.where("token is not null").join(entities, "entity").select("token", F.floor(F.col("id") / block).alias("b"), code).groupBy("token", "b").agg(F.collect_list("code").alias("p"))
    # A token of very many blocks is dealt to several tasks.
    spread = by_block.groupBy("token").agg(F.ceil(F.count("*") / parts).cast("int").alias("parts"))
    tagged = by_block.join(spread, "token")
    left = tagged.select("token", F.col("b").alias("bx"), F.col("p").alias("px"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("salt"))
    right = tagged.select("token", F.col("b").alias("by"), F.col("p").alias("py"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    cells = left.join(right, ["token", "salt"]).select("bx", "by", "px", "py").repartition("bx").sortWithinPartitions("bx", "by")
    top = cells.mapInArrow(lambda batches: best_met(batches, m, block), "x long, y long, sim double, rank int")
    names = [entities.select(F.col("id").alias(c), F.col("entity").alias(f"name_{c}")) for c in "xy"]
    return top.join(names[0], "x").join(names[1], "y").select(F.col("name_x").alias("x"), F.col("name_y").alias("y"), "sim", "rank")


def neighbour_pairs(queries: DataFrame, train: DataFrame, near: DataFrame, k: int, total: bool = False, disjoint: bool = False) -> DataFrame:
    """The ``k`` train pairs most like each query pair: (pair_id, neighbour, score, rank).

    A query (a, b) meets a train pair (x, y) where x is near or equal to none of its
    ends but in the top list of one and y in that of the other; the score is the better
    of the two ways of pairing them (``total``: their sum), and is never rounded, as
    ranks follow from it.  ``disjoint`` leaves out
    pairs that share an entity.

    Both sides meet by (first end, end of a train pair): a query with the top list of its
    second end, and the first end with the train pairs of its top list, once for all the
    queries that it stands in.
    """
    s1 = near.select(F.col("x").alias("q1"), F.col("y").alias("t1"), F.col("sim").alias("s1"))
    s2 = near.select(F.col("x").alias("q2"), F.col("y").alias("t2"), F.col("sim").alias("s2"))
    ends = queries.select("pair_id", F.col("a_id").alias("q1"), F.col("b_id").alias("q2")).unionByName(queries.select("pair_id", F.col("b_id").alias("q1"), F.col("a_id").alias("q2")))
    edges = train.select(F.col("pair_id").alias("neighbour"), F.col("a_id").alias("t1"), F.col("b_id").alias("t2"), F.col("family").alias("n_family"))
    reach = s1.join(ends.select("q1").distinct(), "q1", "left_semi").join(edges, "t1")
    hits = ends.join(s2, "q2").join(reach, ["q1", "t2"]).where(F.col("pair_id") != F.col("neighbour"))
    if disjoint:
        hits = hits.where((F.col("t1") != F.col("q2")) & (F.col("t2") != F.col("q1")))
    value = F.col("s1") * F.col("s2")
    by = hits.groupBy("pair_id", "neighbour", "n_family").agg((F.sum(value) if total else F.max(value)).alias("score")).where("score > 0")
    w = Window.partitionBy("pair_id").orderBy(F.desc("score"), "neighbour")
    return by.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def precision_at(neighbours: DataFrame, gold: DataFrame, cuts: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """By family and over all: mean share of neighbours of the gold family at each cut."""
    rows = neighbours.join(gold.select("pair_id", "family"), "pair_id").withColumn("k", F.explode(F.array(*map(F.lit, cuts)))).where("rank <= k")
    per = rows.groupBy("pair_id", "family", "k").agg(F.avg((F.col("n_family") == F.col("family")).cast("double")).alias("p"))
    return per.groupingSets([["k"], ["family", "k"]], "family", "k").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("precision"))


def shared_tokens(pairs: DataFrame, sets: DataFrame, cap: int = 8) -> DataFrame:
    """(pair_id, shared, only_a, only_b): tokens of both ends and of one only, the first
    ``cap`` of each in order."""
    own = sets.distinct()
    ends = pairs.select("pair_id", F.col("a_id").alias("entity"), F.lit(1).alias("side")).unionByName(pairs.select("pair_id", F.col("b_id").alias("entity"), F.lit(2).alias("side")))
    marks = ends.join(own, "entity").groupBy("pair_id", "token").agg(F.sum("side").alias("m"))
    w = Window.partitionBy("pair_id", "m").orderBy("token")
    kept = marks.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap)

    def listed(m: int, name: str):
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("m") == m, F.col("token")))), ",").alias(name)

    return kept.groupBy("pair_id").agg(listed(3, "shared"), listed(1, "only_a"), listed(2, "only_b"))


def bit_tanimoto(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Tanimoto of on-bit lists ``bits(entity, on)``; null where an end has none."""
    a, b = (bits.select(F.col("entity").alias(f"{c}_id"), F.col("on").alias(f"on_{c}")) for c in "ab")
    both = F.size(F.array_intersect("on_a", "on_b"))
    return pairs.select("pair_id", "a_id", "b_id").join(a, "a_id", "left").join(b, "b_id", "left").select(
        "pair_id", F.round(F.when(F.col("on_a").isNotNull() & F.col("on_b").isNotNull(), both / (F.size("on_a") + F.size("on_b") - both)), 6).alias("tanimoto"))


def coverage_tiers(features: DataFrame) -> DataFrame:
    """Pairs by the first similarity that is there: pathway, protein, structure, code, none."""
    tier = F.when(F.col("pathway").isNotNull(), "pathway").when(F.col("protein").isNotNull(), "protein").when(F.col("structure").isNotNull(), "structure").when(F.col("depth") > 0, "code").otherwise("none")
    return features.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


def histogram(features: DataFrame, part: str, whole: str, bins: int = 10) -> DataFrame:
    """Counts of ``part / whole`` in equal bins of 0 to 1 (one goes to the last bin), nulls
    apart; bins are told by whole numbers, so no quotient is rounded first."""
    place = F.floor(bins * F.col(part) / F.col(whole))
    b = F.when(place.isNotNull(), F.least(F.lit(bins - 1), place)).cast("int")  # least() passes over nulls
    return features.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
