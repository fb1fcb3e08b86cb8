"""Leakage-safe splits and their audits.

Random choices are the order of ``md5(seed|key)``, the same in every run and
under any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARES = (0.8, 0.1)


def hash_key(seed: str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *keys).cast("binary"))


def hash_rank(rows: DataFrame, key: str, group: list[str], seed: str) -> DataFrame:
    """Adds ``_rank`` (from 1, in hash order) and ``_n`` within each group.

    Ranks are made inside 4096 hash buckets and moved up by the sizes of the
    buckets before, so no group is sorted in one task.
    """
    # As bytes a digest sorts as its text does and is half as long.
    h = hash_key(seed, F.col(key))
    tagged = rows.withColumn("_h", h).withColumn("_bucket", F.substring("_h", 1, 3)).withColumn("_h", F.unhex("_h"))
    sizes = tagged.groupBy(*group, "_bucket").agg(F.count("*").alias("_size"))
    by = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.sum("_size").over(by.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*group, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(by).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy("_h", key))
    return (
        tagged.withColumn("_inside", inside).join(offsets, [*group, "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_inside")).drop("_h", "_bucket", "_inside", "_before")
    )


def ranked_split(rows: DataFrame, key: str, stratum: str | None, seed: str, name: str) -> DataFrame:
    """``rows`` with train, val or test by rank in hash order within a stratum.

    Train and val get floor(n * share) rows, test the rest.
    """
    ranked = hash_rank(rows, key, [stratum] if stratum else [], seed)
    train, val = F.floor(F.col("_n") * SHARES[0]), F.floor(F.col("_n") * SHARES[1])
    section = F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= train + val, "val").otherwise("test")
    return ranked.withColumn(name, section).drop("_rank", "_n")


def random_split(labels: DataFrame, seed: str = "split-1") -> DataFrame:
    """Stratified by family."""
    return ranked_split(labels.where("family <> 'Other'"), "pair_id", "family", seed, "split").select("pair_id", "family", "split")


def entity_parts(labels: DataFrame, seed: str = "split-2") -> DataFrame:
    ends = labels.select(F.explode(F.array("a_id", "b_id")).alias("entity")).distinct()
    return ranked_split(ends, "entity", None, seed, "part")


def with_parts(labels: DataFrame, parts: DataFrame) -> DataFrame:
    a = parts.select(F.col("entity").alias("a_id"), F.col("part").alias("pa"))
    b = parts.select(F.col("entity").alias("b_id"), F.col("part").alias("pb"))
    return labels.where("family <> 'Other'").join(a, "a_id").join(b, "b_id")


def entity_cold_split(labels: DataFrame, parts: DataFrame) -> DataFrame:
    """Both ends train: train; an end in test: test; otherwise val."""
    return with_parts(labels, parts).select("pair_id", "family", cold_section().alias("split"))


def cold_section() -> Column:
    """The section of ``entity_cold_split`` by the parts of both ends."""
    return (
        F.when((F.col("pa") == "train") & (F.col("pb") == "train"), "train")
        .when((F.col("pa") == "test") | (F.col("pb") == "test"), "test").otherwise("val")
    )


def pair_cold_split(labels: DataFrame, parts: DataFrame) -> DataFrame:
    """Both ends in one part; other pairs are left out."""
    return with_parts(labels, parts).where("pa = pb").select("pair_id", "family", F.col("pa").alias("split"))


def safe_subset(labels: DataFrame, splits: list[DataFrame], size: int, seed: str = "split-3") -> DataFrame:
    """Pairs in the train section of all splits, by family quota of ``size``."""
    common = labels.select("pair_id", "family")
    for s in splits:
        common = common.join(s.where("split = 'train'").select("pair_id"), "pair_id", "left_semi")
    counts = common.groupBy("family").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = F.floor(F.lit(float(size)) * F.col("n") / F.col("total"))
    quota = counts.join(total, F.lit(True)).select("family", F.greatest(F.lit(1), share).alias("quota"))
    return (
        hash_rank(common, "pair_id", ["family"], seed).join(quota, "family")
        .where("_rank <= quota").select("pair_id", "family")
    )


def split_audit(labels: DataFrame, split: DataFrame) -> DataFrame:
    """For each section: pairs, entities, and those also in the train section."""
    ends = (
        labels.join(split.select("pair_id", "split"), "pair_id")
        .select("pair_id", "split", F.explode(F.array("a_id", "b_id")).alias("entity"))
    )
    flags = ends.groupBy("entity", "split").agg(F.count("*").alias("n")).withColumn(
        "in_train", F.max((F.col("split") == "train").cast("int")).over(Window.partitionBy("entity"))
    )
    entities = flags.groupBy("split").agg(F.count("*").alias("n_entities"), F.sum("in_train").alias("n_also_train"))
    pairs = split.groupBy("split").agg(F.count("*").alias("n_pairs"))
    return pairs.join(entities, "split")


def endpoint_coverage(labels: DataFrame, split: DataFrame) -> DataFrame:
    """Train pairs at both ends of each test pair: least, largest and sum."""
    rows = labels.join(split.select("pair_id", "split"), "pair_id")
    degree = rows.where("split = 'train'").select(F.explode(F.array("a_id", "b_id")).alias("entity")).groupBy("entity").agg(F.count("*").alias("d"))
    a = degree.select(F.col("entity").alias("a_id"), F.col("d").alias("da"))
    b = degree.select(F.col("entity").alias("b_id"), F.col("d").alias("db"))
    da, db = F.coalesce("da", F.lit(0)), F.coalesce("db", F.lit(0))
    return rows.where("split = 'test'").join(a, "a_id", "left").join(b, "b_id", "left").select(
        "pair_id", F.least(da, db).alias("cov_min"), F.greatest(da, db).alias("cov_max"), (da + db).alias("cov_sum")
    )


def overlap(a: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """(name, n): pairs of ``a`` that each other set holds; all zero without leakage."""
    parts = [a.join(s.select("pair_id").distinct(), "pair_id", "left_semi").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, s in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quotas(counts: DataFrame, size: int, mode: str = "sqrt_inverse") -> DataFrame:
    """(family, quota) of a sample of ``size`` rows: balanced, proportional or by inverse
    square roots; at most what a family has, and what rounding leaves over goes round
    the families with most room (it stays open where all are full)."""
    n, k = F.col("n"), F.col("k")
    weight = {"balanced": F.lit(1.0), "proportional": n.cast("double"), "sqrt_inverse": 1 / F.sqrt(n)}[mode]
    rows = counts.withColumn("w", weight)
    whole = rows.agg(F.sum("w").alias("w_all"), F.count("*").alias("k"))
    first = F.floor(F.lit(size) / k) if mode == "balanced" else F.bround(F.lit(float(size)) * F.col("w") / F.col("w_all"))
    start = rows.join(whole, F.lit(True)).withColumn("q", F.least(n, first.cast("long")))
    left = start.agg((F.lit(size) - F.sum("q")).alias("left"))
    seats = start.join(left, F.lit(True)).withColumn("head", n - F.col("q"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("head"), "family")  # a row for each family
    ranked = seats.withColumn("turn", F.row_number().over(order))
    # Each round gives a seat to every family with room: seat s of a family comes at (s, turn).
    offered = ranked.where("left > 0 and head > 0").select("family", "turn", "left", F.explode(F.sequence(F.lit(1).cast("long"), F.least("head", "left"))).alias("s"))
    given = offered.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("s", "turn"))).where("place <= left").groupBy("family").agg(F.count("*").alias("extra"))
    taken = ranked.where("left < 0 and q > 0").select("family", "turn", "left", F.explode(F.sequence(F.lit(1).cast("long"), F.least("q", -F.col("left")))).alias("s"))
    lost = taken.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("s", "turn"))).where("place <= -left").groupBy("family").agg((-F.count("*")).alias("extra"))
    return ranked.join(given.unionByName(lost), "family", "left").select("family", "n", (F.col("q") + F.coalesce("extra", F.lit(0))).alias("quota"))


def quota_sample(labels: DataFrame, size: int, mode: str = "sqrt_inverse", seed: str = "quota-1") -> DataFrame:
    """Pairs drawn by ``quotas``, in hash order within their family."""
    rows = labels.where("family <> 'Other'").select("pair_id", "family")
    quota = quotas(rows.groupBy("family").agg(F.count("*").alias("n")), size, mode).select("family", "quota")
    return hash_rank(rows, "pair_id", ["family"], seed).join(quota, "family").where("_rank <= quota").select("pair_id", "family")


def cell_sample(rows: DataFrame, cell: list[str], n: int, seed: str = "cell-1") -> DataFrame:
    """At most ``n`` rows of each cell, in hash order of pair_id."""
    return hash_rank(rows, "pair_id", cell, seed).where(F.col("_rank") <= n).drop("_rank", "_n")


def stratum_split(rows: DataFrame, stratum: list[str], share: float = 0.1, seed: str = "val-1") -> DataFrame:
    """Rows with train or val: of each stratum with two rows or more, round(n * share)
    (halves to even), one at least and n - 1 at most, go to val."""
    ranked = hash_rank(rows, "pair_id", stratum, seed)
    n_val = F.when(F.col("_n") == 1, 0).otherwise(F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.bround(F.col("_n") * share).cast("long"))))
    return ranked.withColumn("part", F.when(F.col("_rank") <= n_val, "val").otherwise("train")).drop("_rank", "_n")


def halves(rows: DataFrame, seed: str = "half-1") -> DataFrame:
    """Rows with tune or hold: the first half in hash order is for tuning."""
    ranked = hash_rank(rows, "pair_id", [], seed)
    return ranked.withColumn("half", F.when(F.col("_rank") <= F.floor(F.col("_n") / 2), "tune").otherwise("hold")).drop("_rank", "_n")


def importance_sample(rows: DataFrame, weight: str = "weight", seed: str = "imp-1") -> DataFrame:
    """Rows kept with probability weight over the largest weight; never none of a
    table that has rows with weight: the first in hash order stays then."""
    u = F.conv(F.substring(hash_key(seed, F.col("pair_id")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    top = rows.agg(F.max(weight).alias("_top"), F.min_by("pair_id", F.struct(u, F.col("pair_id"))).alias("_one"))
    marked = rows.join(top, F.lit(True)).withColumn("_keep", (F.col(weight) > 0) & (u <= F.col(weight) / F.col("_top")))
    any_ = marked.agg(F.bool_or("_keep").alias("_any"))
    return marked.join(any_, F.lit(True)).where(F.col("_keep") | (~F.coalesce("_any", F.lit(False)) & (F.col("pair_id") == F.col("_one")))).select(*rows.columns)


def mirrored(rows: DataFrame) -> DataFrame:
    """Both presentation orders of directed rows (pair_id, direction, text_a, text_b)."""
    flip = F.when(F.col("direction") == "a_to_b", "b_to_a").when(F.col("direction") == "b_to_a", "a_to_b").otherwise(F.col("direction"))
    ab = rows.withColumn("input_order", F.lit("ab"))
    ba = rows.withColumns({"direction": flip, "text_a": F.col("text_b"), "text_b": F.col("text_a")}).withColumn("input_order", F.lit("ba"))
    return ab.unionByName(ba)
