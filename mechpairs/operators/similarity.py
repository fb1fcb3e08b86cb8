"""Set similarity, code prefixes and triangles over entity pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_jaccard(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Jaccard, shared and united count for given pairs; null if a set is missing.

    ``sets(entity, token)`` is packed to one array for each entity first, so each
    pair costs two lookups and no token is ever a join key.
    """
    packed = sets.groupBy("entity").agg(F.collect_set("token").alias("t"))
    a = packed.select(F.col("entity").alias("a_id"), F.col("t").alias("ta"))
    b = packed.select(F.col("entity").alias("b_id"), F.col("t").alias("tb"))
    shared = F.size(F.array_intersect("ta", "tb"))
    return pairs.select("pair_id", "a_id", "b_id").join(a, "a_id", "left").join(b, "b_id", "left").select(
        "pair_id", F.when(F.col("ta").isNotNull() & F.col("tb").isNotNull(), shared).alias("shared"),
        F.round(shared / (F.size("ta") + F.size("tb") - shared), 6).alias("jaccard"), (F.size("ta") + F.size("tb") - shared).alias("united"),
    )


def prefix_depth(pairs: DataFrame, codes: DataFrame, longest: int = 7) -> DataFrame:
    """Longest common prefix over the codes of both ends, at most ``longest``."""
    prefixes = codes.select("entity", F.explode(F.transform(
        F.sequence(F.lit(1), F.least(F.length("code"), F.lit(longest))), lambda k: F.substring(F.col("code"), F.lit(1), k)
    )).alias("prefix")).distinct()
    packed = prefixes.groupBy("entity").agg(F.collect_set("prefix").alias("p"))
    a = packed.select(F.col("entity").alias("a_id"), F.col("p").alias("pa"))
    b = packed.select(F.col("entity").alias("b_id"), F.col("p").alias("pb"))
    common = F.array_max(F.transform(F.array_intersect("pa", "pb"), F.length))
    return pairs.select("pair_id", "a_id", "b_id").join(a, "a_id", "left").join(b, "b_id", "left").select(
        "pair_id", F.coalesce(common, F.lit(0)).alias("depth")
    )


def triangles(labels: DataFrame) -> DataFrame:
    """Triples of entities with three labelled pairs of which two agree in family.

    Edges run from the end with fewer labelled pairs to the one with more, so a
    hub never opens all pairs of its neighbours.
    """
    edges = labels.where("family <> 'Other'").select("a_id", "b_id", "family")
    degree = edges.select(F.explode(F.array("a_id", "b_id")).alias("e")).groupBy("e").agg(F.count("*").alias("d"))
    ranked = edges.join(degree.select(F.col("e").alias("a_id"), F.col("d").alias("da")), "a_id").join(
        degree.select(F.col("e").alias("b_id"), F.col("d").alias("db")), "b_id"
    )
    lower = F.struct("da", "a_id") < F.struct("db", "b_id")
    e = ranked.select(
        F.when(lower, F.col("a_id")).otherwise(F.col("b_id")).alias("u"), F.when(lower, F.col("b_id")).otherwise(F.col("a_id")).alias("v"), "family"
    )
    e1, e2 = (e.select("u", F.col("v").alias(f"v{k}"), F.col("family").alias(f"f{k}")) for k in (1, 2))
    wedges = e1.join(e2, "u").where("v1 < v2")
    closed = wedges.join(
        edges.select(F.col("a_id").alias("v1"), F.col("b_id").alias("v2"), F.col("family").alias("f3")), ["v1", "v2"]
    )
    agree = (F.col("f1") == F.col("f2")) | (F.col("f1") == F.col("f3")) | (F.col("f2") == F.col("f3"))
    top = F.when((F.col("f1") == F.col("f2")) | (F.col("f1") == F.col("f3")), F.col("f1")).otherwise(F.col("f2"))
    ids = F.array_sort(F.array("u", "v1", "v2"))
    return closed.where(agree).select(
        F.get(ids, F.lit(0)).alias("x"), F.get(ids, F.lit(1)).alias("y"), F.get(ids, F.lit(2)).alias("z"), top.alias("family"),
        F.when((F.col("f1") == F.col("f2")) & (F.col("f1") == F.col("f3")), 3).otherwise(2).alias("n_agree"),
    )


def top_by(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)
