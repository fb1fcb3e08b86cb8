"""Candidate ranking, voting and cross-source consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_of(candidates: DataFrame, keep: int = 1) -> DataFrame:
    """Candidates of a pair by gates passed, score and lowest number."""
    w = Window.partitionBy("pair_id").orderBy(F.desc("passed"), F.desc("score"), "candidate_id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def vote(candidates: DataFrame) -> DataFrame:
    """Majority and score-weighted family of each pair, with the vote margin.

    Ties go to the family seen at the lowest candidate number.
    """
    by = candidates.groupBy("pair_id", "cand_family").agg(
        F.count("*").alias("votes"), F.round(F.sum("score"), 6).alias("weight"), F.min("candidate_id").alias("first")
    )
    return by.groupBy("pair_id").agg(
        F.max_by("cand_family", F.struct("votes", -F.col("first"))).alias("majority"),
        F.max_by("cand_family", F.struct("weight", -F.col("first"))).alias("weighted"),
        F.max("votes").alias("top_votes"), F.sum("votes").alias("n_votes"),
    ).withColumn("share", F.round(F.col("top_votes") / F.col("n_votes"), 6))


def consensus_weight(candidates: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """Weight of a pair by the number of sources that agree with its family; without
    ``gold`` the candidates carry it."""
    rows = candidates if gold is None else candidates.join(gold.select("pair_id", "family"), "pair_id")
    k = rows.groupBy("pair_id").agg(
        F.count("*").alias("n_votes"), F.count_if(F.col("cand_family") == F.col("family")).alias("k_family")
    )
    raw = F.greatest(F.lit(0.0), 1 + 0.5 * (F.col("k_family") - 1))
    lone = (F.col("n_votes") >= 2) & (F.col("k_family") <= 1)
    return k.withColumn("weight", F.round(F.least(F.lit(2.5), F.when(lone, raw * 0.5).otherwise(raw)), 4))


def complete_pairs(candidates: DataFrame, wanted: int) -> DataFrame:
    """Pairs that have all their candidates; the rest is to be made again.  One row for
    each pair with an array ``candidates`` will do, and needs no grouping."""
    if "candidates" in candidates.columns:
        ids = F.filter(F.col("candidates")["candidate_id"], F.isnotnull)
        return candidates.select("pair_id", F.size(F.array_distinct(ids)).cast("long").alias("n")).withColumn("done", F.col("n") >= wanted)
    return candidates.groupBy("pair_id").agg(F.count_distinct("candidate_id").alias("n")).withColumn("done", F.col("n") >= wanted)
