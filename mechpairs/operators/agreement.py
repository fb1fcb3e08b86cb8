"""Agreement of votes and of paired predictions; resampled accuracies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vote_entropy(candidates: DataFrame) -> DataFrame:
    """Shannon entropy (nats) of the families voted for, for each pair."""
    votes = candidates.groupBy("pair_id", "cand_family").agg(F.count("*").alias("n"))
    terms = votes.groupBy("pair_id").agg(F.sum("n").alias("n_votes"), F.count("*").alias("n_families"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    return terms.select("pair_id", "n_votes", "n_families", F.abs(F.round(F.ln("n_votes") - F.col("s") / F.col("n_votes"), 6)).alias("entropy"))


def tiers(candidates: DataFrame, labels: DataFrame | None = None, floor: float = 0.3) -> DataFrame:
    """Number of candidates of each tier: gates first, then the gold family; without
    ``labels`` the candidates carry it."""
    right = F.col("cand_family") == F.col("family")
    tier = (
        F.when(~F.col("passed"), "drop").when(right & (F.col("score") >= floor), "full_correct")
        .when(right, "family_correct").otherwise("near_miss")
    )
    joined = candidates if labels is None else candidates.join(labels.select("pair_id", "family"), "pair_id")
    return joined.groupBy("family", tier.alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def mcnemar(scored: DataFrame) -> DataFrame:
    """Discordant pairs of the two presentation orders and the statistic with
    continuity correction; null without any."""
    ok = F.coalesce(F.col("pred_family") == F.col("family"), F.lit(False)) & ~F.col("abstain")
    sides = scored.groupBy("pair_id", "family").agg(
        F.bool_or(ok & (F.col("input_order") == "ab")).alias("x"), F.bool_or(ok & (F.col("input_order") == "ba")).alias("y")
    )
    cells = sides.groupBy("family").agg(
        F.count_if(F.col("x") & F.col("y")).alias("both"), F.count_if(F.col("x") & ~F.col("y")).alias("only_ab"),
        F.count_if(~F.col("x") & F.col("y")).alias("only_ba"), F.count_if(~F.col("x") & ~F.col("y")).alias("neither"),
    )
    apart = F.col("only_ab") + F.col("only_ba")
    gap = F.greatest(F.abs(F.col("only_ab") - F.col("only_ba")) - 1, F.lit(0))
    return cells.withColumn("statistic", F.round(F.when(apart > 0, gap * gap / apart), 6))


def poisson_weight(key: Column) -> Column:
    """Poisson(1) weight of a row from a digest, cut at 4."""
    u = F.conv(F.substring(F.md5(key.cast("binary")), 1, 6), 16, 10).cast("long")
    out = F.lit(4)
    for weight, edge in ((3, 16458488), (2, 15429833), (1, 12343867), (0, 6171934)):
        out = F.when(u < edge, weight).otherwise(out)
    return out


def bootstrap_accuracy(scored: DataFrame, rounds: int = 20) -> DataFrame:
    """Accuracy of each family in each resample.

    Every row draws its own weights from its key, so resamples need no sampling
    with replacement and no shuffle but that of the sums.
    """
    drawn = scored.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn(
        "w", poisson_weight(F.concat_ws("|", "pair_id", F.col("round").cast("string")))
    )
    ok = F.coalesce(F.col("pred_family") == F.col("family"), F.lit(False)) & ~F.col("abstain")
    return drawn.groupBy("family", "round").agg(F.sum("w").alias("n"), F.sum(F.when(ok, F.col("w")).otherwise(0)).alias("hit")).select(
        "family", "round", "n", F.round(F.when(F.col("n") > 0, F.col("hit") / F.col("n")), 6).alias("accuracy")
    )


def top_subtypes(labels: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent subtypes of each family."""
    counted = labels.groupBy("family", "subtype").agg(F.count("*").alias("n"))
    ranked = counted.groupBy("family").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "subtype"))), 1, n).alias("top"))
    return ranked.select("family", F.posexplode("top").alias("pos", "t")).select("family", F.col("t.subtype").alias("subtype"), (-F.col("t.m")).alias("n"), (F.col("pos") + 1).alias("rank"))
