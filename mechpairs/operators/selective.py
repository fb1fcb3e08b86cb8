"""Selective prediction: thresholds and accuracies at stated coverages.

Confidences are grouped to their distinct values first, so the running sums work
on those and not on single predictions.  All of a tie is kept or none of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import running


def levels(scored: DataFrame, by: list[str]) -> DataFrame:
    """(by, confidence, kept, right, total): running counts from the highest
    confidence down, over the predictions that do not abstain."""
    steps = (
        scored.where("not abstain and confidence is not null").groupBy(*by, "confidence")
        .agg(F.count("*").alias("n"), F.count_if(F.col("pred_family") == F.col("family")).alias("r"))
    )
    whole = steps.groupBy(*by).agg(F.sum("n").alias("total"))
    return running(steps, "confidence", ["n", "r"], by).join(whole, by or F.lit(True)).select(
        *by, "confidence", F.col("n_upto").alias("kept"), F.col("r_upto").alias("right"), "total"
    )


def at_coverage(scored: DataFrame, shares: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95)) -> DataFrame:
    """Highest confidence that keeps at least each share of the predictions of a
    family, and the accuracy of what it keeps."""
    wanted = levels(scored, ["family"]).withColumn("coverage", F.explode(F.array(*map(F.lit, shares)))).where("kept >= coverage * total")
    best = wanted.groupBy("family", "coverage").agg(F.max_by(F.struct("confidence", "kept", "right"), "confidence").alias("b"))
    return best.select("family", "coverage", F.col("b.confidence").alias("threshold"), F.col("b.kept").alias("kept"), F.round(F.col("b.right") / F.col("b.kept"), 6).alias("accuracy"))


def family_thresholds(scored: DataFrame, accuracy: float = 0.7, coverage: float = 0.3) -> DataFrame:
    """Lowest confidence of each family with the accuracy and the coverage asked
    for; where none has both, the highest that keeps the coverage."""
    rows = levels(scored, ["family"])
    good = (F.col("right") >= accuracy * F.col("kept")) & (F.col("kept") >= coverage * F.col("total"))
    return (
        rows.groupBy("family").agg(
            F.min(F.when(good, F.col("confidence"))).alias("low"),
            F.max(F.when(F.col("kept") >= coverage * F.col("total"), F.col("confidence"))).alias("high"),
        )
        .select("family", F.coalesce("low", "high").alias("threshold"), F.col("low").isNotNull().alias("met"))
    )


def area_under_risk(scored: DataFrame) -> DataFrame:
    """Area under the risk-coverage curve of each family, by trapezoids from (0, 0)."""
    rows = levels(scored, ["family"]).select(
        "family", "confidence", (F.col("kept") / F.col("total")).alias("x"), (1 - F.col("right") / F.col("kept")).alias("y")
    )
    down = Window.partitionBy("family").orderBy(F.desc("confidence"))
    area = (F.col("x") - F.coalesce(F.lag("x").over(down), F.lit(0.0))) * (F.col("y") + F.coalesce(F.lag("y").over(down), F.lit(0.0))) / 2
    return rows.withColumn("area", area).groupBy("family").agg(F.round(F.sum("area"), 6).alias("aurc"))


def rescue_list(scored: DataFrame, below: float, budget: int) -> DataFrame:
    """The least confident predictions under a threshold, at most ``budget`` of them."""
    return (
        scored.where(F.col("confidence") < below).select("pair_id", "family", "pred_family", "confidence")
        .orderBy("confidence", "pair_id").limit(budget)
    )


def quantile_thresholds(rows: DataFrame, score: str, right: str, shares: tuple[float, ...], keep_high: bool, max_drop: float = 0.1) -> DataFrame:
    """Best of the thresholds at the given percentiles of ``score``: largest gain in
    accuracy over no gate among those that drop at most ``max_drop`` of the rows; the
    first percentile on a tie.  With ``keep_high`` a threshold lies half way to the next
    distinct value and rows at or above stay, otherwise rows at or below a value stay.

    One row (threshold, coverage, accuracy, baseline), of nulls if no threshold fits.
    """
    shares = tuple(dict.fromkeys(shares))
    by = rows.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(right).alias("r"))
    whole = by.agg(F.sum("n").alias("n_all"), F.sum("r").alias("r_all"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    # Scores are moved into 0 to 1, so that running totals spread over ranges.
    spread = F.when(F.col("hi") > F.col("lo"), (F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    steps = running(by.join(whole, F.lit(True)).withColumn("unit", spread), "unit", ["n", "r"])
    below, below_r = F.col("n_all") - F.col("n_upto"), F.col("r_all") - F.col("r_upto")
    at = steps.withColumns({"below": below, "below_r": below_r}).withColumn("p", F.explode(F.array(*map(F.lit, shares)))).withColumn(
        "at", F.greatest(F.lit(0), F.least(F.col("n_all") - 1, (F.col("p") * F.col("n_all")).cast("long")))
    ).where("below <= at and at < below + n")
    if keep_high:
        # One row with the scores met, at most one for each share, beside every distinct score.
        met = at.agg(F.map_from_entries(F.collect_list(F.struct("p", "s"))).alias("met"))
        nexts = [F.struct(F.lit(p).alias("p"), F.min(F.when(F.col("s") > F.try_element_at("met", F.lit(p)), F.col("s"))).alias("next")) for p in shares]
        above = steps.select("s").join(met, F.lit(True)).agg(F.array(*nexts).alias("x")).select(F.inline("x"))
        at = at.join(above, "p").withColumns({
            "t": F.when(F.col("next").isNotNull(), (F.col("s") + F.col("next")) / 2).otherwise(F.col("s") + 1e-6),
            "kept": F.col("n_upto") - F.col("n"), "hit": F.col("r_upto") - F.col("r"),
        })
    else:
        at = at.withColumns({"t": F.col("s"), "kept": F.col("below") + F.col("n"), "hit": F.col("below_r") + F.col("r")})
    fits = at.where(F.col("kept") > 0).where(1.0 - F.col("kept") / F.col("n_all") <= max_drop)
    gain = F.col("hit") / F.col("kept") - F.col("r_all") / F.col("n_all")
    return fits.agg(F.max_by(F.struct("t", "kept", "hit", "n_all", "r_all"), F.struct(gain, -F.col("p"))).alias("b")).select(
        F.col("b.t").alias("threshold"), F.round(F.col("b.kept") / F.col("b.n_all"), 6).alias("coverage"), F.round(F.col("b.hit") / F.col("b.kept"), 6).alias("accuracy"),
        F.round(F.col("b.r_all") / F.col("b.n_all"), 6).alias("baseline"),
    )


def calibrated(scored: DataFrame, accuracy: float, coverage: float = 0.5, least: int = 10) -> DataFrame:
    """Threshold for each predicted family and over all (family null): the end of the
    first run, from the highest score down and from ``coverage`` on, that has the
    accuracy; else the lowest that has it with ``least`` rows; else the median.  Over
    all, the lowest that has both, else the median."""
    def pick(by: list[str]) -> DataFrame:
        rows = predicted_levels(scored, by)
        ok, wide = F.col("right") >= accuracy * F.col("kept"), F.col("kept") >= coverage * F.col("total")
        first = rows.groupBy(*by).agg(F.max(F.when(ok & wide, F.col("confidence"))).alias("start"))
        rows = rows.join(first, by or F.lit(True))
        stop = rows.where(wide & ~ok & (F.col("confidence") < F.col("start"))).groupBy(*by).agg(F.max("confidence").alias("stop"))
        rows = rows.join(stop, by or F.lit(True), "left")
        run = ok & wide & (F.coalesce(F.col("confidence") > F.col("stop"), F.lit(True)) if by else F.lit(True))
        return rows.groupBy(*by).agg(
            F.min(F.when(run, F.col("confidence"))).alias("normal"), F.min(F.when(ok & (F.col("kept") >= least), F.col("confidence"))).alias("relaxed"),
            F.max(F.when(F.col("kept") >= F.col("total") - F.floor(F.col("total") / 2), F.col("confidence"))).alias("median"),
        )

    fam = pick(["family"]).select(
        "family", F.coalesce("normal", "relaxed", "median").alias("tau"),
        F.when(F.col("normal").isNotNull(), "none").when(F.col("relaxed").isNotNull(), "relaxed_coverage").otherwise("median_unreachable").alias("fallback"),
    )
    whole = pick([]).select(F.lit(None).cast("string").alias("family"), F.coalesce("normal", "median").alias("tau"), F.when(F.col("normal").isNotNull(), "none").otherwise("median_unreachable").alias("fallback"))
    return fam.unionByName(whole)


def predicted_levels(scored: DataFrame, by: list[str]) -> DataFrame:
    """As ``levels``, by predicted family (or over all) and abstentions included."""
    known = scored.where("confidence is not null and pred_family is not null").select(
        F.col("pred_family").alias("family"), "confidence", (F.col("pred_family") == F.col("family")).alias("ok")
    )
    steps = known.groupBy(*by, "confidence").agg(F.count("*").alias("n"), F.count_if("ok").alias("r"))
    whole = steps.groupBy(*by).agg(F.sum("n").alias("total"))
    return running(steps, "confidence", ["n", "r"], by).join(whole, by or F.lit(True)).select(
        *by, "confidence", F.col("n_upto").alias("kept"), F.col("r_upto").alias("right"), "total"
    )


def gated(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Predictions that abstain below the threshold of their predicted family (of all, if
    it has none) or without a score."""
    named = thresholds.select(F.col("family").alias("pred_family"), "tau")
    glob = thresholds.where("family is null").agg(F.max("tau").alias("rest"))
    rows = scored.join(named.where("pred_family is not null"), "pred_family", "left").join(glob, F.lit(True))
    low = F.col("confidence").isNull() | (F.col("confidence") < F.coalesce("tau", "rest"))
    return rows.select("pair_id", "family", "pred_family", "confidence", low.alias("abstain"))


def decisions(rows: DataFrame, confidence: float, entropy: float | None, prm: float | None) -> DataFrame:
    """(pair_id, abstain, reasons): abstain when any gate fails; ``rows(pair_id,
    confidence, entropy, prm)``; a null prm passes."""
    gates = [F.when(F.col("confidence") < confidence, "confidence")]
    if entropy is not None:
        gates.append(F.when(F.col("entropy") > entropy, "entropy"))
    if prm is not None:
        gates.append(F.when(F.col("prm") < prm, "prm"))
    reasons = F.filter(F.array(*gates), F.isnotnull)
    return rows.select("pair_id", (F.size(reasons) > 0).alias("abstain"), F.array_join(reasons, ",").alias("reasons"))


def deciles(rows: DataFrame, by: str, value: str, n: int = 10) -> DataFrame:
    """Mean of ``value`` in ``n`` ranges of ``by`` with about equal counts, cut between
    distinct values: range k ends where the running count passes k / n of all."""
    steps = rows.groupBy(F.col(by).alias("x")).agg(F.count("*").alias("c"), F.sum(value).alias("v"))
    whole = steps.agg(F.sum("c").alias("all"), F.max("x").alias("hi"))
    placed = running(steps.join(whole, F.lit(True)).withColumn("unit", F.col("x") / F.greatest(F.col("hi"), F.lit(1))), "unit", ["c"])
    part = F.least(F.lit(n - 1), F.floor((F.col("all") - F.col("c_upto")) * n / F.col("all"))).cast("int")
    return placed.groupBy(part.alias("part")).agg(F.sum("c").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.round(F.sum("v") / F.sum("c"), 6).alias("mean"))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns, ties at their mean rank."""
    def ranks(c: str) -> DataFrame:
        steps = rows.groupBy(F.col(c).alias("x")).agg(F.count("*").alias("c"))
        whole = steps.agg(F.sum("c").alias("all"), F.max("x").alias("hi"), F.min("x").alias("lo"))
        unit = F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
        done = running(steps.join(whole, F.lit(True)).withColumn("unit", unit), "unit", ["c"])
        return done.select(F.col("x").alias(c), (F.col("all") - F.col("c_upto") + (F.col("c") + 1) / 2).alias(f"_r_{c}"))

    both = rows.select(a, b).join(ranks(a), a).join(ranks(b), b)
    return both.agg(F.count("*").alias("n"), F.round(F.corr(f"_r_{a}", f"_r_{b}"), 5).alias("rho"))
