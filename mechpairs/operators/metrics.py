"""Evaluation statistics.  Class metrics read confusion cells, never rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def cells(scored: DataFrame) -> DataFrame:
    """Counts by gold and predicted family; abstentions have prediction null."""
    pred = F.when(~F.col("abstain"), F.col("pred_family"))
    return scored.groupBy(F.col("family").alias("gold"), pred.alias("pred")).agg(F.count("*").alias("n"))


def class_report(conf: DataFrame, skip_abstained: bool = True) -> DataFrame:
    """Precision, recall, F1 and support of every gold family.

    Abstentions are left out, or count as misses.
    """
    rows = conf.where("pred is not null") if skip_abstained else conf
    gold = rows.groupBy("gold").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred = rows.where("pred is not null").groupBy(F.col("pred").alias("gold")).agg(F.sum("n").alias("predicted"))
    both = gold.join(pred, "gold", "left").na.fill(0, ["predicted"])
    precision, recall = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    f1 = 2 * F.col("tp") / (F.col("support") + F.col("predicted"))
    return both.select(
        F.col("gold").alias("family"), "support", F.round(F.coalesce(precision, F.lit(0.0)), 6).alias("prec"),
        F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"),
    )


def macro(report: DataFrame) -> DataFrame:
    return report.agg(
        F.round(F.avg("f1"), 5).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 5).alias("weighted_f1"),
        F.count("*").alias("n_families"),
    )


def mirror(scored: DataFrame) -> DataFrame:
    """One row for each pair that has both presentations, side by side."""
    cols = ["pred_family", "pred_direction", "direction", "abstain", "confidence"]
    sides = [F.max(F.when(F.col("input_order") == o, F.struct(*cols))).alias(o) for o in ("ab", "ba")]
    both = scored.groupBy("pair_id", "family").agg(*sides).where("ab is not null and ba is not null")
    return both.select("pair_id", "family", *(F.col(o)[c].alias(f"{c}_{o}") for o in ("ab", "ba") for c in cols))


def mirror_metrics(scored: DataFrame) -> DataFrame:
    """Symmetry of the two presentations, by family: both right, lift over
    independence, family consistency, direction right in both given family right
    in both, and stability without abstention."""
    ok = {o: (F.col(f"pred_family_{o}") == F.col("family")) & ~F.col(f"abstain_{o}") for o in ("ab", "ba")}
    both = ok["ab"] & ok["ba"]
    same = F.col("pred_family_ab") == F.col("pred_family_ba")
    turned = both & (F.col("pred_direction_ab") == F.col("direction_ab")) & (F.col("pred_direction_ba") == F.col("direction_ba"))
    n = F.count("*")
    return mirror(scored).groupBy("family").agg(
        n.alias("n"), F.round(F.count_if(both) / n, 6).alias("both_right"),
        F.round(F.count_if(both) / n - F.count_if(ok["ab"]) * F.count_if(ok["ba"]) / (n * n), 6).alias("lift"),
        F.round(F.count_if(same) / n, 6).alias("consistency"),
        F.round(ratio(F.count_if(turned), F.count_if(both)), 6).alias("direction_given_family"),
        F.round(F.count_if(same & ~F.col("abstain_ab") & ~F.col("abstain_ba")) / n, 6).alias("stability"),
    )


def abstention_utility(scored: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(right - alpha * wrong) / n, coverage and selective accuracy, overall
    (family null) and by family."""
    right = F.count_if(~F.col("abstain") & (F.col("pred_family") == F.col("family")))
    wrong = F.count_if(~F.col("abstain") & (F.col("pred_family") != F.col("family")))
    n = F.count("*")
    return scored.groupingSets([[], ["family"]], "family").agg(
        n.alias("n"), F.round((right - alpha * wrong) / n, 6).alias("utility"), F.round((right + wrong) / n, 6).alias("coverage"),
        F.round(ratio(right, right + wrong), 6).alias("selective_accuracy"),
    )


def running(rows: DataFrame, key: str, sums: list[str], by: list[str] | None = None, buckets: int = 1024) -> DataFrame:
    """``rows`` with ``<sum>_upto``: totals of ``sums`` over the rows whose ``key`` (a
    number, mostly from 0 to 1) is as high or higher.

    Running totals are made inside ranges of the key and moved up by the totals of the
    higher ranges, so no task sorts a whole group.
    """
    by = by or []
    slot = F.greatest(F.lit(0), F.least(F.lit(buckets), F.floor(F.col(key) * buckets))).cast("int")
    placed = rows.withColumn("_slot", slot)
    sizes = placed.groupBy(*by, "_slot").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    higher = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*by, "_slot", *(F.coalesce(F.sum(f"_{c}").over(higher), F.lit(0)).alias(f"_{c}") for c in sums))
    inside = Window.partitionBy(*by, "_slot").orderBy(F.desc(key))
    return placed.join(before, [*by, "_slot"]).select(*rows.columns, *((F.col(f"_{c}") + F.sum(c).over(inside)).alias(f"{c}_upto") for c in sums))


def risk_coverage(scored: DataFrame) -> DataFrame:
    """Coverage and accuracy at every distinct confidence, highest first.

    Rows are summed by confidence before the running totals, so what one window
    sees is the number of distinct confidences, not of rows.
    """
    by = scored.where(~F.col("abstain")).groupBy("confidence").agg(
        F.count("*").alias("n"), F.count_if(F.col("pred_family") == F.col("family")).alias("right")
    )
    return running(by, "confidence", ["n", "right"]).select(
        "confidence", F.col("n_upto").alias("kept"), F.col("right_upto").alias("right"),
    ).withColumn("accuracy", F.round(F.col("right") / F.col("kept"), 6))


def coverage_threshold(curve: DataFrame, floor: float) -> DataFrame:
    """Largest coverage whose selective accuracy reaches ``floor``."""
    return curve.where(F.col("accuracy") >= floor).agg(
        F.max_by("confidence", "kept").alias("threshold"), F.max("kept").alias("kept")
    )


def reliability(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Accuracy of each confidence bin and its distance from the bin centre;
    confidence 1 is outside the last bin."""
    b = F.floor(F.col("confidence") * bins).cast("int")
    return scored.where("not abstain and confidence < 1").groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("pred_family") == F.col("family")).cast("double")), 6).alias("accuracy")
    ).withColumn("gap", F.round(F.abs(F.col("accuracy") - (F.col("bin") + 0.5) / bins), 6))


def auroc(scored: DataFrame) -> DataFrame:
    """Rank-sum AUROC of confidence for being right, ties at their mean rank."""
    by = scored.groupBy("confidence").agg(F.count("*").alias("n"), F.count_if((F.col("pred_family") == F.col("family"))).alias("pos"))
    whole = by.agg(F.sum("n").alias("_all"))
    ranked = running(by, "confidence", ["n"]).join(whole, F.lit(True)).withColumn("rank", F.col("_all") - F.col("n_upto") + (F.col("n") + 1) / 2)
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ranked.agg(F.round((F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2) / (pos * neg), 6).alias("auroc"))


def gated_score(scored: DataFrame) -> DataFrame:
    """0 without the family, 0.3 with it, 0.7 with the subtype too, 1 with the
    direction too; mean by family."""
    ok = ~F.col("abstain") & (F.col("pred_family") == F.col("family"))
    level = F.when(~ok, 0.0).when(F.col("pred_subtype") != F.col("subtype"), 0.3).when(F.col("pred_direction") != F.col("direction"), 0.7).otherwise(1.0)
    return scored.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg(level), 6).alias("score"))


def additive_score(scored: DataFrame) -> DataFrame:
    """0.40 family + 0.30 subtype + 0.15 direction (directed or not) + 0.15 polarity, ungated."""
    def coarse(c: str) -> Column:
        return F.when(F.col(c).isin("a_to_b", "b_to_a"), "directed").otherwise(F.col(c))

    def part(c: Column, w: float) -> Column:
        return F.when(c, F.lit(w)).otherwise(F.lit(0.0))

    s = (
        part(F.col("pred_family") == F.col("family"), 0.40) + part(F.col("pred_subtype") == F.col("subtype"), 0.30)
        + part(coarse("pred_direction") == coarse("direction"), 0.15) + part(F.col("pred_polarity") == F.col("polarity"), 0.15)
    )
    return scored.groupBy("family").agg(F.round(F.avg(F.when(F.col("abstain"), F.lit(0.0)).otherwise(s)), 6).alias("score"))


def bias_ratio(scored: DataFrame) -> DataFrame:
    """Predicted over true count of each family."""
    gold = scored.groupBy("family").agg(F.count("*").alias("n_true"))
    pred = scored.where(~F.col("abstain")).groupBy(F.col("pred_family").alias("family")).agg(F.count("*").alias("n_pred"))
    return gold.join(pred, "family", "left").na.fill(0).withColumn("bias", F.round(F.col("n_pred") / F.col("n_true"), 6))


def class_weights(labels: DataFrame) -> DataFrame:
    """Inverse square root of the class size, scaled to mean 1 over rows."""
    by = labels.groupBy("family").agg(F.count("*").alias("n")).withColumn("w", 1 / F.sqrt("n"))
    whole = Window.partitionBy(F.lit(0))
    return by.select("family", "n", F.round(F.col("w") / (F.sum(F.col("w") * F.col("n")).over(whole) / F.sum("n").over(whole)), 6).alias("weight"))


def ece(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over all predictions, by bin centres; confidence 1 is
    outside the last bin but counts in the total."""
    b = F.floor(F.col("confidence") * bins).cast("int")
    ok = (F.col("pred_family") == F.col("family")).cast("double")
    cells_ = scored.groupBy(F.when(F.col("confidence") < 1, b).alias("bin")).agg(F.count("*").alias("n"), F.avg(ok).alias("acc"))
    gap = F.col("n") * F.abs(F.col("acc") - (F.col("bin") + 0.5) / bins)
    return cells_.agg(F.sum("n").alias("n"), F.round(F.sum(gap) / F.sum("n"), 6).alias("ece"))


def strict_report(scored: DataFrame) -> DataFrame:
    """Class report in which an abstention or an unknown family is a class of its own,
    counted as a miss of the gold family."""
    return class_report(cells(scored), skip_abstained=False)


def headline(scored: DataFrame, rare: int) -> DataFrame:
    """Macro, weighted and rare-family F1 (families with fewer than ``rare`` gold rows)
    under the strict rule."""
    r = strict_report(scored)
    return r.agg(
        F.round(F.avg("f1"), 5).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 5).alias("weighted_f1"),
        F.round(F.avg(F.when(F.col("support") < rare, F.col("f1"))), 5).alias("rare_macro_f1"),
    )


def subtype_report(scored: DataFrame) -> DataFrame:
    """Subtype accuracy, accuracy given the family, and macro and weighted subtype F1."""
    sub = F.when(~F.col("abstain"), F.col("pred_subtype"))
    ok, fam = F.coalesce(sub == F.col("subtype"), F.lit(False)), F.coalesce((F.col("pred_family") == F.col("family")) & ~F.col("abstain"), F.lit(False))
    acc = scored.agg(
        F.round(F.count_if(ok) / F.count("*"), 6).alias("accuracy"), F.round(ratio(F.count_if(ok & fam), F.count_if(fam)), 6).alias("accuracy_given_family"),
    )
    conf = scored.groupBy(F.col("subtype").alias("gold"), sub.alias("pred")).agg(F.count("*").alias("n"))
    f1 = class_report(conf, False).agg(F.round(F.avg("f1"), 5).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 5).alias("weighted_f1"))
    return acc.join(f1, F.lit(True))


def confusion_shares(conf: DataFrame) -> DataFrame:
    """Cells as shares of their gold row."""
    return conf.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("gold")), 6))


def symmetry(scored: DataFrame) -> DataFrame:
    """Over all pairs: both orders right, accuracies of each order, their product, the
    lift over it and family consistency; abstentions are not looked at."""
    a, b = F.col("pred_family_ab") == F.col("family"), F.col("pred_family_ba") == F.col("family")
    n = F.count("*")
    return mirror(scored).agg(
        n.alias("n"), F.round(F.count_if(a & b) / n, 6).alias("csa"), F.round(F.count_if(a) / n, 6).alias("acc_ab"), F.round(F.count_if(b) / n, 6).alias("acc_ba"),
        F.round(F.count_if(a) * F.count_if(b) / (n * n), 6).alias("product"), F.round(F.count_if(a & b) / n - F.count_if(a) * F.count_if(b) / (n * n), 6).alias("lift"),
        F.round(F.count_if(F.col("pred_family_ab") == F.col("pred_family_ba")) / n, 6).alias("consistency"),
    )


def direction_symmetry(scored: DataFrame) -> DataFrame:
    """Direction right in both orders, given the family right in both, and over all
    pairs; in total and by kind of direction; -1 where nothing is given."""
    fam = (F.col("pred_family_ab") == F.col("family")) & (F.col("pred_family_ba") == F.col("family"))
    turn = (F.col("pred_direction_ab") == F.col("direction_ab")) & (F.col("pred_direction_ba") == F.col("direction_ba"))
    kind = F.when(F.col("direction_ab") == "bidirectional", "bidirectional").otherwise("directed")
    given = F.coalesce(ratio(F.count_if(fam & turn), F.count_if(fam)), F.lit(-1.0))
    return mirror(scored).withColumn("kind", kind).groupingSets([[], ["kind"]], "kind").agg(
        F.count("*").alias("n"), F.round(given, 6).alias("given_family"), F.round(F.count_if(turn) / F.count("*"), 6).alias("unconditional"),
    )


def gated_levels(scored: DataFrame) -> DataFrame:
    """Macro and weighted gated score, the family-only variant and the share of each level."""
    ok = ~F.col("abstain") & (F.col("pred_family") == F.col("family"))
    level = F.when(~ok, 0.0).when(F.col("pred_subtype") != F.col("subtype"), 0.3).when(F.col("pred_direction") != F.col("direction"), 0.7).otherwise(1.0)
    by = scored.withColumn("level", level).groupBy("family").agg(
        F.count("*").alias("n"), F.sum("level").alias("s"), F.count_if(ok).alias("k"), *(F.count_if(F.col("level") == x).alias(f"l{k}") for k, x in enumerate((0.0, 0.3, 0.7, 1.0))),
    )
    n = F.sum("n")
    return by.agg(
        F.round(F.avg(F.col("s") / F.col("n")), 5).alias("macro"), F.round(F.sum("s") / n, 5).alias("weighted"), F.round(F.avg(F.col("k") / F.col("n")), 5).alias("family_only"),
        *(F.round(F.sum(f"l{k}") / n, 6).alias(f"share_{k}") for k in range(4)),
    )


def reconciled(scored: DataFrame) -> DataFrame:
    """One family for each pair: where the two orders part, the more confident one's
    (the first order's on a tie)."""
    pick = F.when(F.col("pred_family_ab") == F.col("pred_family_ba"), F.col("pred_family_ab")).when(F.col("confidence_ab") >= F.col("confidence_ba"), F.col("pred_family_ab")).otherwise(F.col("pred_family_ba"))
    return mirror(scored).select("pair_id", "family", pick.alias("pred_family"), (F.col("pred_family_ab") != F.col("pred_family_ba")).alias("conflict"))


def common_support(gold: DataFrame, predictions: dict[str, DataFrame]) -> DataFrame:
    """``gold(pair_id, family)`` with one column of families for each prediction set
    (pair_id, pred_family, ord); the first record of a pair counts, pairs that a set
    lacks leave."""
    out = gold.select("pair_id", "family")
    for name, p in predictions.items():
        first = p.groupBy("pair_id").agg(F.min_by("pred_family", "ord").alias(name))
        out = out.join(first, "pair_id")
    return out


def error_overlap(rows: DataFrame, names: list[str]) -> DataFrame:
    """Numbers of rows by the set of models that err on them, and agreement of every
    two models (as ``a=b``)."""
    wrong = F.array_join(F.filter(F.array(*(F.when(F.col(n) != F.col("family"), n) for n in names)), F.isnotnull), "+")
    sets = rows.groupBy(wrong.alias("key")).agg(F.count("*").alias("n")).select(F.lit("errors").alias("kind"), "key", F.col("n").cast("double").alias("value"))
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    wide = rows.agg(*(F.avg((F.col(a) == F.col(b)).cast("double")).alias(f"{a}={b}") for a, b in pairs))
    melted = wide.unpivot([], [f"`{a}={b}`" for a, b in pairs], "key", "value").select(F.lit("agreement").alias("kind"), "key", F.round("value", 6).alias("value"))
    return sets.unionByName(melted)


def same_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair_id, side) of pairs that only one of two sets holds; empty when equal."""
    left, right = a.select("pair_id").distinct(), b.select("pair_id").distinct()
    return left.join(right, "pair_id", "left_anti").withColumn("side", F.lit("missing")).unionByName(right.join(left, "pair_id", "left_anti").withColumn("side", F.lit("extra")))


def utility_at(curve: DataFrame, total: int | None, shares: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95), alpha: float = 1.0) -> DataFrame:
    """Utility at the lowest coverage that reaches each share of ``total`` (default: the
    largest ``kept``), and at its best (coverage null), from rows (confidence, kept, right)."""
    whole = curve.agg(F.max("kept").alias("m")) if total is None else curve.agg(F.lit(total).alias("m"))
    rows = curve.join(whole, F.lit(True)).withColumn("u", (F.col("right") - alpha * (F.col("kept") - F.col("right"))) / F.col("m"))
    at = rows.withColumn("coverage", F.explode(F.array(*map(F.lit, shares)))).where("kept >= coverage * m").groupBy("coverage").agg(F.min_by("u", "kept").alias("u"))
    best = rows.agg(F.max("u").alias("u")).select(F.lit(None).cast("double").alias("coverage"), "u")
    return at.unionByName(best).select("coverage", F.round("u", 6).alias("utility"))


def full_report(scored: DataFrame) -> DataFrame:
    """(metric, family, value): accuracy, F1, gated and additive scores, utility,
    coverage, symmetry and calibration in one table."""
    ab = scored.where("input_order = 'ab'")

    def tall(df: DataFrame, names: list[str], family: bool) -> DataFrame:
        f = F.col("family") if family else F.lit(None).cast("string")
        pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
        return df.select(f.alias("family"), F.expr(f"stack({len(names)}, {pairs}) AS (metric, value)"))

    parts = [
        tall(class_report(cells(ab)), ["prec", "recall", "f1"], True), tall(headline(ab, 0), ["macro_f1", "weighted_f1"], False),
        tall(gated_score(ab).withColumnRenamed("score", "gated"), ["gated"], True), tall(additive_score(ab).withColumnRenamed("score", "additive"), ["additive"], True),
        tall(abstention_utility(ab), ["utility", "coverage", "selective_accuracy"], True), tall(symmetry(scored), ["csa", "lift", "consistency"], False), tall(ece(ab), ["ece"], False),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
