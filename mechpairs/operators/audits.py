"""Audits of labels, splits, candidates and errors, and selections that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import ratio
from .splits import cold_section, hash_rank, with_parts
from .taxonomy import FAMILIES, with_template
from .traces import keyword_overlap

# Cues of an error cluster, by gold family.
CUES = {
    "PK_Metabolism": ("cyp", "cytochrome", "ugt", "enzyme", "metabol", "substrate", "inhibitor", "inhibits", "inducer", "induces"),
    "PK_Excretion": ("renal", "kidney", "excretion", "clearance", "oat", "oct", "oatp", "bcrp", "biliary", "transporter"),
    "PK_Distribution": ("albumin", "glycoprotein", "protein binding", "serum concentration", "plasma concentration", "carrier", "displace", "binding"),
}
# Names of error clusters, with and without a cue.
TO_ADVERSE = {
    "PK_Metabolism": ("pk_metabolism_mislabeled_as_adverse", "pk_metabolism_to_adverse_no_pk_evidence"),
    "PK_Excretion": ("pk_excretion_mislabeled_as_adverse", "pk_excretion_to_adverse_no_transport_evidence"),
    "PK_Distribution": ("pk_distribution_mislabeled_as_adverse", "pk_distribution_to_adverse_no_distribution_evidence"),
    "PD_Activity": ("pd_activity_mislabeled_as_adverse",) * 2,
    "Efficacy": ("efficacy_mislabeled_as_adverse",) * 2,
}
# Trace polarities that go with a gold polarity.
POLARITIES = {"up": ("up", "risk"), "down": ("down",), "risk": ("risk", "up"), "risk_down": ("down", "risk_down")}
# Words that do not count in a subtype.
STOPWORDS = ("and", "or", "of", "the", "a", "an")


def side(**fields: Column) -> Column:
    """A struct of named columns."""
    return F.struct(*(c.alias(name) for name, c in fields.items()))


def template_cover(pairs: DataFrame, share: float = 0.95) -> DataFrame:
    """One row: pairs, templates, and the fewest templates that hold ``share`` of the pairs.

    Templates are counted by their size first, so the running total is over distinct
    sizes (at most about the root of twice the pairs), not over templates.
    """
    sizes = with_template(pairs).groupBy("template").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("k"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("size"))
    rows = sizes.select("size", "k", F.sum(F.col("size") * F.col("k")).over(w).alias("held"), F.sum("k").over(w).alias("used"))
    total = sizes.agg(F.sum(F.col("size") * F.col("k")).alias("n_pairs"), F.sum("k").alias("n_templates"))
    need = F.ceil(F.round(F.col("n_pairs") * share, 6))
    spare = F.floor((F.col("held") - need) / F.col("size"))
    return rows.join(total, F.lit(True)).where(F.col("held") >= need).groupBy("n_pairs", "n_templates").agg(F.min_by(F.col("used") - spare, "used").cast("long").alias("n_cover"))


def description_spread(mentions: DataFrame) -> DataFrame:
    """By number of different descriptions of a pair: pairs, and pairs that are described
    both ways with different sets of descriptions."""
    ahead = F.col("s") < F.col("o")
    told = mentions.groupBy(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"), "description").agg(F.bool_or(ahead).alias("x"), F.bool_or(~ahead).alias("y"))
    both = F.bool_or("x") & F.bool_or("y") & ~F.bool_and(F.col("x") & F.col("y"))
    per = told.groupBy("a", "b").agg(F.count("*").alias("n_descriptions"), both.alias("apart"))
    return per.groupBy("n_descriptions").agg(F.count("*").alias("n_pairs"), F.count_if("apart").alias("n_asymmetric"))


def split_overlaps(labels: DataFrame, split: DataFrame | None, parts: DataFrame) -> DataFrame:
    """One row: entities of each section, of each two, and train pairs that touch an entity
    of the test or val part.  Without ``split`` sections follow from the parts of both ends,
    as in ``entity_cold_split``, with no join by pair.

    One pass: a pair counts where it touches with its first end.
    """
    rows = with_parts(labels, parts)
    rows = rows.withColumn("split", cold_section()) if split is None else rows.join(split.select("pair_id", "split"), "pair_id")
    touches = {x: F.coalesce((F.col("split") == "train") & ((F.col("pa") == x) | (F.col("pb") == x)), F.lit(False)) for x in ("test", "val")}
    first = F.struct(F.col("a_id").alias("entity"), *(t.cast("long").alias(f"touch_{x}") for x, t in touches.items()))
    second = F.struct(F.col("b_id").alias("entity"), *(F.lit(0).cast("long").alias(f"touch_{x}") for x in touches))
    ends = rows.select("split", F.inline(F.array(first, second))).groupBy("entity").agg(
        *(F.bool_or(F.col("split") == x).alias(x) for x in ("train", "val", "test")), *(F.sum(f"touch_{x}").alias(f"touch_{x}") for x in touches))
    return ends.agg(
        *(F.count_if(x).alias(f"{x}_entities") for x in ("train", "val", "test")),
        *(F.count_if(F.col(x) & F.col(y)).alias(f"{x}_{y}") for x, y in (("train", "test"), ("train", "val"), ("val", "test"))),
        *(F.coalesce(F.sum(f"touch_{x}"), F.lit(0)).alias(f"train_pairs_in_{x}_part") for x in touches),
    )


def degree_distribution(labels: DataFrame) -> DataFrame:
    """Entities by their number of pairs."""
    ends = labels.select(F.explode(F.array("a_id", "b_id")).alias("entity"))
    return ends.groupBy("entity").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n_entities"))


def complementarity(splits: dict[str, DataFrame]) -> DataFrame:
    """By split: pairs of each section and its share of them."""
    rows = None
    for name, df in splits.items():
        part = df.groupBy("split").agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    return rows.select("name", "split", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("name")), 6).alias("share"))


def prevalence(train: DataFrame, scored: DataFrame) -> DataFrame:
    """By family: share in training, share among gold and among predictions, and F1
    (abstentions are a class of their own)."""
    said = F.when(~F.col("abstain"), F.col("pred_family"))
    right = F.coalesce(said == F.col("family"), F.lit(False)).cast("int")
    counts = scored.select(F.inline(F.array(side(family=F.col("family"), g=F.lit(1), p=F.lit(0), r=right), side(family=said, g=F.lit(0), p=F.lit(1), r=F.lit(0))))).where("family is not null").groupBy("family").agg(*(F.sum(c).alias(c) for c in "gpr"))
    total = scored.agg(F.count("*").alias("n"))
    seen = train.groupBy("family").agg(F.count("*").alias("t"))
    all_seen = train.agg(F.count("*").alias("nt"))
    return seen.join(all_seen, F.lit(True)).join(counts, "family").join(total, F.lit(True)).select(
        "family", F.round(F.col("t") / F.col("nt"), 6).alias("train_share"), F.round(F.col("g") / F.col("n"), 6).alias("gold_share"),
        F.round(F.col("p") / F.col("n"), 6).alias("pred_share"), F.round(2 * F.col("r") / (F.col("g") + F.col("p")), 6).alias("f1"),
    )


def brier(rows: DataFrame, score: str, right: str, at: float = 0.5, gate: float = 0.25) -> DataFrame:
    """One row: number, Brier score, accuracy of ``score >= at``, and whether the score is under ``gate``."""
    y = F.col(right).cast("double")
    out = rows.agg(F.count("*").alias("n"), F.avg((F.col(score) - y) * (F.col(score) - y)).alias("b"), F.avg(((F.col(score) >= at) == F.col(right)).cast("double")).alias("a"))
    return out.select("n", F.round("b", 6).alias("brier"), F.round("a", 6).alias("accuracy"), (F.col("b") <= gate).alias("ok"))


def win_loss(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of two models (pair_id, family, pred_family, abstain) with the bucket of who is right."""
    x, y = (df.select("pair_id", *(["family"] if k == 0 else []), ((F.col("pred_family") == F.col("family")) & ~F.col("abstain")).alias("xy"[k])) for k, df in enumerate((a, b)))
    bucket = F.when(F.col("x") & F.col("y"), "both_correct").when(F.col("x"), "llm_win").when(F.col("y"), "baseline_win").otherwise("both_wrong")
    return x.join(y, "pair_id").select("pair_id", "family", bucket.alias("bucket"))


def ranked_scores(candidates: DataFrame, scores: list[str]) -> DataFrame:
    """``1 / (1 + rank)`` of each candidate among those of its pair, for each score."""
    def place(c: str) -> Column:
        return 1 / F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc_nulls_last(c), "candidate_id"))

    return candidates.select("pair_id", "candidate_id", *(F.round(place(c), 6).alias(f"{c}_place") for c in scores))


def quota_selection(rows: DataFrame, quotas: dict[str, int], priority: list[Column], excluded: DataFrame) -> DataFrame:
    """The first rows of each family by ``priority`` up to its quota, without excluded pairs."""
    limit = F.lit(0)
    for family, n in quotas.items():
        limit = F.when(F.col("family") == family, n).otherwise(limit)
    free = rows.where(F.col("family").isin(*quotas)).join(excluded.select("pair_id"), "pair_id", "left_anti")
    w = Window.partitionBy("family").orderBy(*priority, "pair_id")
    largest = max(quotas.values())  # a constant bound lets Spark cut each family before the shuffle
    return free.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= largest) & (F.col("rank") <= limit))


def first_seen(rows: DataFrame, group: str, cap: int, order: list[str]) -> DataFrame:
    """At most ``cap`` rows of each group, the first in order."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= cap)


def capped_subset(labels: DataFrame, per_class: int, share: float, seed: str = "cap-1") -> DataFrame:
    """At most ``per_class`` pairs of each family in hash order, and of those the pairs
    that are, for both ends, among the first ``ceil(share * n)`` of that entity."""
    ranked = hash_rank(labels, "pair_id", ["family"], seed).where(F.col("_rank") <= per_class).select("pair_id", "family", "a_id", "b_id", F.col("_rank").alias("rank"))
    most = ranked.agg(F.ceil(F.round(F.count("*") * share, 6)).alias("most"))
    ends = ranked.select("pair_id", "rank", F.explode(F.array("a_id", "b_id")).alias("entity"))
    seat = F.row_number().over(Window.partitionBy("entity").orderBy("rank", "pair_id"))
    kept = ends.withColumn("seat", seat).groupBy("pair_id").agg(F.max("seat").alias("seat"))
    return ranked.join(kept, "pair_id").join(most, F.lit(True)).where(F.col("seat") <= F.col("most")).select("pair_id", "family")


def drop_reasons(labels: DataFrame) -> DataFrame:
    """Labels with the reason to drop them, null for those that stay."""
    reason = F.when(F.col("family") == "Other", "unmatched_codename").when(~F.col("bidirectional") & (F.col("subject_id") == F.col("object_id")), "ambiguous_synonym_same_id")
    return labels.select("pair_id", "family", reason.alias("reason"))


def kept_tiers(records: DataFrame, prefs: DataFrame, tiers: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Records of the listed tiers, and the preferences whose pair still has one.  Preferences
    that carry the ``tier`` of their pair's only record are told by it."""
    kept = records.where(F.col("tier").isin(*tiers))
    if "tier" in prefs.columns:
        return kept, prefs.where(F.col("tier").isin(*tiers)).drop("tier")
    return kept, prefs.join(kept.select("pair_id").distinct(), "pair_id", "left_semi")


def reranked_records(winners: DataFrame, picks: DataFrame | None, records: DataFrame | None) -> DataFrame:
    """The record of each pair's new pick; the old winner's number where the pick has none.
    Without ``picks`` the winners carry ``pick``, the pair's new one with its tier, and one
    whose tier is drop has no record."""
    if picks is None:
        there, new = F.col("pick.tier") != "drop", F.col("pick.candidate_id")
        return winners.select(
            "pair_id", F.when(there, new).otherwise(F.col("candidate_id")).alias("candidate_id"), F.when(there, F.col("pick.tier")).otherwise(F.col("tier")).alias("tier"),
            F.coalesce(there & (new != F.col("candidate_id")), F.lit(False)).alias("changed"))
    there = records.select("pair_id", F.col("candidate_id").alias("new_id"), F.col("tier").alias("new_tier"))
    picked = picks.select("pair_id", F.col("candidate_id").alias("new_id")).join(there, ["pair_id", "new_id"])
    return winners.select("pair_id", "candidate_id", "tier").join(picked, "pair_id", "left").select(
        "pair_id", F.coalesce("new_id", "candidate_id").alias("candidate_id"), F.coalesce("new_tier", "tier").alias("tier"), F.coalesce(F.col("new_id") != F.col("candidate_id"), F.lit(False)).alias("changed"))


def completeness(entities: DataFrame, tables: dict[str, DataFrame], filled: list[str]) -> DataFrame:
    """By entity: whether each column of ``filled`` holds something and each table
    ``(entity, ...)`` knows it, and how many of these do."""
    out = entities.select("entity", *((F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).alias(f"has_{c}") for c in filled))
    for name, df in tables.items():
        out = out.join(df.select("entity").distinct().withColumn(f"in_{name}", F.lit(True)), "entity", "left").withColumn(f"in_{name}", F.coalesce(f"in_{name}", F.lit(False)))
    flags = [c for c in out.columns if c != "entity"]
    return out.withColumn("n_held", sum(F.coalesce(F.col(c), F.lit(False)).cast("int") for c in flags))


def keywords(subtype: Column) -> Column:
    """Words of a subtype that count: three letters or more, no stopwords."""
    return F.filter(F.split(F.lower(subtype), r"[_\s-]+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS))


def crosscheck(rows: DataFrame) -> DataFrame:
    """By tier: share of rows that agree with the gold on family, on a word of the subtype
    in ``said``, on polarity, on direction, and on all four."""
    words = keywords(F.col("subtype"))
    agree = F.coalesce(F.col("pred_polarity") == F.col("polarity"), F.lit(False))
    for gold, fits in POLARITIES.items():
        agree = F.when(F.col("polarity") == gold, F.coalesce(F.col("pred_polarity").isin(*fits), F.lit(False))).otherwise(agree)
    axes = {
        "family_ok": F.col("pred_family") == F.col("family"), "subtype_ok": (F.size(words) == 0) | F.exists(words, lambda w: F.contains(F.lower("said"), w)),
        "polarity_ok": F.col("polarity").isNull() | agree, "direction_ok": F.col("pred_direction") == F.col("direction"),
    }
    marked = rows.withColumns(axes).withColumn("all_ok", F.col("family_ok") & F.col("subtype_ok") & F.col("polarity_ok") & F.col("direction_ok"))
    return marked.groupBy("tier").agg(F.count("*").alias("n"), *(F.round(F.avg(F.col(c).cast("double")), 6).alias(c) for c in (*axes, "all_ok")))


def error_cluster(said: Column) -> Column:
    """Cluster of a prediction's error, ``correct`` if it has none; ``said`` is the trace's text."""
    gold, pred = F.col("family"), F.col("pred_family")
    text = F.lower(said)
    wrong: list[tuple[Column, Column | str]] = [(keyword_overlap(F.col("subtype"), F.col("pred_subtype")), "axis_ambiguity_same_subtype")]
    for family, (cued, bare) in TO_ADVERSE.items():
        here = (pred == "AdverseRisk") & (gold == family)
        name = F.when(text.rlike("|".join(CUES[family])), cued).otherwise(bare) if family in CUES else F.lit(cued)
        wrong.append((here, name))
    wrong += [
        (pred == "AdverseRisk", "rare_family_mislabeled_as_adverse"), (gold == "AdverseRisk", "adverse_mislabeled_as_non_adverse"),
        (gold.startswith("PK_") & pred.startswith("PK_"), "pk_family_confusion"), ((gold == "Efficacy") & (pred == "PD_Activity"), "efficacy_vs_pd_confusion"),
        ((gold == "PD_Activity") & (pred == "Efficacy"), "pd_vs_efficacy_confusion"),
    ]
    error: Column = F.lit("other_family_error")
    for here, name in reversed(wrong):
        error = F.when(here, name).otherwise(error)
    same = F.coalesce(F.col("pred_direction") == F.col("direction"), F.lit(False))
    right = F.when(~same, "direction_only_error").when(F.col("pred_subtype") != F.col("subtype"), "subtype_only_error").otherwise("correct")
    return F.when(F.col("abstain") | pred.isNull(), "parse_or_schema_failure").when(pred == gold, right).otherwise(error)


def confusion_routing(scored: DataFrame, tune: DataFrame, grid: tuple[float, ...], least: int = 20) -> DataFrame:
    """(tau, predicted, n, gain, use): whether handing the rows of one predicted family with
    a confidence below ``tau`` to the baseline raises macro F1 on the tuning pairs.

    ``scored(pair_id, family, pred_family, base_family, confidence)``.  Rows become
    counts by (tau, gold, both answers, below) once; every rule is then evaluated on those
    counts, so the work after one aggregation does not grow with the rows.
    """
    rows = scored.join(tune.select("pair_id"), "pair_id", "left_semi").withColumn("tau", F.explode(F.array(*(F.lit(float(t)) for t in grid))))
    cells = rows.groupBy("tau", "family", "pred_family", "base_family", (F.col("confidence") < F.col("tau")).alias("low")).agg(F.count("*").alias("n"))
    ruled = cells.withColumn("predicted", F.explode(F.array(F.lit(None).cast("string"), *map(F.lit, FAMILIES))))
    handed = F.col("low") & F.coalesce(F.col("predicted") == F.col("pred_family"), F.lit(False))
    final = ruled.select("tau", "predicted", "family", F.when(handed, F.col("base_family")).otherwise(F.col("pred_family")).alias("said"), "n", F.when(handed, F.col("n")).otherwise(0).alias("m"))
    right = (F.col("said") == F.col("family")).cast("int") * F.col("n")
    no, n = F.lit(0).cast("long"), F.col("n")
    sides = F.array(side(c=F.col("family"), g=n, p=no, r=right, m=F.col("m").cast("long")), side(c=F.col("said"), g=no, p=n, r=no, m=no))
    by = final.select("tau", "predicted", F.inline(sides)).groupBy("tau", "predicted", "c").agg(*(F.sum(x).alias(x) for x in "gprm"))
    macro = by.where("g > 0").groupBy("tau", "predicted").agg(F.avg(2 * F.col("r") / (F.col("g") + F.col("p"))).alias("f"), F.sum("m").alias("n"))
    base = macro.where("predicted is null").select("tau", F.col("f").alias("f0"))
    gain = F.round(F.col("f") - F.col("f0"), 6) + F.lit(0.0)  # no minus zero
    return macro.where("predicted is not null").join(base, "tau").select("tau", "predicted", "n", gain.alias("gain"), ((F.col("n") >= least) & (gain > 0)).alias("use"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """By family and over all: accuracy of two sets of answers on shared pairs, and the gain."""
    rows = before.select("pair_id", "family", (F.col("pred_family") == F.col("family")).alias("x")).join(after.select("pair_id", F.col("pred_family").alias("z")), "pair_id")
    out = rows.groupingSets([[], ["family"]], "family").agg(F.count("*").alias("n"), F.count_if("x").alias("a"), F.count_if(F.col("z") == F.col("family")).alias("b"))
    return out.select("family", "n", F.round(ratio(F.col("a"), F.col("n")), 6).alias("before"), F.round(ratio(F.col("b"), F.col("n")), 6).alias("after"), F.round((F.col("b") - F.col("a")) / F.col("n"), 6).alias("gain"))
