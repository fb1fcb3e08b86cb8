"""Choosing one answer out of several candidates or models.

``candidates(pair_id, candidate_id, cand_family, passed, score)``; a candidate votes
where it passed and names a family.  Ties go to the lowest candidate number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATORS = (
    "greedy", "argmax_1", "argmax_2", "argmax_4", "argmax_8", "vote_majority", "vote_then_argmax", "vote_weighted", "vote_consensus", "vote_margin",
)
LOG_SHIFT = 12.0


def aggregated(candidates: DataFrame) -> DataFrame:
    """(pair_id, aggregator, family, abstain, confidence): all ten ways of choosing, from
    one pass over the candidates of each pair."""
    votes = F.col("passed") & F.col("cand_family").isNotNull()
    by = candidates.groupBy("pair_id", "cand_family").agg(
        F.count_if(votes).alias("n"), F.sum(F.when(votes, F.col("score")).otherwise(0.0)).alias("w"), F.min(F.when(votes, F.col("candidate_id"))).alias("first"),
        F.count("*").alias("rows"), F.min("candidate_id").alias("lead"),
        *(F.max(F.when(F.col("candidate_id") < k, F.struct("passed", "score", -F.col("candidate_id")))).alias(f"b{k}") for k in (1, 2, 4, 8)),
        F.max(F.struct("passed", "score", -F.col("candidate_id"))).alias("best"), F.max(F.when(F.col("passed"), F.struct("score", -F.col("candidate_id")))).alias("top"),
    )
    name = "cand_family"
    rows = by.groupBy("pair_id").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("votes"), F.min_by(name, "lead").alias("greedy"), F.max_by(name, "best").alias("argmax"),
        *(F.max_by(name, f"b{k}").alias(f"a{k}") for k in (1, 2, 4, 8)),
        F.max_by(name, F.struct("n", -F.col("first"))).alias("major"), F.max_by(name, F.struct(F.round("w", 9), -F.col("first"))).alias("heavy"),
        F.max_by(name, "top").alias("top"), F.array_sort(F.collect_list(-F.col("n"))).alias("counts"),
    )
    n1, n2 = -F.get("counts", F.lit(0)), F.coalesce(-F.get("counts", F.lit(1)), F.lit(0))
    some = F.col("votes") > 0
    majority = F.when(some, F.col("major")).otherwise(F.col("argmax"))
    agreed = some & (F.col("top") == F.col("major"))
    one, no = F.lit(None).cast("double"), F.lit(False)

    def out(tag: str, family: Column, abstain: Column = no, confidence: Column = one) -> Column:
        return F.struct(F.lit(tag).alias("aggregator"), family.alias("family"), abstain.alias("abstain"), confidence.alias("confidence"))

    made = [
        out("greedy", F.col("greedy")), *(out(f"argmax_{k}", F.col(f"a{k}")) for k in (1, 2, 4, 8)), out("vote_majority", majority),
        out("vote_then_argmax", F.when(some & (n1 > F.floor(F.col("rows") / 2)), F.col("major")).otherwise(F.col("argmax"))),
        out("vote_weighted", F.when(some, F.col("heavy")).otherwise(F.col("argmax"))),
        out("vote_consensus", F.when(some, F.col("top")).otherwise(F.col("greedy")), ~agreed, F.round(n1 / F.col("rows"), 6)),
        out("vote_margin", majority, no, F.when(some, F.round((n1 - n2) / F.col("rows"), 6))),
    ]
    return rows.select("pair_id", F.inline(F.array(*made)))


def log_vote(candidates: DataFrame) -> DataFrame:
    """(pair_id, family, confidence): each passed candidate votes with its log score,
    moved up by ``LOG_SHIFT`` and cut at zero; confidence is the winner's share."""
    weight = F.greatest(F.ln(F.greatest("score", F.lit(1e-12))) + LOG_SHIFT, F.lit(0.0))
    by = candidates.where("passed and cand_family is not null").groupBy("pair_id", "cand_family").agg(F.round(F.sum(weight), 6).alias("w"), F.min("candidate_id").alias("first"))
    rows = by.groupBy("pair_id").agg(F.max_by("cand_family", F.struct("w", -F.col("first"))).alias("family"), F.max("w").alias("m"), F.sum("w").alias("s"))
    return rows.select("pair_id", "family", F.round(F.col("m") / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0), 5).alias("confidence"))


def signals(candidates: DataFrame) -> DataFrame:
    """Confidence signals of each pair: vote margin, one minus the normalised entropy of
    the votes, largest, mean and top-family mean score.  One row for each pair with its
    candidates by family, an array ``tallies`` of (n, below, cand_family, s, hi), needs no
    grouping: number, least candidate number as a negative one, sum and largest of the scores;
    families that none names may be there with n 0."""
    if "tallies" in candidates.columns:
        rows = candidates.select(
            "pair_id", F.aggregate("tallies", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("all"), F.size(F.filter("tallies", lambda x: x["n"] > 0)).alias("k"),
            F.sort_array(F.transform("tallies", lambda x: -x["n"])).alias("c"), F.aggregate("tallies", F.lit(0.0), lambda a, x: a + F.when(x["n"] > 1, x["n"] * F.ln(x["n"])).otherwise(0.0)).alias("h"),
            F.aggregate("tallies", F.lit(0.0), lambda a, x: a + x["s"]).alias("s"), F.array_max(F.col("tallies")["hi"]).alias("hi"), F.array_max("tallies").alias("top"),
        ).withColumn("mean_top", F.col("top.s") / F.col("top.n"))
    else:
        by = candidates.groupBy("pair_id", "cand_family").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.max("score").alias("hi"), F.min("candidate_id").alias("first"))
        rows = by.groupBy("pair_id").agg(
            F.sum("n").alias("all"), F.count("*").alias("k"), F.array_sort(F.collect_list(-F.col("n"))).alias("c"), F.sum(F.col("n") * F.ln("n")).alias("h"),
            F.sum("s").alias("s"), F.max("hi").alias("hi"), F.max_by(F.col("s") / F.col("n"), F.struct("n", -F.col("first"))).alias("mean_top"),
        )
    h = F.ln("all") - F.col("h") / F.col("all")
    return rows.select(
        "pair_id", F.round((-F.get("c", F.lit(0)) + F.coalesce(F.get("c", F.lit(1)), F.lit(0))) / F.col("all"), 6).alias("margin"),
        F.round(F.when(F.col("k") > 1, 1 - h / F.ln("k")).otherwise(1.0), 5).alias("certainty"), F.round("hi", 6).alias("score_max"),
        F.round(F.col("s") / F.col("all"), 6).alias("score_mean"), F.round("mean_top", 6).alias("score_top_family"),
    )


def oracle_ceiling(candidates: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """By family: share of pairs of which any candidate names the gold family; without
    ``gold`` the candidates carry it."""
    known = candidates if gold is None else candidates.join(gold.select("pair_id", "family"), "pair_id")
    rows = known.groupBy("pair_id", "family").agg(F.bool_or(F.col("cand_family") == F.col("family")).alias("any"))
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg(F.col("any").cast("double")), 6).alias("ceiling"))


def partial_rescue(scored: DataFrame, fixable: DataFrame, shares: tuple[float, ...] = (0.3, 0.5, 0.7, 1.0), seed: str = "fix-1") -> DataFrame:
    """Accuracy if each share of the fixable errors (in hash order) were mended."""
    from .splits import hash_rank

    wrong = scored.where("pred_family <> family").join(fixable.select("pair_id").distinct(), "pair_id", "left_semi").select("pair_id")
    ranked = hash_rank(wrong, "pair_id", [], seed).select("pair_id", "_rank", "_n")
    base = scored.agg(F.count("*").alias("n"), F.count_if(F.col("pred_family") == F.col("family")).alias("r"))
    mended = ranked.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).groupBy("share").agg(F.count_if(F.col("_rank") <= F.floor(F.col("share") * F.col("_n"))).alias("m"))
    return mended.join(base, F.lit(True)).select("share", "m", F.round((F.col("r") + F.col("m")) / F.col("n"), 6).alias("accuracy"))


def weighted_modes(modes: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """(pair_id, family): weighted vote of several decoders (pair_id, pred_family)."""
    rows = None
    for k, (df, weight) in enumerate(modes.values()):
        part = df.select("pair_id", F.col("pred_family").alias("f"), F.lit(float(weight)).alias("w"), F.lit(k).alias("k"))
        rows = part if rows is None else rows.unionByName(part)
    by = rows.groupBy("pair_id", "f").agg(F.sum("w").alias("w"), F.min("k").alias("k"))
    return by.groupBy("pair_id").agg(F.max_by("f", F.struct("w", -F.col("k"))).alias("family"))


def mode_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """By family: rows that both, only one or none of two modes get right."""
    rows = a.select("pair_id", "family", (F.col("pred_family") == F.col("family")).alias("x")).join(
        b.select("pair_id", (F.col("pred_family") == F.col("family")).alias("y"), F.col("pred_family").alias("fb")), "pair_id"
    )
    return rows.groupBy("family").agg(
        F.count_if(F.col("x") & F.col("y")).alias("both"), F.count_if(F.col("x") & ~F.col("y")).alias("only_a"),
        F.count_if(~F.col("x") & F.col("y")).alias("only_b"), F.count_if(~F.col("x") & ~F.col("y")).alias("none"),
    )


def majority_baseline(train: DataFrame, test: DataFrame) -> DataFrame:
    """``test`` with the most frequent family of ``train`` as prediction."""
    top = train.groupBy("family").agg(F.count("*").alias("n")).agg(F.max_by("family", F.struct("n", "family")).alias("pred_family"))
    return test.select("pair_id", "family").join(top, F.lit(True))


def two_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ensembles of two models, (pair_id, family, rule, pred_family, abstain): each
    alone, b where a abstains, the more confident, the confidence-weighted sum of the
    two maps, and a only where both agree."""
    def side(df: DataFrame, t: str) -> DataFrame:
        return df.select("pair_id", *([] if t == "b" else ["family"]), F.col("pred_family").alias(f"f_{t}"), F.col("abstain").alias(f"z_{t}"), F.col("confidence").alias(f"c_{t}"), F.col("dist").alias(f"d_{t}"))

    rows = side(a, "a").join(side(b, "b"), "pair_id")

    def top(scale_a: Column, scale_b: Column) -> Column:
        mixed = F.map_zip_with("d_a", "d_b", lambda k, x, y: F.coalesce(x, F.lit(0.0)) * scale_a + F.coalesce(y, F.lit(0.0)) * scale_b)
        ordered = F.array_sort(F.transform(F.map_entries(mixed), lambda e: F.struct((-F.round(e["value"], 9)).alias("v"), e["key"].alias("k"))))
        return F.get(ordered, F.lit(0))["k"]

    half = F.lit(0.5)
    rules = {
        "solo_a": (F.col("f_a"), F.col("z_a")), "solo_b": (F.col("f_b"), F.col("z_b")),
        "rescue_abstain": (F.when(F.col("z_a"), F.col("f_b")).otherwise(F.col("f_a")), F.col("z_a") & F.col("z_b")),
        "max_confidence": (F.when(F.col("c_b") > F.col("c_a"), F.col("f_b")).otherwise(F.col("f_a")), F.lit(False)),
        "prob_average": (top(half, half), F.lit(False)), "confidence_weighted": (top(F.col("c_a"), F.col("c_b")), F.lit(False)),
        "agree": (F.col("f_a"), F.col("f_a") != F.col("f_b")),
    }
    listed = F.array(*(F.struct(F.lit(r).alias("rule"), f.alias("pred_family"), z.alias("abstain")) for r, (f, z) in rules.items()))
    return rows.select("pair_id", "family", F.inline(listed))


def threshold_router(first: DataFrame, baseline: DataFrame, tune: DataFrame, grid: tuple[float, ...]) -> DataFrame:
    """Right answers on the tuning pairs when the baseline takes over from each
    confidence of its own on, one row for each threshold, the best one marked."""
    rows = first.join(tune.select("pair_id"), "pair_id", "left_semi").select("pair_id", "family", F.col("pred_family").alias("f")).join(
        baseline.select("pair_id", F.col("pred_family").alias("g"), "confidence"), "pair_id"
    )
    cells = rows.agg(*(F.count_if(F.when(F.col("confidence") >= t, F.col("g")).otherwise(F.col("f")) == F.col("family")).alias(f"t{k}") for k, t in enumerate(grid)), F.count("*").alias("n"))
    listed = F.array(*(F.struct(F.lit(float(t)).alias("tau"), F.col(f"t{k}").alias("n_right")) for k, t in enumerate(grid)))
    each = cells.select("n", F.inline(listed), F.array_max(F.array(*(F.col(f"t{k}") for k in range(len(grid))))).alias("m"))
    return each.select("tau", "n_right", F.round(F.col("n_right") / F.col("n"), 6).alias("accuracy"), (F.col("n_right") == F.col("m")).alias("best"))


def rebalanced(scored: DataFrame, voters: DataFrame, bias: DataFrame, least_bias: float = 1.1, below: float = 0.6) -> DataFrame:
    """Families switched where they are over-predicted, the confidence is low and two
    voters or more agree on another one.  ``voters(pair_id, vote)``, ``bias(family, bias)``."""
    votes = voters.groupBy("pair_id", "vote").agg(F.count("*").alias("n")).where("n >= 2").groupBy("pair_id").agg(F.max_by("vote", F.struct("n", "vote")).alias("other"))
    rows = scored.join(votes, "pair_id", "left").join(bias.select(F.col("family").alias("pred_family"), "bias"), "pred_family", "left")
    go = (F.col("bias") > least_bias) & (F.col("confidence") < below) & F.col("other").isNotNull() & (F.col("other") != F.col("pred_family"))
    return rows.select("pair_id", "family", F.when(go, F.col("other")).otherwise(F.col("pred_family")).alias("pred_family"), F.coalesce(go, F.lit(False)).alias("switched"))


# The parameters of the rescue that a sweep tries.
SWEEP = {"max_confidence": (0.4, 0.5, 0.6, 0.7, 1.0), "strength": (0.5, 0.6, 0.7, 0.8, 1.0), "max_share": (0.10, 0.20, 0.34, 1.0), "min_steps": (2, 3, 4)}


def rescue_sweep(predictions: DataFrame, steps: DataFrame, grid: dict[str, tuple] = SWEEP, seed: str = "sweep-1") -> DataFrame:
    """Macro-F1 on a tuning half and on the other one for every setting of the rescue by
    step hints (``traces.rescued``), the best on the tuning half marked (the first on a tie).

    All settings read one table of counts: pairs that agree in half, families, hints and
    confidence band are one cell, so the grid never meets the pairs.
    """
    from .learning import fold
    from .taxonomy import FAMILIES
    from .traces import hint_majority

    confidence = F.coalesce("confidence", F.lit(float("inf")))
    band = sum((F.when(confidence > c, 1).otherwise(0) for c in grid["max_confidence"]), F.lit(0))  # bounds that it breaks, the least first
    facts = predictions.join(hint_majority(steps), "pair_id", "left").select(
        fold(F.col("pair_id"), 2, seed).alias("half"), "family", "pred_family", "winner", "n_hints", "n_winner", F.coalesce(F.try_element_at("counts", F.col("pred_family")), F.lit(0)).alias("own"), band.alias("band"),
    )
    cells = facts.groupBy(*facts.columns).agg(F.count("*").alias("n"))
    listed = cells.sparkSession.createDataFrame([(k, c, s, m, t, b) for k, (b, c, s, m, t) in enumerate((b, c, s, m, t) for b, c in enumerate(grid["max_confidence"]) for s in grid["strength"] for m in grid["max_share"] for t in grid["min_steps"])],
                                                "point int, max_confidence double, strength double, max_share double, min_steps int, bound int")
    tried = cells.join(F.broadcast(listed), F.col("band") <= F.col("bound")).unionByName(cells.join(F.broadcast(listed), F.col("band") > F.col("bound")).withColumn("winner", F.lit(None).cast("string")))
    go = F.coalesce(
        (F.col("n_hints") >= F.col("min_steps")) & (F.col("winner") != F.col("pred_family")) & (F.col("n_winner") >= F.col("strength") * F.col("n_hints")) & (F.col("own") < F.col("n_winner")) & (F.col("own") <= F.col("max_share") * F.col("n_hints")), F.lit(False),
    )
    keys = ["point", "max_confidence", "strength", "max_share", "min_steps"]
    told = tried.select(*keys, "half", "family", F.when(go, F.col("winner")).otherwise(F.col("pred_family")).alias("final"), go.alias("go"), "n")
    sides = told.select(*keys, "half", F.explode(F.array(F.struct(F.col("family").alias("f"), F.lit(1).alias("gold")), F.struct(F.col("final").alias("f"), F.lit(0).alias("gold")))).alias("e"), (F.col("family") == F.col("final")).alias("ok"), "go", "n")
    by = sides.groupBy(*keys, "half", "e.f").agg(F.sum(F.when((F.col("e.gold") == 1) & F.col("ok"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("both"), F.sum(F.when((F.col("e.gold") == 1) & F.col("go"), F.col("n")).otherwise(0)).alias("moved"))
    f1 = F.when(F.col("f").isin(*FAMILIES), 2.0 * F.col("tp") / F.col("both")).otherwise(0.0)
    halves = by.groupBy(*keys).agg(*(F.round(F.sum(F.when(F.col("half") == h, f1).otherwise(0.0)) / len(FAMILIES), 6).alias(name) for h, name in ((0, "tuned_f1"), (1, "other_f1"))), F.sum("moved").alias("n_rescued"))
    best = halves.agg(F.max_by("point", F.struct("tuned_f1", -F.col("point"))).alias("b"))
    return halves.join(F.broadcast(best), F.lit(True)).withColumn("best", F.col("point") == F.col("b")).drop("b")


def stage_gains(stages: dict[str, DataFrame]) -> DataFrame:
    """Accuracy after each stage (pair_id, family, pred_family) and its gain on the one before."""
    rows = None
    for k, (name, df) in enumerate(stages.items()):
        part = df.agg(F.lit(k).alias("step"), F.lit(name).alias("stage"), F.count("*").alias("n"), F.round(F.avg((F.col("pred_family") == F.col("family")).cast("double")), 6).alias("accuracy"))
        rows = part if rows is None else rows.unionByName(part)
    before = rows.select((F.col("step") + 1).alias("step"), F.col("accuracy").alias("was"))
    return rows.join(before, "step", "left").select("step", "stage", "n", "accuracy", F.round(F.col("accuracy") - F.col("was"), 6).alias("gain"))
