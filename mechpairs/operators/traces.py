"""Scores of reasoning traces.

A trace is its steps, one row each: ``steps(pair_id, step_id, role, claim, evidence,
hint, score)`` with the columns of its prediction and ``context``, the ids that it
may cite.  Steps of one trace are few, so grouping by pair is never a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations
from .taxonomy import FAMILIES

# Roles that carry no reasoning, words a claim needs, phrases that only
# abstentions may use, entity patterns, and cues of each family.
META_ROLES = ("conclusion", "abstention", "evidence_gap")
MIN_CLAIM_WORDS = 3
BANNED = ("i cannot", "i can not", "insufficient information", "not enough information", "unable to determine", "cannot be determined")
ENTITIES = (
    r"\bDB\d{5,}\b", r"(?i)\bCYP\d{1,2}[A-Z]\d{0,2}\b", r"(?i)\bOATP\d[A-Z]\d{0,2}\b", r"(?i)\b(?:P[- ]?gp|PGP|ABCB1)\b",
    r"(?i)\b(?:BCRP|MRP\d|MATE\d?|OCT\d|OAT\d|NTCP|BSEP)\b", r"(?i)\bhsa[:\-]?\d{4,6}\b", r"\b[OPQ][0-9][A-Z0-9]{3}[0-9]\b",
    r"\b[A-NR-Z][0-9][A-Z][A-Z0-9]{2}[0-9](?:[A-Z][A-Z0-9]{2}[0-9])?\b",
)
CUES = {
    "PK_Metabolism": (
        r"\bmetaboli[sz]e?d?\b", r"\bmetabolism\b", r"\bcyp\s?\d", r"\bcyp[0-9]{1}[a-z]", r"\benzyme\b", r"\bp[- ]?450\b",
        r"\binduce.{0,20}(metaboli|cyp|enzyme)", r"\binhibit.{0,20}(metaboli|cyp|enzyme)", r"\bhepatic clearance\b", r"\bdemethylation\b", r"\boxidation\b",
    ),
    "PK_Absorption": (
        r"\babsorption\b", r"\babsorb\b", r"\bchelat", r"\bcomplex formation\b", r"\bgastric (emptying|ph)\b", r"\bgi absorption\b", r"\bbioavailability\b",
    ),
    "PK_Distribution": (
        r"\bprotein[- ]?bind", r"\bdisplace.{0,20}(protein|binding|albumin)", r"\balbumin\b", r"\bplasma (protein|bound)\b", r"\bdistribution volume\b",
        r"\bserum concentration\b", r"\bp[- ]?gp\b", r"\babcb1\b", r"\boatp",
    ),
    "PK_Excretion": (
        r"\brenal clearance\b", r"\bexcret", r"\belimination half[- ]?life\b", r"\btubular secretion\b", r"\bglomerular\b", r"\burinary excretion\b",
        r"\bbiliary\b", r"\brenal tubule\b",
    ),
    "PD_Activity": (
        r"\bpharmacodynamic\b", r"\badditive (effect|activity|action)\b", r"\bsynerg", r"\bpotentia[lt]e\b",
        r"\bboth (drugs )?(increase|decrease|enhance|reduce|share)\b", r"\bshare.{0,20}(mechanism|activity|pharmacolog)",
        r"\benhance the (activity|effect|action)\b", r"\bantagoniz(e|es|ed|ing)\b", r"\boppos(e|ing|es) the (action|effect|activity)\b",
        r"\breceptor (agonist|antagonist|activity)\b", r"\banti[- ]?hypertensive\b", r"\bhypotensive\b", r"\bcns depress", r"\bsedative\b",
        r"\banticoagulant\b", r"\bantiplatelet\b", r"\bhypoglycemic effect\b", r"\bvasodilat", r"\bserotonergic\b", r"\banticholinergic\b",
    ),
    "Efficacy": (
        r"\btherapeutic efficacy\b", r"\btherapeutic effect\b", r"\b(reduc|decreas|diminish|impair|lower).{0,20}(efficacy|effectiveness)\b",
        r"\bloss of (efficacy|effectiveness)\b", r"\bdiagnostic (effectiveness|efficacy|purpose|utility)\b", r"\btreatment failure\b", r"\bfailure of therapy\b",
    ),
    "AdverseRisk": (
        r"\b(increase|elevat|heighten|raise).{0,20}risk of\b", r"\brisk of\b", r"\bmay (cause|lead to|result in)\b", r"\bqt prolong", r"\btorsade",
        r"\bbleed", r"\bhemorrhag", r"\bthrombocytopen", r"\bhyperkalem", r"\bhypokalem", r"\bhypoglycem(?!ic effect)", r"\bhypertension\b",
        r"\bhypotension\b", r"\bserotonin syndrome\b", r"\bnephrotox", r"\bhepatotox", r"\bcardiotox", r"\bneurotox", r"\bototox", r"\bmyopathy\b",
        r"\brhabdomyol", r"\bseizure\b", r"\bmethemoglobinemia\b", r"\bangioedema\b",
    ),
    "Other": (r"\bunmatched\b", r"\bmiscellaneous\b", r"\buncategoriz(ed|able)\b"),
}


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def rationale() -> Column:
    """Whether a step reasons: no meta role, and a claim of some words."""
    return ~F.coalesce(F.col("role"), F.lit("")).isin(*META_ROLES) & (word_count(F.col("claim")) >= MIN_CLAIM_WORDS)


def faithfulness(steps: DataFrame, fractional: bool = False) -> DataFrame:
    """(pair_id, family, n_counted, score): mean over the reasoning steps of whether
    any cited id is in the context (or of their share); 0 without such steps."""
    n = F.size("evidence")
    hit = citations.resolved(F.col("evidence"), F.col("pool"))
    score = F.when(n > 0, hit / n).otherwise(0.0) if fractional else (hit > 0).cast("double")
    scored = steps.withColumn("pool", citations.expanded(F.col("context"))).select("pair_id", "family", rationale().alias("counted"), score.alias("s"))
    return scored.groupBy("pair_id", "family").agg(
        F.count_if("counted").alias("n_counted"), F.coalesce(F.avg(F.when(F.col("counted"), F.col("s"))), F.lit(0.0)).alias("score")
    )


def by_family(traces: DataFrame, score: str = "score") -> DataFrame:
    """Mean over the traces of each family; ``macro`` and ``weighted`` rows have no family."""
    each = traces.groupBy("family").agg(F.count("*").alias("n"), F.avg(score).alias("m"))
    rows = each.select("family", "n", F.round("m", 6).alias("score"), F.lit("family").alias("level"))
    whole = each.agg(F.sum("n").alias("n"), F.avg("m").alias("macro"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("weighted"))
    levels = whole.select(F.lit(None).cast("string").alias("family"), "n", F.expr("stack(2, 'macro', macro, 'weighted', weighted) AS (level, s)"))
    return rows.unionByName(levels.select("family", "n", F.round("s", 6).alias("score"), "level"))


def any_cue(cues: tuple[str, ...]) -> str:
    """One pattern for a family's cues.  Where all begin at a word's edge it is asked for once,
    so that no cue is tried elsewhere."""
    edge = r"\b"
    if all(c.startswith(edge) for c in cues):
        return edge + "(?:" + "|".join(f"(?:{c[len(edge):]})" for c in cues) + ")"
    return "|".join(f"(?:{c})" for c in cues)


def implied_family(steps: DataFrame, classify=None) -> DataFrame:
    """(pair_id, implied, gap): the family that most reasoning steps point to by their
    cues, at first sight on a tie; null without cues.  ``gap`` tells whether a step
    states that evidence is missing.

    ``classify`` maps a claim to an array of families; the default uses ``CUES``.  Rows with
    an array ``steps`` of (role, claim), in their order, give their own pair's: no grouping.
    """
    if "steps" in steps.columns:
        return implied_in_row(steps)
    claim = F.lower(F.coalesce("claim", F.lit("")))
    if classify is None:
        named = [F.when(claim.rlike(any_cue(cues)), F.struct(F.lit(k).alias("k"), F.lit(f).alias("f"))) for k, (f, cues) in enumerate(CUES.items())]
        found = F.filter(F.array(*named), F.isnotnull)
    else:
        found = F.transform(classify(F.col("claim")), lambda f, k: F.struct(k.alias("k"), f.alias("f")))
    meta = F.coalesce(F.col("role"), F.lit("")).isin(*META_ROLES)
    hits = steps.where(~meta).select("pair_id", "step_id", F.inline(found)).groupBy("pair_id", "f").agg(
        F.count("*").alias("n"), F.min(F.struct("step_id", "k")).alias("first")
    )
    best = hits.groupBy("pair_id").agg(F.max_by("f", F.struct("n", -F.col("first.step_id"), -F.col("first.k"))).alias("implied"))
    gaps = steps.groupBy("pair_id").agg(F.bool_or(F.coalesce(F.col("role"), F.lit("")).isin("abstention", "evidence_gap")).alias("gap"))
    return gaps.join(best, "pair_id", "left")


def implied_in_row(rows: DataFrame) -> DataFrame:
    """``rows`` with ``gap`` and ``implied`` instead of ``steps``: each cue's pattern is tried once
    for a step, and the steps that name a family are counted in an array."""
    said = F.filter("steps", lambda s: ~F.coalesce(s["role"], F.lit("")).isin(*META_ROLES))
    gap = F.exists("steps", lambda s: F.coalesce(s["role"], F.lit("")).isin("abstention", "evidence_gap"))
    rows = rows.withColumns({"gap": gap, "_claims": F.transform(said, lambda s: F.lower(F.coalesce(s["claim"], F.lit(""))))}).drop("steps")

    def hits(cues: tuple[str, ...]) -> Column:
        return F.transform("_claims", lambda c: c.rlike(any_cue(cues)))

    rows = rows.withColumns({f"_in{k}": hits(cues) for k, cues in enumerate(CUES.values())})
    # (n, first step, family's place), the latter two negative: the greatest is the family.
    found = [
        F.struct(F.size(F.array_remove(f"_in{k}", False)).alias("n"), (-F.array_position(f"_in{k}", True)).alias("place"), F.lit(-k).alias("k"), F.lit(f).alias("f"))
        for k, f in enumerate(CUES)
    ]
    top = F.greatest(*(F.when(F.array_contains(f"_in{k}", True), x) for k, x in enumerate(found)))
    return rows.withColumn("implied", top["f"]).drop("_claims", *(f"_in{k}" for k in range(len(CUES))))


def coherence(predictions: DataFrame, implied: DataFrame | None = None) -> DataFrame:
    """By family: share of predictions that agree with their reasoning (or abstain
    with a stated gap), and of those whose reasoning points nowhere.  Without ``implied``
    the predictions carry its columns."""
    ok = F.when(F.col("abstain"), F.col("gap")).otherwise(F.coalesce(F.col("implied") == F.col("pred_family"), F.lit(False)))
    rows = predictions if implied is None else predictions.join(implied, "pair_id")
    return rows.groupBy("family").agg(
        F.count("*").alias("n"), F.round(F.avg(ok.cast("double")), 6).alias("coherent"),
        F.round(F.avg((~F.col("abstain") & F.col("implied").isNull()).cast("double")), 6).alias("indeterminate"),
    )


def step_scores(steps: DataFrame, exclude_meta: bool = False) -> DataFrame:
    """Aggregates of the step scores of each trace: mean, least, least plus a tenth of
    the second, geometric mean (floor 1e-9), and the last one."""
    rows = steps.where(F.col("score").isNotNull())
    if exclude_meta:
        rows = rows.where(~F.coalesce(F.col("role"), F.lit("")).isin(*META_ROLES))
    low = F.array_sort(F.collect_list("score"))
    by = rows.groupBy("pair_id", "family").agg(
        F.avg("score").alias("mean"), low.alias("low"), F.exp(F.avg(F.ln(F.greatest("score", F.lit(1e-9))))).alias("geo"), F.max_by("score", "step_id").alias("final"),
    )
    first, second = F.get("low", F.lit(0)), F.coalesce(F.get("low", F.lit(1)), F.get("low", F.lit(0)))
    return by.select(
        "pair_id", "family", F.round("mean", 6).alias("mean"), F.round(first, 6).alias("least"), F.round(first + 0.1 * second, 6).alias("min_plus"),
        F.round("geo", 6).alias("geomean"), F.round("final", 6).alias("final"),
    )


def mentions(text: Column) -> Column:
    """All entity mentions of a text, by pattern and then in order."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in ENTITIES))


def hallucination(steps: DataFrame, known: DataFrame, extract=mentions) -> DataFrame:
    """(pair_id, family, n_mentions, n_unknown, rate) against ``known(entity)``.

    Names are compared in upper case.  ``extract`` maps a text to its mentions.
    """
    named = steps.select("pair_id", "family", F.explode_outer(extract(F.col("claim"))).alias("m")).withColumn("u", F.upper("m"))
    vocabulary = known.select(F.upper("entity").alias("u"), F.lit(True).alias("known")).distinct()
    by = named.join(vocabulary, "u", "left").groupBy("pair_id", "family").agg(
        F.count("m").alias("n_mentions"), F.count_if(F.col("m").isNotNull() & F.col("known").isNull()).alias("n_unknown")
    )
    return by.withColumn("rate", F.round(F.when(F.col("n_mentions") > 0, F.col("n_unknown") / F.col("n_mentions")).otherwise(0.0), 6))


def top_unknown(steps: DataFrame, known: DataFrame, n: int = 20) -> DataFrame:
    named = steps.select(F.explode(mentions(F.col("claim"))).alias("m")).withColumn("u", F.upper("m"))
    fresh = named.join(known.select(F.upper("entity").alias("u")).distinct(), "u", "left_anti")
    return fresh.groupBy("m").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "m").limit(n)


def hint_majority(steps: DataFrame, keep_conclusion: bool = False) -> DataFrame:
    """(pair_id, winner, n_hints, n_winner): plurality of the hints, the first on a tie."""
    rows = steps.where(F.col("hint").isin(*FAMILIES))
    if not keep_conclusion:
        rows = rows.where(F.coalesce(F.col("role"), F.lit("")) != "conclusion")
    by = rows.groupBy("pair_id", "hint").agg(F.count("*").alias("n"), F.min("step_id").alias("first"))
    return by.groupBy("pair_id").agg(
        F.max_by("hint", F.struct("n", -F.col("first"))).alias("winner"), F.sum("n").alias("n_hints"), F.max("n").alias("n_winner"),
        F.map_from_entries(F.collect_list(F.struct("hint", "n"))).alias("counts"),
    )


def times(values: str, value: Column) -> Column:
    """How often ``value`` stands in an array; null for null."""
    return F.size(values) - F.size(F.array_remove(values, value))


def rescued(predictions: DataFrame, steps: DataFrame | None, min_steps: int = 3, strength: float = 0.5, max_share: float = 1.0, max_confidence: float = 1.0) -> DataFrame:
    """Predictions whose steps outvote their family: (pair_id, pred_family, rescue, final).

    Without ``steps`` the predictions carry an array ``hints``, those of their steps but the
    conclusion in the order of steps, and nothing is grouped or joined.
    """
    if steps is None:
        rows = predictions.select("*", F.inline(F.array(F.struct(F.filter("hints", lambda h: h.isin(*FAMILIES)).alias("named")))))
        votes = F.transform(F.array_distinct("named"), lambda h: F.struct(times("named", h).alias("n"), (-F.array_position("named", h)).alias("place"), h.alias("hint")))
        rows = rows.select("*", F.size("named").alias("n_hints"), F.inline(F.array(F.struct(F.array_max(votes).alias("top"))))).withColumns({"winner": F.col("top.hint"), "n_winner": F.col("top.n")})
        own = F.coalesce(times("named", F.col("pred_family")), F.lit(0))
    else:
        rows = predictions.join(hint_majority(steps), "pair_id", "left")
        own = F.coalesce(F.try_element_at("counts", F.col("pred_family")), F.lit(0))
    go = (
        (F.col("n_hints") >= min_steps) & (F.col("winner") != F.col("pred_family")) & (F.col("n_winner") >= strength * F.col("n_hints"))
        & (own < F.col("n_winner")) & (own <= max_share * F.col("n_hints")) & (F.col("confidence") <= max_confidence)
    )
    rescue = F.when(go, F.col("winner"))
    return rows.select("pair_id", "family", "pred_family", rescue.alias("rescue"), F.coalesce(rescue, "pred_family").alias("final"))


def reasoning_audit(predictions: DataFrame, steps: DataFrame) -> DataFrame:
    """By family: where trace majority and final answer part, what trusting the steps
    would mend and break, and the net."""
    rows = predictions.where(~F.col("abstain")).join(hint_majority(steps, True).select("pair_id", "winner"), "pair_id", "left")
    apart = F.col("winner").isNotNull() & (F.col("winner") != F.col("pred_family"))
    mend, spoil = apart & (F.col("winner") == F.col("family")), apart & (F.col("pred_family") == F.col("family"))
    return rows.groupBy("family").agg(
        F.count("*").alias("n"), F.count_if(apart).alias("disagree"), F.count_if(mend).alias("mended"), F.count_if(spoil).alias("spoiled"),
        (F.count_if(mend) - F.count_if(spoil)).alias("net"),
    )


def trace_errors(steps: DataFrame, least: int = 3, most: int = 8) -> DataFrame:
    """(pair_id, errors): what a trace breaks of its form, in a fixed order."""
    by = steps.groupBy("pair_id").agg(
        F.array_sort(F.collect_list("step_id")).alias("ids"), F.max_by("role", "step_id").alias("last"), F.count("*").alias("n"),
        F.bool_or(F.trim(F.coalesce("claim", F.lit(""))) == "").alias("blank"), F.bool_or(F.col("evidence").isNull()).alias("bare"),
        F.bool_or(F.col("step_id") != F.floor("step_id")).alias("odd"),
    )
    checks = F.array(
        F.when((F.col("n") < least) | (F.col("n") > most), "step_count"), F.when(F.col("ids") != F.sequence(F.lit(1), F.col("n").cast("int")), "step_ids"),
        F.when(F.coalesce(F.col("last"), F.lit("")) != "conclusion", "no_conclusion"), F.when(F.col("blank"), "empty_claim"), F.when(F.col("bare"), "no_evidence_list"),
    )
    return by.select("pair_id", F.array_join(F.filter(checks, F.isnotnull), ",").alias("errors"))


def critique(errors: DataFrame, n: int = 5) -> DataFrame:
    """The first errors of a trace as one sentence."""
    listed = F.slice(F.split("errors", ","), 1, n)
    return errors.where("errors <> ''").select("pair_id", F.concat(F.lit("Fix: "), F.array_join(listed, "; "), F.lit(".")).alias("critique"))


def banned_phrases(steps: DataFrame) -> DataFrame:
    """(pair_id, banned): whether a claim holds a phrase that only abstentions may use."""
    hit = F.lower(F.coalesce("claim", F.lit(""))).rlike("|".join(BANNED))
    return steps.groupBy("pair_id").agg((F.bool_or(hit) & ~F.bool_or("abstain")).alias("banned"))


def step_labels(steps: DataFrame) -> DataFrame:
    """(pair_id, step_id, label): 1 where all evidence is in the context, the hint is
    the gold family and no phrase is banned."""
    pool = citations.expanded(F.col("context"))
    grounded = (F.size("evidence") > 0) & (citations.resolved(F.col("evidence"), F.col("pool")) == F.size("evidence"))
    clean = ~F.lower(F.coalesce("claim", F.lit(""))).rlike("|".join(BANNED))
    return steps.withColumn("pool", pool).select("pair_id", "step_id", (grounded & (F.col("hint") == F.col("family")) & clean).cast("int").alias("label"))


def step_text(steps: DataFrame) -> DataFrame:
    """(pair_id, text): the steps of a trace as numbered lines."""
    line = F.concat(F.lit("Step "), F.col("step_id").cast("string"), F.lit(" ["), F.coalesce("role", F.lit("")), F.lit("] "), F.coalesce("claim", F.lit("")))
    rows = steps.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("step_id", line.alias("line")))).alias("x"))
    return rows.select("pair_id", F.array_join(F.transform("x", lambda s: s["line"]), "\n").alias("text"))


def step_counts(steps: DataFrame) -> DataFrame:
    """Traces by number of reasoning steps and outcome."""
    by = steps.groupBy("pair_id").agg(F.count_if(rationale()).alias("n_steps"), F.bool_or(~F.col("abstain") & (F.col("pred_family") == F.col("family"))).alias("ok"))
    return by.groupBy("n_steps", "ok").agg(F.count("*").alias("n"))


def holdout(steps: DataFrame, share: float = 0.05, seed: str = "prm-1") -> DataFrame:
    """Every step with train or val; the steps of one pair stay together."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "pair_id").cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return steps.select("pair_id", "step_id", F.when(u < share, "val").otherwise("train").alias("part"))


def keyword_overlap(a: Column, b: Column, least: int = 4) -> Column:
    """Whether two subtypes mean the same: equal once normalised, one within the other,
    or with a common word of ``least`` letters."""
    def norm(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))

    x, y = norm(a), norm(b)

    def long_words(t: Column) -> Column:
        return F.filter(F.split(t, " "), lambda w: F.length(w) >= least)

    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | F.arrays_overlap(long_words(x), long_words(y)))


def ranked_candidates(steps_by_candidate: DataFrame) -> DataFrame:
    """Best candidate of a pair: passed, last step, geometric mean, mean, least, number."""
    w = Window.partitionBy("pair_id").orderBy(F.desc("passed"), F.desc("final"), F.desc("geomean"), F.desc("mean"), F.desc("least"), "candidate_id")
    return steps_by_candidate.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
