"""Reasoning steps and probes over the label frames, made from md5 digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames
from .frames import apart, digits, draws, hex_int, next_family, spread

CLAIMS = (
    "CYP3A4 inhibition reduces metabolism of the drug", "risk of bleeding may rise with both drugs", "renal clearance via OCT2 is lowered",
    "binds P02768 and displaces albumin in plasma", "absorption falls through chelation in the gut", "additive effect on sedative activity see DB00316",
    "therapeutic efficacy is lost on hsa:05200", "not known",
)
EVIDENCE = (("CYP3A4_substrate", "hsa:05200"), ("pathway_jaccard = 0.1",), ("zz9",), ())
CONTEXTS = (("cyp3a4_sub", "hsa:05200"), ("cyp2d6_inh", "pathway_jaccard"))
KNOWN = ("CYP3A4", "P02768", "hsa:05200")
N_STEPS = 4


def texts(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def choose(n: Column, options: list[Column]) -> Column:
    return F.get(F.array(*options), n.cast("int"))


def forward(s: SparkSession, d: str) -> DataFrame:
    return frames.scored(s, d, ("ab",))


def steps(s: SparkSession, d: str) -> DataFrame:
    y = hex_int(F.md5(F.concat_ws("|", "pair_id", F.lit("x1")).cast("binary")), 1, 1)
    context = choose(y % 2, [texts(c) for c in CONTEXTS])
    x = F.col("d")
    return forward(s, d).select("pair_id", "family", "pred_family", "abstain", "confidence", context.alias("context"), spread("step_id", tuple(range(1, N_STEPS + 1)), "s1")).select(
        "pair_id", "family", "pred_family", "abstain", "confidence", "step_id", role(F.col("step_id"), x).alias("role"),
        claim(x).alias("claim"), evidence(x).alias("evidence"),
        hint(F.col("step_id"), x).alias("hint"),
        F.round(digits(x, 5, 4) / 65535, 3).alias("score"), "context",
    )


def role(step_id: Column, x: Column) -> Column:
    return F.when(step_id == N_STEPS, "conclusion").when(digits(x, 1, 1) < 7, "pk_flag").when(digits(x, 1, 1) < 13, "protein").otherwise("evidence_gap")


def claim(x: Column) -> Column:
    return choose(digits(x, 2, 1) % len(CLAIMS), [F.lit(c) for c in CLAIMS])


def evidence(x: Column) -> Column:
    return choose(digits(x, 3, 1) % len(EVIDENCE), [texts(e) for e in EVIDENCE])


def hint(step_id: Column, x: Column) -> Column:
    return F.when((step_id == N_STEPS) | (digits(x, 4, 1) >= 9), F.col("pred_family")).otherwise(F.col("family"))


def with_steps(s: SparkSession, d: str, **made: Callable[[int, Column], Column]) -> DataFrame:
    """``forward`` with arrays over the steps of each pair, which follow from it: of each of
    ``made``, called with a step's number and the head of its digest.  No grouping, no join."""
    rows = forward(s, d).select("*", apart(x=draws(tuple(range(1, N_STEPS + 1)), "s1")))
    each = {name: F.array(*(one(k, F.get("x", F.lit(k - 1))) for k in range(1, N_STEPS + 1))) for name, one in made.items()}
    return rows.select("*", apart(**each)).drop("x")


def known_entities(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(k,) for k in KNOWN], "entity string")


def distribution(confidence: Column, family: Column) -> Column:
    """A map with the confidence on one family and the rest on the next."""
    return F.map_from_arrays(F.array(family, next_family(family)), F.array(confidence, F.lit(1.0) - confidence))


def flips(s: SparkSession, d: str) -> DataFrame:
    """Perturbed predictions: relevant ones move the confidence down, null ones hardly."""
    x = F.md5(F.concat_ws("|", "pair_id", F.lit("f1")).cast("binary"))
    rows = forward(s, d).withColumn("x", x)
    rel = hex_int(F.col("x"), 1, 1) < 8
    c = F.col("confidence")
    return rows.select(
        "pair_id", F.concat(F.lit("flag_"), (hex_int(F.col("x"), 2, 1) % 3).cast("string")).alias("perturbation"), rel.alias("relevant"),
        distribution(c, F.col("pred_family")).alias("p_original"), distribution(F.when(rel, c * 0.5).otherwise(c * 0.98), F.col("pred_family")).alias("p_perturbed"),
    )


def evidence_probes(s: SparkSession, d: str) -> DataFrame:
    x = F.md5(F.concat_ws("|", "pair_id", F.lit("r1")).cast("binary"))
    rows, f = forward(s, d).withColumn("x", x), F.col("family")
    return rows.select(
        "pair_id", "family", F.when(hex_int(F.col("x"), 1, 1) < 12, f).otherwise(next_family(f)).alias("true_ev"), F.when(hex_int(F.col("x"), 2, 1) < 8, f).otherwise(next_family(f)).alias("adv_ev"),
        F.when(hex_int(F.col("x"), 4, 1) < 14, F.when(hex_int(F.col("x"), 3, 1) < 10, f).otherwise(next_family(f))).alias("no_ev"),
    )


def gated_inputs(s: SparkSession, d: str) -> DataFrame:
    """(pair_id, family, pred_family, confidence, entropy, prm, ok) for abstention gates."""
    from ..operators.distributions import entropy

    prm = F.round(hex_int(F.md5(F.concat_ws("|", "pair_id", F.lit("g1")).cast("binary")), 1, 4) / 65535, 3)
    rows = forward(s, d)
    return rows.select(
        "pair_id", "family", "pred_family", "abstain", "confidence", F.round(entropy(distribution(F.col("confidence"), F.col("pred_family"))), 6).alias("entropy"),
        F.when(prm < 0.95, prm).alias("prm"), (F.col("pred_family") == F.col("family")).alias("ok"), distribution(F.col("confidence"), F.col("pred_family")).alias("dist"),
    )
