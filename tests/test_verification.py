"""Hand values of the rule checks of traces, alignment rows and rescue ceilings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from mechpairs.functions.features import direction_tag
from mechpairs.operators import counterfactuals as cf
from mechpairs.operators import verification as v

STEP = "pair_id string, step_id int, role string, claim string, hint string"
PRED = "pair_id string, family string, pred_family string, abstain boolean, confidence double"


def test_violations(spark):
    steps = spark.createDataFrame(
        [
            ("p1", 1, "pk_flag", "A is a CYP3A4 inhibitor", None), ("p1", 2, "conclusion", "B is raised", None),
            ("p2", 1, "pk_flag", "A inhibits cyp3a4", None), ("p2", 2, "pk_flag", "B is a substrate of CYP3A4", None), ("p2", 3, "conclusion", "B may rise", None),
            ("p3", 1, "evidence_gap", None, None), ("p3", 2, None, "it could bleed", None),
            ("p4", 1, "neighbor_pair", "An analogous pair although no neighbor is known", None),
            ("p5", 1, "protein", "both bind albumin", None),
        ], STEP)
    predictions = spark.createDataFrame(
        [
            ("p1", "Efficacy", "PK_Metabolism", False, 0.9), ("p2", "Efficacy", "PK_Metabolism", False, 0.4), ("p3", "Efficacy", "AdverseRisk", False, 0.5),
            ("p4", "Efficacy", "AdverseRisk", False, 0.5), ("p5", "Efficacy", "PK_Distribution", True, None), ("p6", "Efficacy", "PK_Excretion", None, None),
        ], PRED)
    got = {r.pair_id: r for r in v.violations(predictions, steps).collect()}
    # unpaired 1.8; speculative 0.8 + unsure 0.5 - paired 0.6; adverse 1.5 + gap 1.2 + speculative 0.8;
    # invented 0.8 - neighbor 0.3; nothing; unsure 0.5
    assert {k: r.violation_score for k, r in got.items()} == {"p1": 1.8, "p2": 0.7, "p3": 3.5, "p4": 0.5, "p5": 0.0, "p6": 0.5}
    assert got["p6"].pk_nonmetab_without_transport and not got["p5"].pk_nonmetab_without_transport
    assert not got["p4"].gap_non_abstain and got["p4"].weak_gap_non_abstain


def test_least_suspicious_and_curve(spark):
    judged = spark.createDataFrame(
        [
            ("p1", "v1", 0.5, 0.9, True), ("p1", "v2", 0.5, 0.9, False), ("p2", "v1", 0.5, 0.9, True), ("p2", "v2", 0.5, 0.8, False),
            ("p3", "pre", 0.0, None, None), ("p3", "old", 0.0, None, True), ("p4", "v1", 1.8, 1.0, True), ("p4", "pre", 1.5, 0.0, False),
        ], "pair_id string, source string, violation_score double, confidence double, ok boolean")
    best = {r.pair_id: r.source for r in v.least_suspicious(judged, ("v2", "v1", "pre")).collect()}
    assert best == {"p1": "v2", "p2": "v1", "p3": "pre", "p4": "pre"}
    curve = {r.threshold: tuple(r)[1:] for r in v.violation_curve(judged, "ok", (0.0, 0.5, 1.5, 9.0)).collect()}
    assert curve == {0.0: (0, 0.0, 0.0, 0.5), 0.5: (2, 0.25, 0.5, 0.5), 1.5: (6, 0.75, 0.5, 0.5), 9.0: (8, 1.0, 0.5, 1.0)}
    assert v.violation_curve(judged.limit(0), "ok").count() == 0 and v.least_suspicious(judged.limit(0), ()).count() == 0


def test_description_overlap(spark):
    made = spark.createDataFrame([("Serum protein and serum", "the SERUM level"), ("nothing listed", "x"), (None, None), ("risk of bleeding", None)], "d string, s string")
    assert [r[0] for r in made.select(v.description_overlap(F.col("d"), F.col("s"))).collect()] == [0.5, 1.0, 1.0, 0.0]


def test_evidence_density(spark):
    made = spark.createDataFrame([("p", "moa", None, ["x", "y"]), ("q", "", "m", None), ("r", "a", "b", ["c"])], "pair_id string, ma string, mb string, shared array<string>")
    got = {r.pair_id: (r.n_ma, r.n_mb, r.n_shared, r.n_pools, r.sparse) for r in v.evidence_density(made, ["ma", "mb"], ["shared"]).collect()}
    assert got == {"p": (1, 0, 2, 2, True), "q": (0, 1, 0, 1, True), "r": (1, 1, 1, 3, False)}


@pytest.fixture
def answers(spark):
    steps = spark.createDataFrame([(p, 1, "protein", "", h) for p, h in (("w1", "Efficacy"), ("w2", "Efficacy"), ("w3", "PD_Activity"), ("a1", "Efficacy"), ("ok", "Efficacy"))], STEP)
    return spark.createDataFrame(
        [
            ("w1", "Efficacy", "PD_Activity", False, 0.2), ("w2", "Efficacy", None, False, 0.99), ("w3", "Efficacy", "PD_Activity", False, 0.9),
            ("a1", "Efficacy", "PD_Activity", True, None), ("ok", "Efficacy", "Efficacy", False, 0.9),
        ], PRED), steps


def test_alignment_set(answers):
    got = {r.pair_id: (r.tier, r.sample_weight, r.confidence) for r in v.alignment_set(*answers, demos=7).collect()}
    assert got == {"w1": ("trace_align", 1.5, 0.85), "w2": ("trace_align", 1.5, 0.97), "a1": ("trace_align", 1.5, 0.85), "ok": ("trace_align_demo", 0.5, 0.9)}
    assert {r.pair_id for r in v.alignment_set(*answers, traced=False).collect()} == {"w1", "w2", "w3", "a1"}
    assert v.alignment_set(*answers, cap=2).count() == 2


def test_rescue_ceiling(answers):
    got = {r.share: (r.n_fixed, r.macro_f1) for r in v.rescue_ceiling(*answers, shares=(0.0, 0.5, 1.0)).collect()}
    # Efficacy: 1 of 5 found, then 2, then 3; F1 is 2 / 6, 4 / 7 and 6 / 8, the mean over seven families.
    assert got == {0.0: (0, round(1 / 21, 6)), 0.5: (1, round(4 / 49, 6)), 1.0: (2, round(6 / 56, 6))}


def test_direction_tag(spark):
    made = spark.createDataFrame([("a", False, "ab"), ("a", False, "ba"), ("b", None, None), ("c", False, "ab"), (None, False, "ab"), ("a", True, "ab")], "s string, bi boolean, o string")
    tag = lambda fallback: direction_tag(F.col("s"), F.lit("a"), F.lit("b"), F.col("bi"), F.col("o"), fallback)
    got = [tuple(r) for r in made.select(tag("bidirectional"), tag(None)).collect()]
    assert got == [("a_to_b",) * 2, ("b_to_a",) * 2, ("b_to_a",) * 2, ("bidirectional", None), ("bidirectional", None), ("bidirectional",) * 2]


def test_pk_evidence(spark):
    flags = spark.createDataFrame(
        [("a", "cyp3a4", "inh"), ("a", "cyp3a4", "ind"), ("b", "cyp3a4", "sub"), ("b", "cyp1a2", "inh"), ("a", "cyp1a2", "sub"), ("b", "oct1", "inh"), ("b", "bcrp", "sub")],
        "entity string, prefix string, kind string")
    pairs = spark.createDataFrame([("p", "a", "b"), ("q", "a", "c")], "pair_id string, a_id string, b_id string")
    assert [tuple(r) for r in cf.pk_evidence(pairs, flags).collect()] == [("p", "cyp1a2", [
        "enzyme_CYP1A2", "pk_flag_cyp1a2_inhibitor_B", "pk_flag_cyp1a2_substrate_A",
        "enzyme_CYP3A4", "pk_flag_cyp3a4_inhibitor_A", "pk_flag_cyp3a4_inducer_A", "pk_flag_cyp3a4_substrate_B"])]


def test_shared_and_adversarial_evidence(spark):
    made = spark.createDataFrame(
        [
            ("p", "PK_Excretion", "cyp1a2", ["x"], ["y"], None, None), ("q", "PK_Excretion", None, ["x"], ["y"], ["w"], ["w"]), ("r", "PK_Excretion", None, [], ["y"], None, None),
            ("s", "Efficacy", None, None, None, None, None), ("t", None, None, None, None, None, None), ("u", "PK_Absorption", None, ["z", "x"], ["x", "z"], [], ["w"]),
        ], "pair_id string, family string, prefix string, a_proteins array<string>, b_proteins array<string>, a_pathways array<string>, b_pathways array<string>")
    shared = dict(made.select("pair_id", cf.shared_evidence(*(F.col(f"{e}_{k}s") for k in ("protein", "pathway") for e in ("a", "b")))).collect())
    assert shared == {"p": [], "q": ["pathway_w"], "r": [], "s": [], "t": [], "u": ["protein_x", "protein_z"]}
    got = {r.pair_id: r for r in cf.adversarial_evidence(made).collect()}
    assert {k: (r.kind, r.claimed) for k, r in got.items()} == {
        "p": ("enzyme_swap", "PK_Metabolism"), "q": ("cross_family_swap", "PD_Activity"), "r": ("no_proteins", None), "s": ("cross_family_swap", "PK_Metabolism"),
        "t": ("unknown_family", None), "u": ("cross_family_swap", "PD_Activity")}
    assert got["q"].ids == ["protein_x", "protein_y", "pathway_w", "pathway_w"] and len(got["u"].ids) == 2
    assert "CYP1A2" not in got["p"].ids[0] and len(got["s"].ids) == 3 and got["r"].ids is None
