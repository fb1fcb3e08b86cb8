"""Trace metrics on small traces with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from mechpairs.functions import citations, features
from mechpairs.operators import distributions, gates, metrics, resampling, retrieval, selective, splits, traces, voting
from mechpairs.operators.taxonomy import FAMILIES

POOL = ["cyp3a4_sub", "cyp2d6_inh", "pathway_jaccard", "hsa:05200"]
STEP = "pair_id string, family string, pred_family string, abstain boolean, step_id int, role string, claim string, evidence array<string>, hint string, score double, context array<string>"


def steps(spark, extra=()):
    meet = "CYP3A4 inhibition slows the metabolism"
    rows = [
        ("p", "PK_Metabolism", "PK_Metabolism", False, 1, "pk_flag", meet, ["CYP3A4_substrate"], "PK_Metabolism", 0.88, POOL),
        ("p", "PK_Metabolism", "PK_Metabolism", False, 2, "pk_overlap", "the enzyme is shared", ["cyp2d6", "zz"], "PK_Metabolism", 0.82, POOL),
        ("p", "PK_Metabolism", "PK_Metabolism", False, 3, "conclusion", "so it is metabolism", [], "PK_Metabolism", 0.95, POOL),
        ("q", "AdverseRisk", "AdverseRisk", True, 1, "evidence_gap", "nothing is known here", [], None, None, POOL),
        ("q", "AdverseRisk", "AdverseRisk", True, 2, "abstention", "I cannot tell at all", [], None, None, POOL),
    ]
    return spark.createDataFrame([*rows, *extra], STEP)


def test_faithfulness_with_a_degenerate_trace(spark):
    got = {r.pair_id: (r.n_counted, r.score) for r in traces.faithfulness(steps(spark)).collect()}
    assert got == {"p": (2, 1.0), "q": (0, 0.0)}
    share = {r.pair_id: r.score for r in traces.faithfulness(steps(spark), True).collect()}
    assert share["p"] == 0.75
    levels = {(r.level, r.family): r.score for r in traces.by_family(traces.faithfulness(steps(spark))).collect()}
    assert levels[("macro", None)] == 0.5 and levels[("weighted", None)] == 0.5


def test_citation_forms(spark):
    df = spark.createDataFrame([("CYP3A4_substrate", "cyp3a4_sub"), ("P-gp_inhibitor", "p_gp_inhibitor"), ("pathway_jaccard", "pathway_jaccard"), ("cyp2c9-inducers", "cyp2c9_ind")], "t string, want string")
    assert all(r.got == r.want for r in df.select("want", citations.normalized(F.col("t")).alias("got")).collect())
    pool = spark.createDataFrame([(["cyp2d6_sub", "pgp_inh"], ["CYP2D6", "P-gp", "pathway_jaccard = 0.0", "cyp3a4"])], "ids array<string>, cited array<string>")
    assert pool.select(citations.resolved(F.col("cited"), citations.expanded(F.col("ids"))).alias("n")).first().n == 2


def test_coherence(spark):
    other = [("r", "AdverseRisk", "AdverseRisk", False, 1, "pk_flag", "lower absorption by chelation", [], None, 0.5, POOL)]
    s = steps(spark, other)
    implied = {r.pair_id: (r.implied, r.gap) for r in traces.implied_family(s).collect()}
    assert implied == {"p": ("PK_Metabolism", False), "q": (None, True), "r": ("PK_Absorption", False)}
    preds = s.select("pair_id", "family", "pred_family", "abstain").distinct()
    got = {r.family: r.coherent for r in traces.coherence(preds, traces.implied_family(s)).collect()}
    assert got == {"PK_Metabolism": 1.0, "AdverseRisk": 0.5}


def test_step_scores(spark):
    r = traces.step_scores(steps(spark)).first()
    assert (r["mean"], r.least, r.min_plus, r.final) == (0.883333, 0.82, 0.908, 0.95)
    assert traces.step_scores(steps(spark), True).first()["mean"] == 0.85


def test_hallucination_rates(spark):
    text = [("x", "AdverseRisk", "AdverseRisk", False, 1, "pk_flag", "CYP22Q4 and DB99999 meet OATP9Z9 with hsa:99999", [], None, None, POOL)]
    s = steps(spark).limit(0).unionByName(spark.createDataFrame(text, STEP))
    none = spark.createDataFrame([("CYP3A4",)], "entity string")
    all_ = spark.createDataFrame([("CYP22Q4",), ("DB99999",), ("OATP9Z9",), ("hsa:99999",), ("P-gp",)], "entity string")
    assert tuple(traces.hallucination(s, none).first())[2:] == (4, 4, 1.0) and traces.hallucination(s, all_).first().rate == 0.0


def test_sensitivity_and_intervention(spark):
    rows = [("a", "f", True, {"x": 0.9, "y": 0.1}, {"x": 0.1, "y": 0.9}), ("b", "f", False, {"x": 0.9, "y": 0.1}, {"x": 0.89, "y": 0.11})]
    df = spark.createDataFrame(rows, "pair_id string, perturbation string, relevant boolean, p_original map<string,double>, p_perturbed map<string,double>")
    r = distributions.sensitivity(df).where("perturbation is null").first()
    assert r.on_relevant > 10 * r.on_null and r.on_relevant == pytest.approx(0.8 * math.log(9), abs=1e-4)
    probes = spark.createDataFrame([("f", "f", "f", "f"), ("f", "f", "g", "f"), ("f", "f", "g", "f"), ("f", "g", "g", "g")], "family string, true_ev string, adv_ev string, no_ev string")
    r = distributions.intervention(probes).where("family is null").first()
    assert (r.acc_true, r.acc_adv, r["drop"], r.acc_none, r.robust) == (0.75, 0.25, 0.5, 0.75, False)
    e = spark.createDataFrame([({"x": 1.0},), ({"x": 0.5, "y": 0.5},), ({},)], "d map<string,double>").select(distributions.entropy(F.col("d")).alias("h")).collect()
    assert [round(x.h, 6) for x in e] == [0.0, round(math.log(2), 6), 0.0]


def test_rescue_and_errors(spark):
    more = [("s", "Efficacy", "AdverseRisk", False, k, "pk_flag" if k < 4 else "conclusion", f"claim number {k} here", [], "Efficacy", 0.5, POOL) for k in range(1, 5)]
    s = steps(spark, more)
    preds = s.select("pair_id", "family", "pred_family", F.lit(0.5).alias("confidence")).distinct()
    got = {r.pair_id: r.final for r in traces.rescued(preds, s).collect()}
    assert got == {"p": "PK_Metabolism", "q": "AdverseRisk", "s": "Efficacy"}
    errors = {r.pair_id: r.errors for r in traces.trace_errors(s).collect()}
    assert errors == {"p": "", "q": "step_count,no_conclusion", "s": ""}
    assert [r.critique for r in traces.critique(traces.trace_errors(s)).collect()] == ["Fix: step_count; no_conclusion."]


def test_gate_threshold_parts_right_from_wrong(spark):
    rows = [(f"r{k}", 0.9, True) for k in range(90)] + [(f"w{k}", 0.2, False) for k in range(10)]
    df = spark.createDataFrame(rows, "pair_id string, prm double, ok boolean")
    r = selective.quantile_thresholds(df, "prm", "ok", (0.05, 0.1, 0.5), True).first()
    assert (round(r.threshold, 6), r.coverage, r.accuracy, r.baseline) == (0.55, 0.9, 1.0, 0.9)
    assert selective.quantile_thresholds(df.limit(0), "prm", "ok", (0.5,), True).first().threshold is None


def test_calibration_stops_at_the_first_failure(spark):
    rows = [("f", "f", 0.9), ("f", "f", 0.8), ("g", "f", 0.7), ("f", "f", 0.6), ("f", "f", 0.5), ("f", "f", 0.4)]
    df = spark.createDataFrame(rows, "family string, pred_family string, confidence double")
    got = {r.family: (r.tau, r.fallback) for r in selective.calibrated(df, 0.8, 0.3).collect()}
    assert got == {"f": (0.8, "none"), None: (0.4, "none")}


def test_preferences_by_tier(spark):
    rows = [("d", "AdverseRisk", "a_to_b", "full_correct", ["x", "y"]), ("b", "AdverseRisk", "bidirectional", "full_correct", ["x"]), ("n", "Efficacy", "a_to_b", "near_miss", ["x"]), ("z", "Efficacy", "a_to_b", "drop", ["x"])]
    df = spark.createDataFrame(rows, "pair_id string, family string, direction string, tier string, evidence array<string>")
    got = {(r.pair_id, r.kind): (r.chosen, r.rejected) for r in gates.preferences(df, FAMILIES, 9).collect()}
    assert got == {
        ("d", "direction_flip"): ("AdverseRisk a_to_b x+y", "AdverseRisk b_to_a x+y"), ("d", "evidence_drop"): ("AdverseRisk a_to_b x+y", "AdverseRisk a_to_b"),
        ("d", "family_swap"): ("AdverseRisk a_to_b x+y", "Efficacy a_to_b x+y"), ("b", "family_swap"): ("AdverseRisk bidirectional x", "Efficacy bidirectional x"),
        ("n", "abstain_unsafe"): ("abstain", "Efficacy a_to_b x"),
    }


def test_quotas_fill_up_and_give_back(spark):
    counts = spark.createDataFrame([("a", 100), ("b", 3), ("c", 40)], "family string, n long")
    assert {r.family: r.quota for r in splits.quotas(counts, 30, "balanced").collect()} == {"a": 14, "b": 3, "c": 13}
    assert sum(r.quota for r in splits.quotas(counts, 31, "sqrt_inverse").collect()) == 31
    assert sum(r.quota for r in splits.quotas(counts, 500, "proportional").collect()) == 143


def test_symmetry_corpus_row(spark):
    rows = []
    for k, (gold, ab, ba) in enumerate([("f", "f", "f"), ("f", "f", "g"), ("f", "g", "g"), ("f", "f", "f")]):
        rows += [(f"p{k}", "ab", gold, ab, "n/a", "n/a", False, 0.5), (f"p{k}", "ba", gold, ba, "n/a", "n/a", True, 0.5)]
    df = spark.createDataFrame(rows, "pair_id string, input_order string, family string, pred_family string, pred_direction string, direction string, abstain boolean, confidence double")
    r = metrics.symmetry(df).first()
    assert (r.csa, r.consistency, r.acc_ab, r.acc_ba) == (0.5, 0.75, 0.75, 0.5)


def test_aggregators_without_votes(spark):
    c = spark.createDataFrame([("p", 0, "f", False, 0.2), ("p", 1, "g", False, 0.9)], "pair_id string, candidate_id int, cand_family string, passed boolean, score double")
    got = {r.aggregator: (r.family, r.abstain) for r in voting.aggregated(c).collect()}
    assert got["greedy"] == ("f", False) and got["vote_majority"] == ("g", False) and got["vote_consensus"] == ("f", True) and got["argmax_1"] == ("f", False)


def test_hub_tokens_are_salted_without_loss(spark):
    sets = spark.createDataFrame([(f"e{k}", t) for k in range(30) for t in ("hub", f"t{k % 3}")], "entity string, token string")
    a = {tuple(r) for r in retrieval.token_similarity(sets).collect()}
    assert len(a) == 30 * 29 and a == {tuple(r) for r in retrieval.token_similarity(sets, 4).collect()}


def test_bootstrap_holds_its_point(spark):
    df = spark.createDataFrame([("f", "f", False)] * 80 + [("f", "g", False)] * 20 + [("g", "g", False)] * 50 + [("g", "g", True)] * 10, "family string, pred_family string, abstain boolean")
    got = {r.name: r for r in resampling.bootstrap(df, 200).collect()}
    assert got["accuracy"].point == 0.8125 and all(r.low <= r.point <= r.high for r in got.values())
    same = df.select("family", F.col("pred_family").alias("a"), F.col("pred_family").alias("b"))
    r = resampling.paired_bootstrap(same, 50).first()
    assert (r.delta, r.p) == (0.0, 1.0)


def test_features(spark):
    df = spark.createDataFrame([("about 90 minutes", "Renal and hepatic", 'x ```json\n{"a": 1}\n``` y', "see [A123] and L4567, A123"), ("2 days", "bile", "so {\"b\": {\"c\": 2}} end", ""), (None, None, "no", None)], "t string, r string, j string, l string")
    got = df.select(features.half_life_hours(F.col("t")).alias("h"), features.elimination_route(F.col("r")).alias("e"), features.best_json(F.col("j")).alias("j"), features.literature_ids(F.col("l")).alias("l"), features.action_flag(F.col("r")).alias("a")).collect()
    assert [(r.h, r.e, r.j, r.l) for r in got] == [(1.5, "mixed", '{"a": 1}', ["A123", "L4567"]), (48.0, "hepatic", '{"b": {"c": 2}}', []), (None, None, None, [])]


def test_top_lists_by_blocks_hold_what_all_pairs_give(spark):
    """Dense and sparse cells, ties, several blocks and ranges, a token of all, odd rows."""
    rows = [(f"e{k:03d}", f"t{(k * j * j + j) % 17}") for k in range(150) for j in range(1 + k % 5)] + [(f"e{k:03d}", "hub") for k in range(0, 150, 2)]
    sets = spark.createDataFrame([*rows, *rows[:9], (None, "hub"), ("e003", None), ("alone", "own")], "entity string, token string")
    want = retrieval.top_similar(retrieval.combined([(retrieval.token_similarity(sets), 1.0)]), 6).select("x", "y", "sim", "rank")
    for block, parts in ((4, 3), (64, 64), (2048, 64)):
        assert sorted(retrieval.top_by_tokens(sets, 6, block, parts).collect()) == sorted(want.collect())


def test_top_lists_make_no_row_for_each_meeting(spark, tmp_path):
    sets = spark.range(2000).selectExpr("concat('e', id) as entity", "concat('t', id % 2) as token")
    plan = retrieval.top_by_tokens(sets, 5)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan
    found = retrieval.top_by_tokens(sets, 5).cache()
    assert found.count() == 10000 and found.where("sim <> 1.0 or rank > 5 or x = y").isEmpty()


def test_neighbours_by_either_end(spark):
    near = spark.createDataFrame([("a", "c", 0.5), ("b", "d", 0.25), ("a", "d", 0.75), ("b", "c", 1.0), ("a", "b", 0.5), ("b", "a", 0.5)], "x string, y string, sim double")
    query = spark.createDataFrame([("a|b", "a", "b")], "pair_id string, a_id string, b_id string")
    train = spark.createDataFrame([("c|d", "c", "d", "f"), ("d|c", "d", "c", "g"), ("a|b", "a", "b", "f"), ("c|z", "c", "z", "f")], "pair_id string, a_id string, b_id string, family string")
    best = {(r.neighbour, r.n_family, r.score, r["rank"]) for r in retrieval.neighbour_pairs(query, train, near, 5).collect()}
    assert best == {("c|d", "f", 0.75, 1), ("d|c", "g", 0.75, 2)}
    both = {(r.neighbour, r.score) for r in retrieval.neighbour_pairs(query, train, near, 5, total=True, disjoint=True).collect()}
    assert both == {("c|d", 0.875), ("d|c", 0.875)}
