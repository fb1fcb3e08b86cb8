"""What is told of a pair's candidates is made in the pair's row: the same as from rows, without grouping them."""

from pyspark.sql import functions as F

from mechpairs.operators import audits, curation, gates, learned, resampling, splits, traces, voting
from mechpairs.plans import audit_queries as aq
from mechpairs.plans import curation_queries as cq
from mechpairs.plans import frames, registry
from mechpairs.plans import learn_queries as lq
from mechpairs.plans import trace_frames as tf
from tests.test_frames import lines  # noqa: F401  a fixture


def ordered(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def groupings(df):
    """Steps that gather rows again, but for the one that makes pairs of mentions."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("Aggregate [") - 1 + plan.count("Window [")


def same_and_ungrouped(name, want, spark, lines, own=0):  # noqa: F811
    """``own``: groupings that the result itself is made of."""
    got = registry.queries()[name](spark, lines)
    assert got.dtypes == want.dtypes
    assert ordered(got) == ordered(want) and got.count() > 0
    joins = [x._jdf.queryExecution().optimizedPlan().toString().count("Join ") for x in (got, want)]
    assert groupings(got) == own and (groupings(want) > own or joins[0] < joins[1])


def test_pruned_in_the_row(spark, lines):  # noqa: F811
    same_and_ungrouped("gate_pruned", gates.pruned(cq.tiered(spark, lines), 4).select("pair_id", "candidate_id"), spark, lines)


def test_complete_in_the_row(spark, lines):  # noqa: F811
    same_and_ungrouped("complete_pairs", curation.complete_pairs(frames.candidates(spark, lines), frames.N_CANDIDATES), spark, lines)


def test_consensus_in_the_row(spark, lines):  # noqa: F811
    rows = cq.gated(spark, lines, ("family", "subtype", "bidirectional")).withColumn("direction", F.when(F.col("bidirectional"), "bidirectional").otherwise("directed"))
    votes = rows.select(
        "pair_id", "abstain", "family", "subtype", "direction", F.col("cand_family").alias("v_family"),
        F.when(F.col("G9"), F.col("subtype")).otherwise("other").alias("v_subtype"), F.when(F.col("G10"), F.col("direction")).otherwise("n/a").alias("v_direction"),
    )
    want = gates.consensus(votes)
    same_and_ungrouped("source_consensus", want, spark, lines)
    same_and_ungrouped("source_weight", gates.consensus_weight(want).select("pair_id", "k_family", "weight"), spark, lines)


def test_signals_in_the_row(spark, lines):  # noqa: F811
    same_and_ungrouped("candidate_signals", voting.signals(frames.candidates(spark, lines)), spark, lines)


def test_judges_in_the_row(spark, lines):  # noqa: F811
    same_and_ungrouped("judge_correlation", resampling.judge_correlation(cq.ratings(spark, lines)), spark, lines, own=1)


def test_rescue_in_the_row(spark, lines):  # noqa: F811
    same_and_ungrouped("trace_rescue", traces.rescued(tf.forward(spark, lines), tf.steps(spark, lines)), spark, lines)


def test_rescue_of_hints_with_ties_nulls_and_none(spark):
    a, b = "Efficacy", "AdverseRisk"
    cases = {"tie": [a, b, a, b], "null": [None, a, a, a], "odd": ["x", "x", "x", a], "none": [], "own": [b, b, b, a]}
    told = spark.createDataFrame([(k, b, b, 0.5, h) for k, h in cases.items()], "pair_id string, family string, pred_family string, confidence double, hints array<string>")
    steps = spark.createDataFrame([(k, n, "protein", h) for k, hints in cases.items() for n, h in enumerate(hints)], "pair_id string, step_id int, role string, hint string")
    want = traces.rescued(told.drop("hints"), steps)
    assert ordered(traces.rescued(told, None)) == ordered(want)
    assert [r.pair_id for r in want.where("rescue is not null").collect()] == ["null"]


def test_clusters_in_the_row(spark, lines):  # noqa: F811
    rows = tf.forward(spark, lines).join(aq.said(spark, lines), "pair_id").select("pair_id", "family", audits.error_cluster(F.col("said")).alias("cluster"))
    got = aq.clusters(spark, lines)
    assert ordered(got) == ordered(rows) and groupings(got) == 0 < groupings(rows)


def test_overlaps_in_one_pass(spark, lines):  # noqa: F811
    labels, parts = frames.labels(spark, lines), registry.parts(spark, lines)
    want = audits.split_overlaps(labels, splits.entity_cold_split(labels, parts), parts)
    got = audits.split_overlaps(labels, None, parts)
    assert got.dtypes == want.dtypes and got.collect() == want.collect() and got.first().train_entities > 0
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") < want._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_router_rows_without_joins_by_pair(spark, lines):  # noqa: F811
    rows = frames.scored(spark, lines)
    sides = [rows.where(F.col("input_order") == o).select("pair_id", "pred_family", "confidence", "abstain") for o in ("ab", "ba")]
    want, got = learned.router_rows(*sides, frames.labels(spark, lines).where("family <> 'Other'")), lq.two_orders(spark, lines)
    assert got.dtypes == want.dtypes and ordered(got) == ordered(want) and got.count() > 0
    assert "[pair_id" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)


def old_winners(spark, lines):  # noqa: F811
    return gates.consensus_winner(cq.tiered(spark, lines, ("family",)).withColumn("match", F.col("cand_family") == F.col("family")), 0.2)


def old_answers(spark, lines):  # noqa: F811
    cited = tf.steps(spark, lines).where("step_id = 1").select("pair_id", "evidence")
    return tf.forward(spark, lines).select("pair_id", "family", "direction").join(old_winners(spark, lines).select("pair_id", "tier"), "pair_id").join(cited, "pair_id")


def test_winners_in_the_row(spark, lines):  # noqa: F811
    same_and_ungrouped("consensus_winner", old_winners(spark, lines).select("pair_id", "source", "candidate_id", "tier"), spark, lines)


def test_preferences_in_the_row(spark, lines):  # noqa: F811
    rows = old_answers(spark, lines)
    prefs = gates.preferences(rows, cq.FAMILIES)
    same_and_ungrouped("preference_pairs", prefs, spark, lines)
    same_and_ungrouped("kept_preferences", audits.kept_tiers(rows, prefs, aq.FULL)[1].select("pair_id", "kind"), spark, lines)


def test_orphans_from_one_join(spark):
    prefs = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "pair_id string")
    records = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "pair_id string")
    got = gates.orphans(prefs, records)
    assert [tuple(r) for r in got.collect()] == [(4, 2)] and got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert [tuple(r) for r in gates.orphans(prefs.limit(0), records).collect()] == [(0, 0)]


def test_reranked_in_the_row(spark, lines):  # noqa: F811
    rows = cq.tiered(spark, lines)
    same_and_ungrouped("rerank_changes", gates.rerank_changes(rows, ["geomean"], ["final"], "final"), spark, lines, own=1)
    want = audits.reranked_records(old_winners(spark, lines), gates.reranked(rows, ["final"]), rows.where("tier <> 'drop'"))
    same_and_ungrouped("reranked_records", want, spark, lines)


def test_crosscheck_in_the_row(spark, lines):  # noqa: F811
    rows = tf.forward(spark, lines).join(old_winners(spark, lines).select("pair_id", "tier"), "pair_id").join(aq.said(spark, lines), "pair_id")
    same_and_ungrouped("tier_crosscheck", audits.crosscheck(rows), spark, lines, own=1)


def test_winner_of_a_list(spark):
    cols = "pair_id string, candidate_id int, source string, final double, geomean double, match boolean, tier string"
    rows = [("p", 0, "b", 0.9, 0.1, False, "near_miss"), ("p", 1, "a", 0.9, 0.1, False, "near_miss"), ("p", 2, "a", 0.9, 0.9, True, "full_correct"), ("q", 0, "a", 0.9, 0.9, True, "drop"), ("r", 5, "a", 0.1, 0.1, True, "near_miss")]
    one = spark.createDataFrame(rows, cols)
    lists = one.groupBy("pair_id").agg(F.collect_list(F.struct("final", (-F.col("candidate_id")).alias("below"), "candidate_id", "geomean", "source", "match", "tier")).alias("candidates"))
    want, got = (gates.consensus_winner(x, 0.2).select("pair_id", "candidate_id", "source").collect() for x in (one, lists))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) == [("p", 1, "a")]


def test_implied_in_the_row(spark, lines):  # noqa: F811
    implied = traces.implied_family(tf.steps(spark, lines))
    same_and_ungrouped("trace_implied_family", implied, spark, lines)
    same_and_ungrouped("trace_coherence", traces.coherence(tf.forward(spark, lines), implied), spark, lines, own=1)


def test_cues_in_the_row_as_from_rows(spark):
    said = ["CYP3A4 inhibition; renal clearance", "a bleed and Albumin bound", "misbleed xrenal clearance", None, "risk of sedative", "xabsorption absorption"]
    cases = [[("protein", said[k]), ("evidence_gap", said[0]), (None, said[(k + 1) % 6]), ("pk_flag", said[(k + 3) % 6])] for k in range(6)]
    lists = spark.createDataFrame([(f"p{k}", steps) for k, steps in enumerate(cases)] + [("gap", [("abstention", "bleed")])], "pair_id string, steps array<struct<role string, claim string>>")
    rows = lists.select("pair_id", F.posexplode("steps").alias("step_id", "s")).select("pair_id", "step_id", "s.*")
    cols = ["pair_id", "gap", "implied"]
    assert ordered(traces.implied_family(lists).select(cols)) == ordered(traces.implied_family(rows).select(cols))


def test_cues_by_word_edge(spark):
    texts = spark.createDataFrame([(t,) for t in ("renal clearance", "xrenal clearance", "the excreted", "un-excreted", "", "protein-binding")], "t string")
    for cues in traces.CUES.values():
        old = "|".join(f"(?:{c})" for c in cues)
        assert [r[0] for r in texts.select(F.col("t").rlike(traces.any_cue(cues)) != F.col("t").rlike(old)).collect()] == [False] * 6
    assert traces.any_cue(("a", r"\bb")) == r"(?:a)|(?:\bb)"
