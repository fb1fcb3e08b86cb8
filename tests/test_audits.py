"""Hand values of audits, counterfactual flips and hard negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from mechpairs.operators import audits
from mechpairs.operators import counterfactuals as cf


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_description_spread(spark):
    told = spark.createDataFrame(
        [("p", "q", "x"), ("q", "p", "x"), ("p", "r", "x"), ("r", "p", "y"), ("s", "t", "x"), ("s", "t", "x")], "s string, o string, description string")
    assert rows(audits.description_spread(told), "n_descriptions", "n_pairs", "n_asymmetric") == [(1, 2, 0), (2, 1, 1)]
    assert audits.description_spread(told.limit(0)).count() == 0


def test_error_clusters(spark):
    made = spark.createDataFrame(
        [
            (1, "PK_Metabolism", "m", "AdverseRisk", "x", "a_to_b", "a_to_b", False, "CYP3A4 is slowed"),
            (2, "PK_Metabolism", "m", "AdverseRisk", "x", "a_to_b", "a_to_b", False, "no reason"),
            (3, "PK_Metabolism", "m", "PK_Metabolism", "m", "a_to_b", "b_to_a", False, ""),
            (4, "PK_Metabolism", "m", "PK_Metabolism", "x", "a_to_b", "a_to_b", False, ""),
            (5, "Efficacy", "m", "PD_Activity", "x", "a_to_b", "a_to_b", False, ""),
            (6, "AdverseRisk", "m", "Efficacy", "x", "a_to_b", "a_to_b", False, ""),
            (7, "PK_Excretion", "rate", "PK_Absorption", "rate", "a_to_b", "a_to_b", False, ""),
            (8, "PK_Excretion", "rate", None, None, "a_to_b", None, False, ""),
            (9, "Efficacy", "m", "Efficacy", "m", "a_to_b", "a_to_b", True, ""),
            (10, "PK_Absorption", "m", "AdverseRisk", "x", "a_to_b", "a_to_b", False, None),
        ],
        "k int, family string, subtype string, pred_family string, pred_subtype string, direction string, pred_direction string, abstain boolean, said string",
    )
    got = dict(made.select("k", audits.error_cluster(F.col("said"))).collect())
    assert got == {
        1: "pk_metabolism_mislabeled_as_adverse", 2: "pk_metabolism_to_adverse_no_pk_evidence", 3: "direction_only_error", 4: "subtype_only_error",
        5: "efficacy_vs_pd_confusion", 6: "adverse_mislabeled_as_non_adverse", 7: "axis_ambiguity_same_subtype", 8: "parse_or_schema_failure",
        9: "parse_or_schema_failure", 10: "rare_family_mislabeled_as_adverse",
    }


def test_template_cover(spark):
    """Sizes 6, 3, 1: one template holds 60 %, two hold 90 %, three all."""
    pairs = spark.createDataFrame([(f"A{i}", f"B{i}", f"A{i} {w} B{i}") for w, n in (("x", 6), ("y", 3), ("z", 1)) for i in range(n)], "a_id string, b_id string, description string")
    pairs = pairs.withColumn("raw_subject_id", F.col("a_id"))
    assert [audits.template_cover(pairs, s).first().n_cover for s in (0.6, 0.61, 0.9, 0.95)] == [1, 2, 2, 3]


def test_routing_raises_macro_f1(spark):
    """30 answers 'Efficacy' with low confidence, all wrong, which the baseline gets right."""
    right = [(f"r{i}", "Efficacy", "Efficacy", "Efficacy", 0.9) for i in range(30)]
    wrong = [(f"w{i}", "AdverseRisk", "Efficacy", "AdverseRisk", 0.2) for i in range(30)]
    df = spark.createDataFrame(right + wrong, "pair_id string, family string, pred_family string, base_family string, confidence double")
    out = {(r.tau, r.predicted): (r.n, r.gain, r.use) for r in audits.confusion_routing(df, df, (0.1, 0.5)).collect()}
    assert out[0.5, "Efficacy"] == (30, 0.666667, True)
    assert not any(use for (tau, name), (_, _, use) in out.items() if (tau, name) != (0.5, "Efficacy"))


def test_flips(spark):
    pairs = spark.createDataFrame(
        [("1", "a", "b", "metabolism", "a"), ("2", "a", "b", "metabolism", "b"), ("3", "a", "b", "protein_binding", None), ("4", "a", "b", "excretion_rate", None)],
        "pair_id string, a_id string, b_id string, subtype string, subject_id string")
    flags = spark.createDataFrame(
        [("a", "cyp3a4", "ind"), ("a", "cyp3a4", "inh"), ("b", "cyp3a4", "sub"), ("a", "cyp1a2", "inh"), ("b", "oct2", "inh"), ("a", "oct2", "sub")], "entity string, prefix string, kind string")
    found = cf.relevant_flips(pairs, flags)
    assert rows(found, "pair_id", "side", "flag") == [("1", "A", "cyp3a4_inh"), ("4", "B", "oct2_inh")]
    assert rows(cf.null_flips(found.where("pair_id = '1'"), flags), "pair_id", "flag") == [("1", "cyp1a2_inh")]


def test_hard_negatives(spark):
    gold = spark.createDataFrame([("1", "PD_Activity", "x", "a_to_b"), ("2", "AdverseRisk", "x", "bidirectional")], "pair_id string, family string, subtype string, direction string")
    vocabulary = cf.next_subtypes(spark.createDataFrame([("PD_Activity", "x"), ("PD_Activity", "y"), ("AdverseRisk", "x")], "family string, subtype string"))
    assert rows(cf.hard_negatives(gold, vocabulary), "pair_id", "nth", "kind", "family", "subtype", "direction") == [
        ("1", 0, "to_adverse", "AdverseRisk", "adverse_effects", "a_to_b"), ("1", 1, "axis_swap", "Efficacy", "x", "a_to_b"),
        ("1", 2, "subtype_swap", "PD_Activity", "y", "a_to_b"), ("1", 3, "direction_flip", "PD_Activity", "x", "b_to_a"),
        ("2", 0, "axis_swap", "PD_Activity", "x", "bidirectional"), ("2", 1, "axis_swap", "Efficacy", "x", "bidirectional"),
    ]


def test_capped_subset_bounds_entities(spark):
    labels = spark.createDataFrame([(f"h|{i}", "F", "h", str(i)) for i in range(50)] + [(f"{i}|{i}x", "F", str(i), f"{i}x") for i in range(50)], "pair_id string, family string, a_id string, b_id string")
    kept = audits.capped_subset(labels, 60, 0.1)
    hub = kept.where(F.col("pair_id").startswith("h")).count()
    assert hub <= 6 and kept.count() <= 60


def test_flags_by_masks_as_by_rows(spark):
    """Against the joins by flag, with prefixes that no list names, nulls and repeated rows; and
    no join is on a prefix, so a pair is not repeated for each flag."""
    from random import Random

    pick = Random(7)
    names = (*cf.ENZYMES, "p_gp", "oct2", "aa1", None)
    own = [(pick.choice("abcdef"), pick.choice(names), pick.choice(("inh", "ind", "sub", "sub", None))) for _ in range(70)] + [(None, "cyp3a4", "sub")]
    own += [(e, "zz9", "inh") for e in "abcdef"]
    flags = spark.createDataFrame(own + own[:9], "entity string, prefix string, kind string")
    ends = [(x, y, pick.choice(("metabolism", "excretion_rate", "absorption_change", "protein_binding", None)), pick.choice((x, y, None))) for x in "abcdeg" for y in "bcdefg" if x < y]
    ends += [(None, "a", "metabolism", None)] + ends[:3]
    pairs = spark.createDataFrame([(f"{x}|{y}", x, y, s, o) for x, y, s, o in ends], "pair_id string, a_id string, b_id string, subtype string, subject_id string")
    acts = flags.where("kind in ('inh', 'ind')").select(F.col("entity").alias("subject"), "prefix", "kind")
    taken = flags.where("kind = 'sub'").select(F.col("entity").alias("object"), "prefix").distinct()
    place = F.array_position(cf.prefix_order(F.col("subtype")), F.col("prefix"))
    hits = cf.sides(pairs).join(acts, "subject").join(taken, ["object", "prefix"]).withColumn("place", place).where("place > 0")
    best = hits.groupBy("pair_id").agg(F.min(F.struct("place", "side", (F.col("kind") == "ind").alias("late"), "subject", "object", "prefix", "kind")).alias("m"))
    relevant = cf.relevant_flips(pairs, flags)
    assert relevant.count() > 3
    assert sorted(map(tuple, relevant.collect())) == sorted(map(tuple, best.select("pair_id", "m.side", "m.subject", "m.object", F.concat_ws("_", "m.prefix", "m.kind"), "m.prefix").collect()))
    other = relevant.join(acts.withColumnRenamed("prefix", "other"), "subject").where("other <> prefix").join(taken.withColumnRenamed("prefix", "other"), ["object", "other"], "left_anti")
    drawn = other.select("pair_id", "side", F.concat_ws("_", "other", "kind").alias("flag")).withColumn("x", F.md5(F.concat_ws("|", F.lit("null-1"), "pair_id", "flag").cast("binary")))
    null = cf.null_flips(relevant, flags)
    assert other.where("other in ('zz9', 'aa1')").count() > 0
    assert sorted(map(tuple, null.collect())) == sorted(map(tuple, drawn.groupBy("pair_id", "side").agg(F.min_by("flag", "x")).collect()))
    ways = pairs.select("pair_id", F.lit("A").alias("side"), F.col("a_id").alias("subject"), F.col("b_id").alias("object")).union(pairs.select("pair_id", F.lit("B"), "b_id", "a_id"))
    met = ways.join(acts.select("subject", "prefix").distinct(), "subject").join(taken, ["object", "prefix"]).groupBy("pair_id").agg(F.array_sort(F.collect_set("prefix")).alias("p"))
    told = cf.pk_evidence(pairs, flags)
    cited = F.array_sort(F.transform(F.filter("ids", lambda i: F.startswith(i, F.lit("enzyme_"))), lambda i: F.lower(F.substring(i, 8, 99))))
    assert sorted(map(str, told.select("pair_id", cited).collect())) == sorted(str(r).replace("p=", f"{told.select(cited).columns[0]}=") for r in met.collect())
    for df in (relevant, null, told):
        joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in line]
        assert joins and not any("prefix" in line or "other" in line for line in joins)
