"""Protein flags from actions and prose by hand values, and against one scan for each flag."""

from __future__ import annotations

import re

from mechpairs.operators import pk_flags as pk

TEXTS = ("m", "d")


def flags(spark, rows, targets=()):
    structured = pk.structured_flags(spark.createDataFrame(list(targets), "entity_id string, uniprot string, actions array<string>"))
    made = pk.with_text_flags(spark.createDataFrame(rows, "entity_id string, m string, d string"), structured, TEXTS)
    return {r.entity_id: ({c for c in pk.FLAGS if r[c]}, set(r.text_only)) for r in made.collect()}


def test_hand_values(spark):
    got = flags(
        spark,
        [
            ("a", "It INHIBITS hepatic cyp 3a4.", None), ("b", None, None), ("c", "A P-gp substrate", "and pgp is inhibited"), ("d", "induces CYP2C19", ""),
            ("e", "inhibits one two three four CYP2D6", "CYP2D6x is induced"), ("f", "inhibits", "MDR1"), ("g", "inhibits naïve CYP1A2", None), ("h", "", "metabolized by the enzymes CYP2C9"), ("i", "CYP2D6x is induced", None),
        ],
        [("a", "P08684", ["Inhibitor", None]), ("a", "P08684", ["substrate"]), ("d", "P33261", ["metabolised by"]), ("b", "P99999", ["inhibitor"]), ("b", None, ["inhibitor"]), ("c", "Q9UNQ0", None), ("z", "P08684", ["inducer"])],
    )
    assert got == {
        "a": ({"cyp3a4_inh", "cyp3a4_sub"}, set()), "b": (set(), set()), "c": ({"p_gp_sub", "p_gp_inh"}, {"p_gp_sub", "p_gp_inh"}),
        "d": ({"cyp2c19_sub", "cyp2c19_ind"}, {"cyp2c19_ind"}), "i": (set(), set()),
        # Texts are joined by a blank, so the name that ends one may be induced by the next.
        "e": ({"cyp2d6_ind"}, {"cyp2d6_ind"}), "f": ({"p_gp_inh"}, {"p_gp_inh"}), "g": ({"cyp1a2_inh"}, {"cyp1a2_inh"}),
        "h": ({"cyp2c9_sub"}, {"cyp2c9_sub"}),
    }


def test_same_as_a_scan_for_each_flag(spark):
    words = ["inhibits", "CYP2C9", "CYP 2C19", "is", "induced", "the", "OAT1", "OATP1B1", "substrate", "of", "blocks", "P-glycoprotein", "SLC22A1", "SLC22A6", "metabolism by"]
    rows = [(f"{k}", " ".join(words[(k * 7 + j * (k % 5 + 1)) % len(words)] for j in range(9)), None) for k in range(120)]
    want = {i: {c for c, (p, k) in pk.FLAGS.items() if re.search("(?i)" + pk.said(p, k), t)} for i, t, _ in rows}
    assert sum(map(len, want.values())) > 50
    assert {i: got[1] for i, got in flags(spark, rows).items()} == want


def test_empty_and_clashing(spark):
    none = spark.createDataFrame([], "entity_id string, uniprot string, actions array<string>")
    rows = spark.createDataFrame([("a", "blocks BCRP", "x", True)], "entity_id string, m string, text_only string, oct1_inh boolean")
    (r,) = pk.with_text_flags(rows, pk.structured_flags(none), ("m",)).collect()
    assert r.text_only == ["bcrp_inh"] and not r.oct1_inh
    assert pk.text_only_counts(pk.with_text_flags(rows.limit(0), pk.structured_flags(none), ("m",))).count() == 0
