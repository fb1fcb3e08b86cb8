import math

import duckdb
import pytest

import __spark_entry__ as entry
from mechpairs.operators import curation, metrics, splits, taxonomy

SF = "/root/testdata/sf0.001"


def mentions(spark, rows):
    return spark.createDataFrame([(s, o, t, k) for k, (s, o, t) in enumerate(rows)], "s string, o string, description string, ord long")


def test_first_description_wins_and_repeats_are_bidirectional(spark):
    m = mentions(spark, [("x", "y", "The metabolism of y can be decreased when combined with x."), ("y", "x", "other"), ("p", "q", "t")])
    got = {r.pair_id: r for r in taxonomy.canonical_pairs(m).collect()}
    assert got["x|y"].bidirectional and got["x|y"].n_texts == 2 and got["x|y"].raw_subject_id == "x"
    assert not got["p|q"].bidirectional


@pytest.mark.parametrize(
    "text, want",
    [
        ("The risk or severity of QTc prolongation can be increased when x is combined with y.", ("AdverseRisk", "qtc_prolongation", "risk", None, None)),
        ("The metabolism of y can be decreased when combined with x.", ("PK_Metabolism", "metabolism", "down", "x", "y")),
        ("x may increase the central nervous system depressant (CNS) activities of y.", ("PD_Activity", "central_nervous_system_depressant_cns", "up", "x", "y")),
        ("The excretion of y can be increased when combined with x.", ("PK_Excretion", "excretion_rate", "up", "x", "y")),
        ("The serum concentration of z-1, an active metabolite of y, can be reduced when used in combination with x.", ("PK_Distribution", "active_metabolite_serum_conc", "down", "x", "y")),
        ("x meets y.", ("Other", "unmatched", None, None, None)),
    ],
)
def test_cascade(spark, text, want):
    # Names of one letter would also hit other words, so longer ones are used.
    text = text.replace(" x ", " drugx ").replace("x may", "drugx may").replace("x meets", "drugx meets").replace("x.", "drugx.")
    text = text.replace(" y ", " drugy ").replace(" y,", " drugy,").replace("y.", "drugy.")
    r = taxonomy.label_pairs(taxonomy.canonical_pairs(mentions(spark, [("drugx", "drugy", text)]))).first()
    side = {"x": "drugx", "y": "drugy", None: None}
    assert (r.family, r.subtype, r.polarity, r.subject_id, r.object_id) == (*want[:3], side[want[3]], side[want[4]])


def test_hash_rank_is_a_permutation_whatever_the_partitioning(spark):
    rows = spark.range(500).selectExpr("cast(id as string) as k", "id % 3 as g")
    a = {(r.k, r._rank) for r in splits.hash_rank(rows.repartition(1), "k", ["g"], "s").collect()}
    b = {(r.k, r._rank) for r in splits.hash_rank(rows.repartition(7), "k", ["g"], "s").collect()}
    assert a == b
    assert sorted(k for (_, k) in a) == sorted([*range(1, 168), *range(1, 168), *range(1, 167)])


def scored(spark, rows):
    return spark.createDataFrame(rows, "family string, pred_family string, abstain boolean, confidence double")


def test_abstention_utility(spark):
    rows = [("f", "f", False, 0.9)] * 81 + [("f", "g", False, 0.8)] * 9 + [("f", "f", True, 0.1)] * 10
    r = metrics.abstention_utility(scored(spark, rows)).where("family is null").first()
    assert (r.utility, r.coverage, r.selective_accuracy) == (0.72, 0.9, 0.9)


def test_class_report_policies(spark):
    s = scored(spark, [("f", "f", False, 1.0), ("f", "g", False, 1.0), ("g", "g", False, 1.0), ("g", "g", True, 1.0)])
    skip = {r.family: r for r in metrics.class_report(metrics.cells(s)).collect()}
    strict = {r.family: r for r in metrics.class_report(metrics.cells(s), False).collect()}
    assert skip["g"].recall == 1.0 and strict["g"].recall == 0.5 and skip["f"].f1 == pytest.approx(2 / 3, abs=1e-6)


def test_auroc_counts_ties_half(spark):
    s = scored(spark, [("f", "f", False, 0.5), ("f", "g", False, 0.5), ("f", "f", False, 0.9), ("f", "g", False, 0.1)])
    assert metrics.auroc(s).first().auroc == pytest.approx(0.875)


def test_votes_break_ties_by_candidate_number(spark):
    c = spark.createDataFrame([("p", 0, "g", 0.1), ("p", 1, "f", 0.9), ("q", 0, "f", 0.5)], "pair_id string, candidate_id int, cand_family string, score double")
    got = {r.pair_id: r for r in curation.vote(c).collect()}
    assert got["p"].majority == "g" and got["p"].weighted == "f" and got["q"].share == 1.0


@pytest.mark.parametrize("name", ["family_report", "mirror_metrics", "split_entity_cold", "candidate_votes", "pair_jaccard", "label_triangles"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]

    def norm(x):
        return repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) and not (isinstance(x, float) and math.isnan(x)) else str(x)

    ours = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    theirs = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert cols == sorted(names) and ours == theirs
