import re

import pytest
from pyspark.sql import functions as F

from mechpairs.operators import curation, distributions, gates, taxonomy
from mechpairs.plans import frames
from mechpairs.plans import trace_frames as tf

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string"


@pytest.fixture
def lines(spark, tmp_path):
    """Orders with lines that repeat, parts that meet twice both ways, and nulls."""
    rows = [(k // 4, (k * 7) % 23, k % 5, k % 4 + 1, "ANR"[k % 3], "FO"[k % 2]) for k in range(400)]
    rows += [(500, 1, 2, 1, "A", "F"), (500, 1, 2, 1, "A", "F"), (500, 2, None, 2, None, "F"), (501, 2, 3, 1, "N", "O"), (501, 1, 3, 2, "N", "O"), (502, None, 1, 1, "A", "F"), (502, 4, 1, None, "A", "F")]
    rows += [(600, 90, 1, 1, None, "F"), (600, 91, 1, 2, "A", "F")]  # a pair without a description
    spark.createDataFrame(rows, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def exchanges(df):
    """What deals rows out in the plan, without reused ones and single rows."""
    return re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (\w+\([^)]*\))", df._jdf.queryExecution().executedPlan().toString())


def test_pairs_by_number_are_those_of_the_texts(spark, lines):
    want = taxonomy.canonical_pairs(frames.mentions(spark, lines))
    got = frames.pairs(spark, lines)
    assert got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("n_texts = 0").count() == 1
    assert sorted(map(str, frames.labels(spark, lines).collect())) == sorted(map(str, taxonomy.label_pairs(want).collect()))


def test_pairs_are_dealt_once(spark, lines):
    for df in (frames.labels(spark, lines), curation.vote(frames.candidates(spark, lines))):
        dealt = [x for x in exchanges(df) if "orderkey" not in x]
        assert len(dealt) == 1 and "pair_id" in dealt[0], dealt  # the templates went through the pairs' shuffle before


def test_digits_of_a_digest(spark):
    d, places = F.md5(F.lit("x").cast("binary")), [(1, 4), (5, 4), (9, 1), (12, 2), (15, 1)]
    row = spark.range(1).select(*(frames.digits(frames.head(d), a, n) for a, n in places), *(frames.hex_int(d, a, n) for a, n in places)).first()
    assert tuple(row)[:5] == tuple(row)[5:]
    assert spark.range(1).select(frames.digits(frames.head(F.lit(None).cast("string")), 1, 2)).first()[0] is None


def test_candidates_make_each_digest_once_and_carry_the_label(spark, lines):
    rows = frames.candidates(spark, lines, ("family", "subtype"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("md5(") == frames.N_CANDIDATES
    joined = frames.candidates(spark, lines).join(frames.labels(spark, lines).select("pair_id", "family", "subtype"), "pair_id")
    assert sorted(map(str, rows.select(joined.columns).collect())) == sorted(map(str, joined.collect()))


def test_gate_rates_take_one_pass(spark):
    row = [True, False, None] + [True] * 7
    data = [("p", *row, True), ("p", *([False] * 10), False), ("q", *row, None)]
    rows = spark.createDataFrame(data, "pair_id string, " + ", ".join(f"G{k} boolean" for k in range(1, 11)) + ", gate_passed boolean")
    out = gates.gate_rates(rows)
    got = {r.gate: (r.n, r.rate) for r in out.collect()}
    assert got["G1"] == (3, 0.666667) and got["G2"] == (3, 0.0) and got["G3"] == (3, 0.0) and got["any_pair"] == (2, 1.0)
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.n, r.rate) for r in gates.gate_rates(rows.where("false")).collect()} == {(0, None)}


def test_entropy_names_its_map_once(spark):
    d = F.create_map(F.lit("a"), F.lit(0.25), F.lit("b"), F.lit(0.75))
    plan = spark.range(1).select(distributions.entropy(tf.distribution(F.col("id") / 4, F.lit("a"))).alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_values") == 1
    got = spark.range(1).select(distributions.entropy(d).alias("x"), distributions.entropy(F.lit(None).cast("map<string,double>")).alias("n")).first()
    assert abs(got.x - 0.5623351446) < 1e-9 and got.n == 0.0
