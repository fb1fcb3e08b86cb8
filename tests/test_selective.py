from mechpairs.functions import text
from mechpairs.operators import agreement, selective
from mechpairs.streaming import ingest
from pyspark.sql import functions as F

ROWS = "pair_id string, input_order string, family string, pred_family string, abstain boolean, confidence double"


def scored(spark):
    rows = [("a", "ab", "X", "X", False, 0.9), ("b", "ab", "X", "Y", False, 0.5), ("c", "ab", "X", "X", False, 0.5), ("d", "ab", "X", "X", True, 0.99), ("e", "ab", "X", None, False, None)]
    return spark.createDataFrame(rows, ROWS)


def test_ties_are_kept_together(spark):
    got = {r["coverage"]: (r["threshold"], r["kept"], r["accuracy"]) for r in selective.at_coverage(scored(spark), (0.3, 0.6)).collect()}
    assert got == {0.3: (0.9, 1, 1.0), 0.6: (0.5, 3, 0.666667)}


def test_threshold_falls_back_to_coverage(spark):
    row = selective.family_thresholds(scored(spark), accuracy=1.1, coverage=0.5).first()
    assert (row["threshold"], row["met"]) == (0.5, False)


def test_area_of_empty_table(spark):
    assert selective.area_under_risk(scored(spark).limit(0)).count() == 0


def test_entropy_of_one_and_two_families(spark):
    votes = spark.createDataFrame([("p", "X"), ("p", "X"), ("q", "X"), ("q", "Y")], "pair_id string, cand_family string")
    assert {r["pair_id"]: r["entropy"] for r in agreement.vote_entropy(votes).collect()} == {"p": 0.0, "q": 0.693147}


def test_mcnemar_without_discordant_pairs(spark):
    row = agreement.mcnemar(scored(spark).where("pair_id = 'd'")).first()
    assert row["neither"] == 1 and row["statistic"] is None


def test_poisson_weights_have_mean_one(spark):
    mean = spark.range(20000).select(F.avg(agreement.poisson_weight(F.col("id").cast("string"))).alias("m")).first()["m"]
    assert abs(mean - 1) < 0.03


def test_text_measures(spark):
    df = spark.createDataFrame([("It MAY rise by 12.5 % or 3%",), (None,), ("",)], "t string")
    got = [tuple(r) for r in df.select(text.hedge_count(F.col("t")), text.word_count(F.col("t")), text.first_percentage(F.col("t"))).collect()]
    assert got == [(1, 8, 12.5), (0, 0, None), (0, 0, None)]


def test_ingest_resumes_and_drops_repeats(spark, tmp_path):
    src, dst, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    spark.sql("SELECT 1 AS id, timestamp_ntz'2024-01-01 00:00:00' AS ts UNION ALL SELECT 1, timestamp_ntz'2024-01-01 00:01:00'").write.parquet(src)
    schema = spark.read.parquet(src).schema
    run = lambda: ingest.append_new(spark.readStream.schema(schema).parquet(src), "id", "ts", dst, state, "1 day")
    run()
    spark.sql("SELECT 1 AS id, timestamp_ntz'2024-01-01 00:02:00' AS ts UNION ALL SELECT 2, timestamp_ntz'2024-01-01 00:03:00'").write.mode("append").parquet(src)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(dst).collect()) == [1, 2]
