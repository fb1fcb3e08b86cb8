"""Pairs complete over several files, stops and restarts."""

from __future__ import annotations

from mechpairs.streaming import complete as sc

SCHEMA = "pair_id string, candidate_id long, at timestamp, score double, note string"


def test_a_stop_between_two_files(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))

    def add(*rows):
        spark.createDataFrame([(p, c, t, float(c or 0), None) for p, c, t in rows], "pair_id string, candidate_id long, at string, score double, note string").selectExpr(
            "pair_id", "candidate_id", "to_timestamp(at) at", "score", "note").coalesce(1).write.mode("append").parquet(src)

    def run():
        sc.append_complete(spark.readStream.schema(SCHEMA).parquet(src), "pair_id", "candidate_id", "at", 3, out, state, "1 day")
        return sorted((r.pair_id, r.candidate_id) for r in spark.read.schema(SCHEMA).parquet(out).collect())

    day = "2024-01-0{} 00:00:00"
    add(("p", 1, day.format(1)), ("p", 1, day.format(1)), ("p", 2, day.format(1)), ("q", 1, day.format(1)), ("big", 2**60 + 1, day.format(1)), (None, 1, day.format(1)), ("p", None, day.format(1)), ("r", 1, None))
    assert run() == []
    add(("p", 3, day.format(1)), ("q", 2, day.format(1)), ("big", 2**60 + 2, day.format(1)), ("big", 2**60 + 3, day.format(1)))
    whole = [("big", 2**60 + 1), ("big", 2**60 + 2), ("big", 2**60 + 3), ("p", 1), ("p", 2), ("p", 3)]
    assert run() == whole
    # The pair that is done takes a further candidate once; a much later row ends the wait of q.
    add(("p", 4, day.format(1)), ("p", 3, day.format(1)), ("late", 1, day.format(9)))
    assert run() == sorted([*whole, ("p", 4)])
    add(("q", 3, day.format(9)), ("late", 2, day.format(9)), ("late", 3, day.format(9)))
    assert run() == sorted([*whole, ("p", 4), ("late", 1), ("late", 2), ("late", 3)])
    kept = spark.read.schema(SCHEMA).parquet(out).where("pair_id = 'p' and candidate_id = 2").first()
    assert kept.score == 2.0 and kept.note is None and str(kept["at"]) == "2024-01-01 00:00:00"
