"""Hard negatives against brute force and the SQL."""

import math

import duckdb
import numpy as np
import pytest

from mechpairs.llm import hard_negatives as hn

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, v int, score string"


def brute(rows):
    kept = {}
    for vec_id, e, label, *_ in rows:
        if vec_id is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        r = (label, tuple(math.floor(256 * float(np.float32(x))) for x in e))
        kept[vec_id] = min(kept.get(vec_id, r), r)
    out = []
    for a, (label, q) in kept.items():
        if a % 50:
            continue
        s = {i: sum(map(int.__mul__, q, v)) for i, (_, v) in kept.items() if i != a and len(v) == len(q)}
        best = lambda ids, k: sorted(ids, key=lambda i: (-s[i], i))[:k]
        for p in best([i for i in s if kept[i][0] == label], 5):
            held = [i for i in s if kept[i][0] != label and 50 * s[p] <= 100 * s[i] <= 95 * s[p]]
            out += [(a, p, k + 1, i, s[p], s[i]) for k, i in enumerate(best(held, 3))]
    return sorted(out)


def written(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("scale", [1.0, 4000.0])
def test_query_by_brute_force(spark, tmp_path, monkeypatch, scale):
    monkeypatch.setattr(hn, "BLOCK", 90)
    monkeypatch.setattr(hn, "CHUNK", 4)
    monkeypatch.setattr(hn, "PART", 2)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(5, 16))
    rows = []
    for k in range(900):
        e = (centre[k % 5] + rng.normal(size=16)) * rng.choice([0.2, 1, 3]) * scale
        if k % 9 == 0:
            e = np.round(e / scale) * scale  # ties
        rows.append((k, e.tolist(), int(rng.choice([0, 0, 0, 1, 2, 9])), 1, "x"))
    rows += [(10_000 + 50 * k, [0.0] * 16, 1, 1, "x") for k in range(3)] + [(20_000, [1.0] * 3, 1, 1, "x"), (20_001, [2.0] * 3, 1, 1, "x"), (20_002, [1.5] * 3, 2, 1, "x")]
    rows += [(None, [1.0] * 16, 1, 1, "x"), (30_000, None, 1, 1, "x"), (30_050, [1.0] * 16, None, 1, "x"), (30_100, [float("nan")] * 16, 1, 1, "x")]
    rows += [(30_150, [None] + [1.0] * 15, 1, 1, "x"), (30_200, [float("inf")] + [1.0] * 15, 1, 1, "x"), (30_250, [], 1, 1, "x")]
    rows += [rows[50], (50, rows[50][1], 8, 1, "x"), (2**60 + 1, rows[1][1], 0, 1, "x"), (50 * 2**55, rows[2][1], 0, 1, "x"), (2**60 + 3, rows[1][1], 0, 1, "x")]
    got = hn.op13_hard_negatives(spark, written(spark, tmp_path, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_few_and_empty(spark, tmp_path):
    rows = [(50, [1.0, 0.0], 1, 1, "x"), (51, [1.0, 0.0], 1, 1, "x"), (52, [0.9, 0.0], 2, 1, "x")]
    assert sorted(map(tuple, hn.op13_hard_negatives(spark, written(spark, tmp_path / "a", rows)).collect())) == brute(rows) != []
    assert hn.op13_hard_negatives(spark, written(spark, tmp_path / "b", [])).collect() == []
    assert hn.op13_hard_negatives(spark, written(spark, tmp_path / "c", rows[:1])).collect() == []


def test_pruning_keeps_all_that_reach_the_bound():
    rng = np.random.default_rng(2)
    rows = np.floor(256 * rng.normal(size=(3000, 8)) * rng.choice([1, 5], size=(3000, 1))).astype(np.int64)
    block = hn.Block(np.arange(3000), rows)
    smaller = 0
    for q in rows[:60]:
        scores = rows @ q
        for least in np.quantile(scores, [0.5, 0.9, 0.99, 1]).astype(int).tolist():
            found = block.feasible(q, least)
            assert set(np.flatnonzero(scores >= least)) <= set(found.tolist())
            smaller += len(found) < 1500
    assert smaller > 60


def test_query_equals_sql(spark):
    got = sorted(map(tuple, hn.op13_hard_negatives(spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(con.sql(hn.oracle()).fetchall()) and got
