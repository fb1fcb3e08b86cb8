"""The rescue sweep against the rescue itself at each setting."""

from __future__ import annotations

import random

from mechpairs.operators import traces, voting
from mechpairs.operators.learning import fold
from mechpairs.operators.taxonomy import FAMILIES


def macro(rows):
    scores = []
    for f in FAMILIES:
        tp = sum(a == b == f for a, b in rows)
        both = sum((a == f) + (b == f) for a, b in rows)
        scores.append(2 * tp / both if both else 0.0)
    return sum(scores) / len(FAMILIES)


def test_cells_give_what_the_rescue_gives(spark):
    rng = random.Random(2)
    pairs = [(f"p{k}", rng.choice(FAMILIES[:3]), rng.choice(FAMILIES[:3]), rng.choice([0.3, 0.55, None])) for k in range(60)]
    hints = [(p, k, "protein", rng.choice(FAMILIES[:3])) for p, *_ in pairs for k in range(rng.randrange(5))]
    predictions = spark.createDataFrame(pairs, "pair_id string, family string, pred_family string, confidence double")
    steps = spark.createDataFrame(hints, "pair_id string, step_id int, role string, hint string")
    grid = {"max_confidence": (0.4, 1.0), "strength": (0.5, 0.8), "max_share": (0.2,), "min_steps": (2,)}
    half = {r.pair_id: r.h for r in predictions.select("pair_id", fold(predictions.pair_id, 2, "sweep-1").alias("h")).collect()}
    got = voting.rescue_sweep(predictions, steps, grid).orderBy("point").collect()
    assert [(r.max_confidence, r.strength) for r in got] == [(0.4, 0.5), (0.4, 0.8), (1.0, 0.5), (1.0, 0.8)]
    for r in got:
        one = traces.rescued(predictions, steps, r.min_steps, r.strength, r.max_share, r.max_confidence).collect()
        assert r.n_rescued == sum(x.rescue is not None for x in one)
        for h, value in ((0, r.tuned_f1), (1, r.other_f1)):
            assert abs(value - macro([(x.family, x.final) for x in one if half[x.pair_id] == h])) < 1e-6
    assert sum(r.best for r in got) == 1 and max(got, key=lambda r: (r.tuned_f1, -r.point)).best
