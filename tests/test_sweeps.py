"""Sweep summaries by hand values."""

from __future__ import annotations

import json

from mechpairs.operators import sweeps

LOG = [
    {"loss": 2, "grad_norm": 1.5, "step": 1}, {"loss": 0.5, "step": 2, "nested": {"a": [1]}}, {"eval_loss": 0.75, "step": 2, "eval_assistant_token_acc": 0.5}, {"loss": 9, "eval_loss": 0.5, "step": 3},
    {"learning_rate": 1}, {"eval_loss": 0.5, "step": 4}, {"loss": 1.25, "grad_norm": None, "step": 5}, {"eval_loss": 0.625, "step": 6, "eval_assistant_token_acc": 1}, "odd",
]


def test_summary(spark):
    state = json.dumps({"epoch": 2.5, "global_step": 10, "max_steps": 20, "log_history": LOG})
    states = [
        ("lr3e-4_r64", 9, '{"log_history": []}'), ("lr3e-4_r64", 10, state), ("lr3e-4_r64", 11, None), ("lr3e-4_r64", None, "{}"), ("named", None, '{"log_history": [{"loss": NaN, "grad_norm": Infinity}, {"loss": 1}]}'),
        ("lrx_ry", None, None), ("broken", 1, "{"), ("bare", 1, '{"log_history": {"loss": 1}}'),
    ]
    configs = [("named", '{"lr": 0.5, "lora_r": 8}'), ("broken", "{"), ("other", '{"lr": 1}'), ("lrx_ry", None)]
    made = sweeps.sweep_summary(spark.createDataFrame(states, "run string, checkpoint int, state string"), spark.createDataFrame(configs, "run string, config string"))
    got = {r.run: tuple(r)[1:] for r in made.collect()}
    no = (None,) * 14
    assert got == {
        "lr3e-4_r64": ("ok", 0.0003, 64, 2.5, 10, 20, 1.25, 0.5, 1.5, None, 0.5, 3, 0.625, 6, 1.0, 4, False),
        "named": ("ok", 0.5, 8, None, None, None, 1.0, 1.0, 0.0, None, None, None, None, None, None, 0, True),
        "lrx_ry": ("no_trainer_state", None, None, *no), "broken": ("unreadable", None, None, *no), "bare": ("ok", None, None, *(None,) * 12, 0, True),
    }
    assert sweeps.sweep_summary(spark.createDataFrame([], "run string, checkpoint int, state string"), spark.createDataFrame([], "run string, config string")).count() == 0
