"""Summary of training runs, with its SQL.

A supplier is a run and its lines are the entries of its log, of four shapes; some runs
lack their last checkpoint or all of them, and some logs are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sweeps
from . import frames
from .registry import register
from .trace_queries import nested


def _run() -> Column:
    k = F.col("l_suppkey")
    return F.concat(F.lit("lr"), (k % 9 + 1).cast("string"), F.lit("e-4_s"), k.cast("string"), F.lit("_r"), F.when(k % 4 == 0, "x").otherwise((k % 3 + 1).cast("string")))


def logs(s: SparkSession, d: str) -> DataFrame:
    """(run, checkpoint, state)."""
    n, loss = F.col("l_linenumber"), F.col("l_quantity") / 8
    entry = F.to_json(F.struct(
        F.when(n.isin(1, 2, 4, 6, 7), loss).alias("loss"), F.when(n <= 2, F.col("l_discount")).alias("grad_norm"), F.when(n.isin(3, 4), F.col("l_quantity") / 16).alias("eval_loss"),
        F.when(n == 3, F.col("l_tax")).alias("eval_assistant_token_acc"), F.when(n == 5, 0.5).alias("learning_rate"), F.col("l_orderkey").alias("step"),
    ))
    lines = frames.table(s, d, "lineitem").select("l_suppkey", F.struct("l_orderkey", n.alias("n"), "l_partkey", "l_quantity", entry.alias("e")).alias("o"))
    rows = lines.groupBy("l_suppkey").agg(F.sort_array(F.collect_list("o")).alias("o")).withColumn("checkpoint", F.explode(F.array(F.lit(1), F.lit(2), F.lit(None).cast("int"))))
    k, c = F.col("l_suppkey"), F.col("checkpoint")
    taken = F.array_join(F.transform(F.filter("o", lambda x: (c == 2) | (x["n"] <= 2)), lambda x: x["e"]), ", ")
    full = F.concat(F.lit('{"epoch": 1.5, "global_step": '), k.cast("string"), F.lit(', "log_history": ['), taken, F.when((c == 2) & (k % 11 == 0), "").otherwise("]}"))
    return rows.select(_run().alias("run"), "checkpoint", F.when(k % 7 == 0, F.lit(None).cast("string")).when(c.isNull(), "{}").when((c == 2) & (k % 5 == 0), F.lit(None).cast("string")).otherwise(full).alias("state"))


def configs(s: SparkSession, d: str) -> DataFrame:
    return frames.table(s, d, "lineitem").where("l_suppkey % 2 = 1").select("l_suppkey").distinct().select(_run().alias("run"), F.lit('{"lr": 0.5, "other": NaN}').alias("config"))


# Of each run: the lines its last checkpoint holds; a key that sorts them.
LOG = """lg AS (SELECT *, l_suppkey % 7 <> 0 AND (l_suppkey % 5 = 0 OR l_suppkey % 11 <> 0) AS readable FROM lineitem),
ent AS (SELECT l_suppkey, l_linenumber IN (1, 2, 6, 7) AS tr, l_linenumber IN (3, 4) AS te, l_quantity / 8 AS loss, CASE WHEN l_linenumber <= 2 THEN l_discount END AS norm, l_quantity / 16 AS ev,
CASE WHEN l_linenumber = 3 THEN l_tax END AS acc, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS p FROM lg WHERE readable AND (l_suppkey % 5 <> 0 OR l_linenumber <= 2))"""
register(
    "sweep_summary", lambda s, d: sweeps.sweep_summary(logs(s, d), configs(s, d)),
    nested(f"""WITH {LOG}, ends AS (SELECT l_suppkey, max(p) FILTER (tr) AS lt, max(p) FILTER (te) AS le, arg_min(p, (ev, p)) FILTER (te) AS be, min(loss) FILTER (tr) AS ml, max(coalesce(norm, 0)) FILTER (tr) AS mn, count_if(te) AS ne FROM ent GROUP BY l_suppkey)
SELECT 'lr' || (k % 9 + 1) || 'e-4_s' || k || '_r' || CASE WHEN k % 4 = 0 THEN 'x' ELSE (k % 3 + 1)::VARCHAR END AS run, CASE WHEN k % 7 = 0 THEN 'no_trainer_state' WHEN readable THEN 'ok' ELSE 'unreadable' END AS status,
CASE WHEN k % 2 = 1 THEN 0.5::DOUBLE ELSE ((k % 9 + 1) || 'e-4')::DOUBLE END AS lr, CASE WHEN k % 4 <> 0 THEN (k % 3 + 1)::INT END AS lora_r, CASE WHEN readable THEN 1.5::DOUBLE END AS epoch, CASE WHEN readable THEN k END AS global_step, NULL::BIGINT AS max_steps,
t.loss AS last_train_loss, ml AS min_train_loss, mn AS max_grad_norm, t.norm AS last_grad_norm, b.ev AS best_eval_loss, b.l_orderkey AS best_eval_step, e.ev AS last_eval_loss, e.l_orderkey AS last_eval_step, e.acc AS last_eval_token_acc,
CASE WHEN readable THEN coalesce(ne, 0)::BIGINT END AS n_eval_events, CASE WHEN readable THEN coalesce(ne, 0) = 0 END AS needs_backfill
FROM (SELECT DISTINCT l_suppkey AS k, readable FROM lg) r LEFT JOIN ends x ON x.l_suppkey = k LEFT JOIN ent t ON t.l_suppkey = k AND t.p = lt LEFT JOIN ent b ON b.l_suppkey = k AND b.p = be LEFT JOIN ent e ON e.l_suppkey = k AND e.p = le"""),
)
