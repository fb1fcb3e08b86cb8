"""Training runs summed up from the logs that they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMARY = (
    "status", "lr", "lora_r", "epoch", "global_step", "max_steps", "last_train_loss", "min_train_loss", "max_grad_norm", "last_grad_norm", "best_eval_loss", "best_eval_step",
    "last_eval_loss", "last_eval_step", "last_eval_token_acc", "n_eval_events", "needs_backfill",
)


def json(text: Column) -> Column:
    """A JSON text that may hold NaN and infinities, which become null."""
    return F.try_parse_json(F.regexp_replace(text, r"([:\[,]\s*)(?:-?Infinity|NaN)(?=\s*[,}\]])", "$1null"))


def latest_states(states: DataFrame) -> DataFrame:
    """(run, state) of the highest checkpoint of each run that left one; the run's own
    (``checkpoint`` null) only if none did.  A run without any keeps a null."""
    place = F.when(F.col("state").isNotNull(), F.struct(F.col("checkpoint").isNotNull().alias("saved"), F.coalesce("checkpoint", F.lit(0)).alias("n"), F.col("state").alias("s")))
    return states.groupBy("run").agg(F.max(place).alias("_last")).select("run", F.col("_last.s").alias("state"))


def sweep_summary(states: DataFrame, configs: DataFrame) -> DataFrame:
    """One row for each run of ``states(run, checkpoint, state)``, with what its last log says.

    ``state`` is a JSON text whose ``log_history`` is a list of entries of any shape: those
    with a ``loss`` and no ``eval_loss`` are training entries, those with an ``eval_loss``
    evaluations, others count for nothing.  The first of equal least evaluations is the
    best.  A gradient norm that is missing counts as 0 in the largest, as null in the last.
    Learning rate and rank come from ``configs(run, config)``, else from a name such as
    ``lr3e-4_r64``.  ``status`` is ``ok``, ``no_trainer_state`` or ``unreadable``; in the last
    two all else but rate and rank is null.  Missing fields and numbers that are not finite
    are null.  A log is one row of one task.
    """
    one = configs.groupBy("run").agg(F.max("config").alias("_config"))
    rows = latest_states(states).join(one, "run", "left").select("run", "state", F.explode(F.array(json(F.col("state")))).alias("_v"), json(F.col("_config")).alias("_c"))
    log = F.try_variant_get("_v", "$.log_history", "array<variant>")

    def number(e: Column, name: str, kind: str = "double") -> Column:
        return F.try_variant_get(e, f"$.{name}", kind)

    def there(e: Column, name: str) -> Column:
        return number(e, name, "variant").isNotNull()

    def entry(e: Column) -> Column:
        return F.struct(
            there(e, "loss").alias("trains"), there(e, "eval_loss").alias("tests"), number(e, "loss").alias("loss"), number(e, "grad_norm").alias("norm"), number(e, "eval_loss").alias("eval"),
            number(e, "step", "long").alias("step"), number(e, "eval_assistant_token_acc").alias("acc"),
        )

    read = rows.withColumn("_e", F.explode(F.array(F.coalesce(F.transform(log, entry), F.array().cast("array<struct<trains:boolean,tests:boolean,loss:double,norm:double,eval:double,step:bigint,acc:double>>")))))
    split = read.withColumns({"_train": F.filter("_e", lambda e: e["trains"] & ~e["tests"]), "_test": F.filter("_e", lambda e: e["tests"])})
    least = F.array_min(F.transform("_test", lambda e: e["eval"]))
    best = F.try_element_at(F.filter("_test", lambda e: e["eval"] == least), F.lit(1))
    last, last_test = F.try_element_at("_train", F.lit(-1)), F.try_element_at("_test", F.lit(-1))
    name_lr = F.when(F.col("run").startswith("lr"), F.substring(F.substring_index("run", "_", 1), 3, 100).try_cast("double"))
    name_rank = F.when(F.contains("run", F.lit("_r")), F.substring_index("run", "_r", -1).try_cast("int"))
    status = F.when(F.col("state").isNull(), "no_trainer_state").when(F.col("_v").isNull(), "unreadable").otherwise("ok")
    ok = F.col("_v").isNotNull()
    values = {
        "status": status, "lr": F.coalesce(number(F.col("_c"), "lr"), name_lr), "lora_r": F.coalesce(number(F.col("_c"), "lora_r", "int"), name_rank),
        "epoch": number(F.col("_v"), "epoch"), "global_step": number(F.col("_v"), "global_step", "long"), "max_steps": number(F.col("_v"), "max_steps", "long"),
        "last_train_loss": last["loss"], "min_train_loss": F.array_min(F.transform("_train", lambda e: e["loss"])),
        "max_grad_norm": F.array_max(F.transform("_train", lambda e: F.coalesce(e["norm"], F.lit(0.0)))), "last_grad_norm": last["norm"],
        "best_eval_loss": best["eval"], "best_eval_step": best["step"], "last_eval_loss": last_test["eval"], "last_eval_step": last_test["step"], "last_eval_token_acc": last_test["acc"],
        "n_eval_events": F.when(ok, F.size("_test").cast("long")), "needs_backfill": F.when(ok, F.size("_test") == 0),
    }
    return split.select("run", *(values[c].alias(c) for c in SUMMARY))
