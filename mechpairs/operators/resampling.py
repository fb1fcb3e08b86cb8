"""Bootstrap statistics from cell counts.

Class scores depend on cell counts alone, so a replicate draws one multinomial for
each gold class over its few dozen cells; its cost does not depend on the rows.
Replicates are rows of a Spark range, so they spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _f1(cells: dict[tuple[str, str | None], int], gold: list[str]) -> dict[str, float]:
    out = {}
    for g in gold:
        tp = cells.get((g, g), 0)
        support = sum(n for (a, _), n in cells.items() if a == g)
        predicted = sum(n for (_, b), n in cells.items() if b == g)
        out[g] = 2 * tp / (support + predicted) if support + predicted else 0.0
    return out


def bootstrap(scored: DataFrame, draws: int = 500, seed: int = 7) -> DataFrame:
    """(name, point, low, high): macro F1, accuracy and the F1 of each family with 95 %
    intervals, resampled within the gold families; abstentions count as misses.

    The cells, at most families squared, are the only rows that the driver reads.
    """
    pred = F.when(~F.col("abstain"), F.col("pred_family"))
    rows = [(r["g"], r["p"], r["n"]) for r in scored.groupBy(F.col("family").alias("g"), pred.alias("p")).agg(F.count("*").alias("n")).collect()]
    gold = sorted({g for g, _, _ in rows})

    def measures(cells: dict) -> dict[str, float]:
        f1, n = _f1(cells, gold), sum(cells.values())
        return {"macro_f1": float(np.mean(list(f1.values()))) if f1 else 0.0, "accuracy": sum(v for (g, p), v in cells.items() if g == p) / max(n, 1)} | {f"f1:{g}": v for g, v in f1.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for k in batch["id"]:
                rng, cells = np.random.default_rng([seed, int(k)]), {}
                for g in gold:
                    own = sorted(((p, n) for a, p, n in rows if a == g), key=lambda x: str(x[0]))
                    total = sum(n for _, n in own)
                    cells |= {(g, p): int(c) for (p, _), c in zip(own, rng.multinomial(total, [n / total for _, n in own]), strict=True)}
                made += [(name, v) for name, v in measures(cells).items()]
            yield pd.DataFrame(made, columns=["name", "v"])

    drawn = scored.sparkSession.range(draws).mapInPandas(run, "name string, v double")
    spread = drawn.groupBy("name").agg(F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    point = scored.sparkSession.createDataFrame(sorted(measures({(g, p): n for g, p, n in rows}).items()), "name string, point double")
    return point.join(spread, "name").select("name", F.round("point", 6).alias("point"), F.round(F.get("q", F.lit(0)), 6).alias("low"), F.round(F.get("q", F.lit(1)), 6).alias("high"))


def paired_bootstrap(rows: DataFrame, draws: int = 1000, seed: int = 11) -> DataFrame:
    """One row: difference in macro F1 of two models, its 95 % interval and two-sided p,
    from the cells of ``rows(family, a, b)`` resampled within the gold families."""
    cells = [(r["family"], r["a"], r["b"], r["n"]) for r in rows.groupBy("family", "a", "b").agg(F.count("*").alias("n")).collect()]
    gold = sorted({c[0] for c in cells})

    def delta(counts: list[tuple[str, str, str, int]]) -> float:
        def macro(k: int) -> float:
            one: dict = {}
            for g, a, b, n in counts:
                key = (g, (a, b)[k])
                one[key] = one.get(key, 0) + n
            return float(np.mean(list(_f1(one, gold).values()))) if gold else 0.0

        return macro(1) - macro(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for k in batch["id"]:
                rng, counts = np.random.default_rng([seed, int(k)]), []
                for g in gold:
                    own = sorted((c for c in cells if c[0] == g), key=lambda c: (str(c[1]), str(c[2])))
                    total = sum(c[3] for c in own)
                    counts += [(*c[:3], int(n)) for c, n in zip(own, rng.multinomial(total, [c[3] / total for c in own]), strict=True)]
                made.append(delta(counts))
            yield pd.DataFrame({"d": made})

    drawn = rows.sparkSession.range(draws).mapInPandas(run, "d double")
    q = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    p = F.least(F.lit(1.0), 2 * F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))))
    return drawn.agg(F.lit(round(delta(cells), 6)).alias("delta"), q.alias("q"), F.round(p, 6).alias("p")).select("delta", F.round(F.get("q", F.lit(0)), 6).alias("low"), F.round(F.get("q", F.lit(1)), 6).alias("high"), "p")


def judge_means(scores: DataFrame) -> DataFrame:
    """By model and dimension: ratings, mean and standard error of ``scores(item, judge, model, dim, score)``."""
    return scores.groupBy("model", "dim").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_samp("score") / F.sqrt(F.count("*")), 6).alias("stderr"))


def judge_correlation(scores: DataFrame) -> DataFrame:
    """Pearson correlation of every two judges over the (item, model, dim) that both rated.

    Rows with an array ``met`` of (j1, j2, s1, s2), the two scores of every two judges that
    rated the row's item, need no join.
    """
    key = ["item", "model", "dim"]
    if "met" in scores.columns:
        both = scores.select(F.inline("met")).where("j1 < j2")
    else:
        a, b = (scores.select(*key, F.col("judge").alias(f"j{k}"), F.col("score").cast("double").alias(f"s{k}")) for k in (1, 2))
        both = a.join(b, key).where("j1 < j2")
    return both.groupBy("j1", "j2").agg(F.count("*").alias("n"), F.round(F.corr("s1", "s2"), 5).alias("r"))


def krippendorff(scores: DataFrame) -> DataFrame:
    """Interval alpha by dimension over units with two ratings or more, from sums alone."""
    units = scores.groupBy("dim", "item", "model").agg(F.count("*").alias("m"), F.sum("score").alias("s"), F.sum(F.col("score") * F.col("score")).alias("q")).where("m > 1")
    seen = F.sum((F.col("m") * F.col("q") - F.col("s") * F.col("s")) / (F.col("m") - 1))
    by = units.groupBy("dim").agg(F.sum("m").alias("n"), seen.alias("obs"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    observed, expected = F.col("obs") / F.col("n"), (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    return by.select("dim", "n", F.round(F.when(expected > 0, 1 - observed / expected), 5).alias("alpha"))


def extremes(scores: DataFrame, n: int = 20) -> DataFrame:
    """The items with the lowest mean and those with the widest disagreement."""
    by = scores.groupBy("item", "model").agg(F.round(F.avg("score"), 6).alias("mean"), (F.max("score") - F.min("score")).alias("spread"))
    low = by.orderBy("mean", "item", "model").limit(n).withColumn("why", F.lit("lowest"))
    return low.unionByName(by.orderBy(F.desc("spread"), "item", "model").limit(n).withColumn("why", F.lit("disagreed")))
