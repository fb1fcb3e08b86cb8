"""Measures on label distributions, held as maps from label to probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def entropy(dist: Column) -> Column:
    """Shannon entropy in nats; negative values count as none, null and empty maps have 0."""
    def part(r: Column) -> Column:
        return F.when(r > 1e-12, -r * F.ln(r)).otherwise(0.0)

    def of(p: Column) -> Column:
        return let(total(p), lambda s: F.when(s > 0, total(F.transform(p, lambda v: let(v / s, part)))).otherwise(0.0))

    return let(F.transform(F.map_values(dist), lambda v: F.greatest(v, F.lit(0.0))), of)


def smoothed(p: Column, q: Column, eps: float = EPS) -> Column:
    """Pairs (p, q) over the union of the labels, each side smoothed and normalised."""
    both = F.map_values(F.map_zip_with(p, q, lambda k, a, b: F.struct(
        (F.greatest(F.coalesce(a, F.lit(0.0)), F.lit(0.0)) + eps).alias("p"), (F.greatest(F.coalesce(b, F.lit(0.0)), F.lit(0.0)) + eps).alias("q"),
    )))
    sp, sq = total(F.transform(both, lambda x: x["p"])), total(F.transform(both, lambda x: x["q"]))
    return F.transform(both, lambda x: F.struct((x["p"] / sp).alias("p"), (x["q"] / sq).alias("q")))


def kl(p: Column, q: Column, eps: float = EPS) -> Column:
    return total(F.transform(smoothed(p, q, eps), lambda x: x["p"] * F.ln(x["p"] / x["q"])))


def js(p: Column, q: Column, eps: float = EPS) -> Column:
    """Jensen-Shannon divergence in nats."""
    def half(x: Column) -> Column:
        m = (x["p"] + x["q"]) / 2
        return (x["p"] * F.ln(x["p"] / m) + x["q"] * F.ln(x["q"] / m)) / 2

    return total(F.transform(smoothed(p, q, eps), half))


def sensitivity(probes: DataFrame, symmetric: bool = False) -> DataFrame:
    """By flag and over all (flag null): mean divergence of relevant and of null
    perturbations, and the gap.  ``probes(perturbation, relevant, p_original, p_perturbed)``."""
    d = js(F.col("p_original"), F.col("p_perturbed")) if symmetric else kl(F.col("p_original"), F.col("p_perturbed"))
    by = probes.withColumn("d", d).groupingSets([[], ["perturbation"]], "perturbation").agg(
        F.count_if("relevant").alias("n_relevant"), F.count_if(~F.col("relevant")).alias("n_null"),
        F.coalesce(F.avg(F.when(F.col("relevant"), F.col("d"))), F.lit(0.0)).alias("r"), F.coalesce(F.avg(F.when(~F.col("relevant"), F.col("d"))), F.lit(0.0)).alias("z"),
    )
    return by.select("perturbation", "n_relevant", "n_null", F.round("r", 5).alias("on_relevant"), F.round("z", 5).alias("on_null"), F.round(F.col("r") - F.col("z"), 5).alias("gap"))


def intervention(probes: DataFrame) -> DataFrame:
    """By family and over all (family null): accuracy with true, adversarial and no
    evidence.  ``probes(family, true_ev, adv_ev, no_ev)``; no_ev may be null."""
    def acc(c: str) -> Column:
        return F.count_if(F.col(c) == F.col("family")) / F.count("*")

    base = F.count("no_ev")
    none = F.when(base > 0, F.count_if(F.col("no_ev") == F.col("family")) / base)
    return probes.groupingSets([[], ["family"]], "family").agg(
        F.count("*").alias("n"), F.round(acc("true_ev"), 6).alias("acc_true"), F.round(acc("adv_ev"), 6).alias("acc_adv"), F.round(none, 6).alias("acc_none"),
        F.round(acc("true_ev") - acc("adv_ev"), 6).alias("drop"), (acc("adv_ev") >= none).alias("robust"),
    )
