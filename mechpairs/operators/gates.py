"""Quality gates on candidates, weights by consensus, preferences and record checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GATES = tuple(f"G{k}" for k in range(1, 11))
CRITICAL = ("G1", "G2", "G3", "G4", "G6")
STRICT = (*CRITICAL, "G5", "G7", "G8", "G9", "G10")
TIER_RANK = {"full_correct": 3, "family_correct": 2, "near_miss": 1}


def all_of(names: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n)
    return out


def tier_of(held: Callable[[tuple[str, ...]], Column], subtype_tier: Column, abstain: Column, gap_step: Column) -> Column:
    """The first that holds: full_correct, family_correct, near_miss, abstention, drop.
    ``held`` tells whether all gates of a list hold."""
    critical, commit = held(CRITICAL), ~abstain
    return (
        F.when(critical & (subtype_tier == "exact") & held(("G5",)) & commit, "full_correct")
        .when(critical & (subtype_tier == "in_whitelist") & commit, "family_correct")
        .when(held(("G1", "G2", "G4")) & (subtype_tier != "out_of_whitelist") & commit, "near_miss")
        .when(abstain & held(("G1", "G2", "G3", "G6")) & gap_step, "abstention").otherwise("drop")
    )


def with_tier(rows: DataFrame, strict: bool = False) -> DataFrame:
    """``rows`` (ten gate columns, subtype_tier, abstain, gap_step) with critical, passed and
    the tier of ``tier_of``."""
    critical = all_of(CRITICAL)
    tier = tier_of(all_of, F.col("subtype_tier"), F.col("abstain"), F.col("gap_step"))
    return rows.withColumns({"critical": critical, "gate_passed": all_of(STRICT) if strict else critical, "tier": tier, "n_gates": sum(F.col(g).cast("int") for g in GATES)})


def gate_rates(rows: DataFrame) -> DataFrame:
    """(gate, n, rate) and, as gate ``any_pair``, the share of pairs with a passing candidate.

    One pass: counts of each pair first, then of all.
    """
    def share(hits: Column, n: Column) -> Column:
        return F.round(F.when(n > 0, hits / n), 6)

    known = [F.count(g).alias(f"n_{g}") for g in GATES]
    pairs = rows.groupBy("pair_id").agg(F.count("*").alias("n"), *(F.count_if(g).alias(g) for g in GATES), *known, F.bool_or("gate_passed").alias("any"))
    whole = pairs.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for g in GATES for c in (g, f"n_{g}")), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count("*").alias("n_pairs"), F.count_if("any").alias("held"), F.count("any").alias("n_any"),
    )
    each = [F.struct(F.lit(g).alias("gate"), F.col("n").alias("n"), share(F.col(g), F.col(f"n_{g}")).alias("rate")) for g in GATES]
    told = F.struct(F.lit("any_pair").alias("gate"), F.col("n_pairs").alias("n"), share(F.col("held"), F.col("n_any")).alias("rate"))
    return whole.select(F.inline(F.array(*each, told)))


def tier_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tier").agg(F.count("*").alias("n"))


def pruned(rows: DataFrame, keep: int = 8) -> DataFrame:
    """At most ``keep`` candidates of a pair: passed, critical, number of gates, number.
    Rows with an array ``candidates`` of (gate_passed, critical, n_gates, below), where
    ``below`` is the negative number, give the numbers of their own first ones: no sort of
    all candidates."""
    if "candidates" in rows.columns:
        first = F.slice(F.sort_array("candidates", False), 1, keep)
        return rows.select("pair_id", F.explode(first["below"]).alias("below")).select("pair_id", (-F.col("below")).alias("candidate_id"))
    w = Window.partitionBy("pair_id").orderBy(F.desc("gate_passed"), F.desc("critical"), F.desc("n_gates"), "candidate_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).drop("rank")


def reranked(rows: DataFrame, keys: list[str], into: str = "best") -> DataFrame:
    """Best candidate of each pair by a list of keys, highest first, then its number.  Rows
    with an array ``candidates`` stay, with the best of their own as a column ``into``."""
    if "candidates" in rows.columns:
        first = F.array_max(F.transform("candidates", lambda c: F.struct(*(c[k].alias(f"k{n}") for n, k in enumerate(keys)), c["below"], c.alias("c"))))
        return rows.withColumn(into, first["c"])
    w = Window.partitionBy("pair_id").orderBy(*(F.desc_nulls_last(k) for k in keys), "candidate_id")
    return rows.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def rerank_changes(rows: DataFrame, before: list[str], after: list[str], score: str) -> DataFrame:
    """One row: pairs, winners that change between two key lists, mean gain of ``score``."""
    if "candidates" in rows.columns:
        both = reranked(reranked(rows, before, "a"), after, "b")
        gain = F.col("b")[score] - F.col("a")[score]
        return both.agg(F.count("*").alias("n"), F.count_if(F.col("a.candidate_id") != F.col("b.candidate_id")).alias("changed"), F.round(F.avg(gain), 6).alias("mean_gain"))
    a = reranked(rows, before).select("pair_id", F.col("candidate_id").alias("ca"), F.col(score).alias("sa"))
    b = reranked(rows, after).select("pair_id", F.col("candidate_id").alias("cb"), F.col(score).alias("sb"))
    return a.join(b, "pair_id").agg(F.count("*").alias("n"), F.count_if(F.col("ca") != F.col("cb")).alias("changed"), F.round(F.avg(F.col("sb") - F.col("sa")), 6).alias("mean_gain"))


def consensus(votes: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """(pair_id, n_votes, k_family, k_subtype, k_direction, majority): committed votes that
    agree with the gold, and their most frequent family (by name on a tie).  Without
    ``gold`` the votes carry its columns."""
    rows = votes.where(~F.col("abstain"))
    rows = rows if gold is None else rows.join(gold, "pair_id")
    fam = F.col("v_family") == F.col("family")
    by = rows.groupBy("pair_id", "v_family").agg(
        F.count("*").alias("n"), F.count_if(fam).alias("kf"), F.count_if(fam & (F.col("v_subtype") == F.col("subtype"))).alias("ks"), F.count_if(F.col("v_direction") == F.col("direction")).alias("kd"),
    )
    return by.groupBy("pair_id").agg(F.sum("n").alias("n_votes"), F.sum("kf").alias("k_family"), F.sum("ks").alias("k_subtype"), F.sum("kd").alias("k_direction"), F.max_by("v_family", F.struct("n", "v_family")).alias("majority"))


def consensus_of_tallies(rows: DataFrame) -> DataFrame:
    """``consensus`` of one row for each pair with its committed votes by family, an array
    ``tallies`` of (n, v_family, kf, ks, kd): votes and their agreements with family, subtype
    and direction.  Needs no grouping; families without a vote may be there with n 0."""
    def summed(k: str) -> Column:
        return F.aggregate("tallies", F.lit(0).cast("long"), lambda a, t: a + t[k])

    out = rows.select("pair_id", "tallies", F.inline(F.array(F.struct(summed("n").alias("n_votes"))))).where("n_votes > 0")
    return out.select("pair_id", "n_votes", summed("kf").alias("k_family"), summed("ks").alias("k_subtype"), summed("kd").alias("k_direction"), F.array_max("tallies")["v_family"].alias("majority"))


def consensus_weight(k: DataFrame, base: float = 1.0, cap: float = 2.5, lone: float = 0.5) -> DataFrame:
    """Sample weight: base * (1 + 0.5 (kf - 1) + 0.3 (ks - 1) + 0.2 (kd - 1)), each term at
    least zero, halved where of two votes or more at most one agrees, capped."""
    def term(c: str, w: float) -> Column:
        return w * F.greatest(F.col(c) - 1, F.lit(0))

    raw = base * (1 + term("k_family", 0.5) + term("k_subtype", 0.3) + term("k_direction", 0.2))
    weak = (F.col("n_votes") >= 2) & (F.col("k_family") <= 1)
    return k.withColumn("weight", F.round(F.least(F.lit(cap), F.when(weak, raw * lone).otherwise(raw)), 4))


def consensus_winner(records: DataFrame, floor: float = 0.0) -> DataFrame:
    """One record for each pair out of one for each source: family match, tier, final and
    geometric score, among records at or over ``floor`` whose tier is not drop.

    Rows with an array ``candidates`` of (final, below, ...), ``below`` the negative number,
    give the record of their own ones, as columns beside those they have: nothing is sorted."""
    def ranked(tier: Column) -> Column:
        rank = F.lit(0)
        for t, r in TIER_RANK.items():
            rank = F.when(tier == t, r).otherwise(rank)
        return rank

    if "candidates" in records.columns:
        valid = F.filter("candidates", lambda c: (c["final"] >= floor) & (c["tier"] != "drop"))
        rows = records.withColumn("_valid", valid)

        def best_of(name: Column, k: Column) -> Column:
            c = F.array_max(F.filter("_valid", lambda c: c["source"] == name))
            return F.struct(c["match"], ranked(c["tier"]).alias("tier_rank"), c["final"], c["geomean"], (-k).alias("place"), c.alias("c"))

        won = F.array_max(F.transform(F.array_sort(F.array_distinct(F.col("_valid")["source"])), best_of))["c"]
        return rows.withColumn("_won", won).select(*records.columns, F.inline(F.array("_won"))).where("candidate_id is not null")
    rank = ranked(F.col("tier"))
    rows = records.where((F.col("final") >= floor) & (F.col("tier") != "drop"))
    own = Window.partitionBy("pair_id", "source").orderBy(F.desc("final"), "candidate_id")
    best = Window.partitionBy("pair_id").orderBy(F.desc("match"), F.desc("tier_rank"), F.desc("final"), F.desc("geomean"), "source")
    return rows.withColumns({"tier_rank": rank, "r": F.row_number().over(own)}).where("r = 1").withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def safe_weights(rows: DataFrame, audits: DataFrame, hard: tuple[str, ...], floor: float = 0.3) -> DataFrame:
    """Rows without a hard flag (its head before = or :) and with a quality of ``floor`` or
    more, their weight times the quality, kept within 0 and the old weight; rows that
    were not audited leave."""
    heads = F.transform("flags", lambda f: F.regexp_extract(f, "^[^=:]*", 0))
    ok = ~F.arrays_overlap(heads, F.array(*map(F.lit, hard))) & (F.col("quality") >= floor)
    new = F.round(F.greatest(F.lit(0.0), F.least(F.col("weight"), F.col("weight") * F.col("quality"))), 4)
    return rows.join(audits, "pair_id").where(F.coalesce(ok, F.lit(False))).select("pair_id", "tier", new.alias("weight"))


def penalised(rows: DataFrame, factor: float = 0.7) -> DataFrame:
    """Weights cut where at most one vote agrees."""
    return rows.withColumn("weight", F.round(F.when(F.col("k_family") <= 1, F.col("weight") * factor).otherwise(F.col("weight")), 4))


def record_errors(records: DataFrame, tiers: tuple[str, ...] = ("full_correct", "family_correct", "near_miss", "abstention")) -> DataFrame:
    """(pair_id, nth, errors): missing keys, repeated pair, unknown tier, not exactly one
    assistant message; ``messages`` is an array of (role, content)."""
    nth = F.row_number().over(Window.partitionBy("pair_id").orderBy("ord"))
    said = F.size(F.filter("messages", lambda m: m["role"] == "assistant"))
    checks = F.array(
        F.when(F.col("pair_id").isNull() | F.col("family").isNull(), "missing_key"), F.when(F.col("nth") > 1, "duplicate"),
        F.when(~F.coalesce(F.col("tier").isin(*tiers), F.lit(False)), "bad_tier"), F.when(F.coalesce(said, F.lit(0)) != 1, "assistant_count"),
    )
    return records.withColumn("nth", nth).select("pair_id", "nth", F.array_join(F.filter(checks, F.isnotnull), ",").alias("errors"))


def preferences(rows: DataFrame, families: tuple[str, ...], most: int = 2, seed: str = "pref-1", alone: bool = False, kept: tuple[str, ...] = ()) -> DataFrame:
    """(pair_id, kind, chosen, rejected): worse variants of good answers.

    direction_flip for directed full_correct rows, evidence_drop where two ids or more are
    cited, family_swap to the next family, abstain_unsafe for near misses; at most
    ``most`` of a pair, in the order of a digest.  ``alone`` tells that a pair has one row,
    so that its own variants are ordered and no other; ``kept`` are columns of the row that
    stay.
    """
    answer = F.concat_ws(" ", "family", "direction", F.array_join("evidence", "+"))
    flip = F.when(F.col("direction") == "a_to_b", "b_to_a").when(F.col("direction") == "b_to_a", "a_to_b")
    swap = F.lit(families[0])
    for k, f in enumerate(families):
        swap = F.when(F.col("family") == f, families[(k + 1) % len(families)]).otherwise(swap)
    full = F.col("tier").isin("full_correct", "family_correct")

    def kind(name: str, when: Column, rejected: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("kind"), rejected.alias("rejected")))

    made = F.array(
        kind("direction_flip", full & flip.isNotNull(), F.concat_ws(" ", "family", flip, F.array_join("evidence", "+"))),
        kind("evidence_drop", full & (F.size("evidence") >= 2), F.concat_ws(" ", "family", "direction")),
        kind("family_swap", full, F.concat_ws(" ", swap, "direction", F.array_join("evidence", "+"))),
        kind("abstain_unsafe", F.col("tier") == "near_miss", answer),
    )
    def place(name: Column) -> Column:
        return F.md5(F.concat_ws("|", F.lit(seed), "pair_id", name).cast("binary"))

    variants = F.filter(made, F.isnotnull)
    if alone:
        placed = F.transform(variants, lambda v: F.struct(place(v["kind"]).alias("place"), v["kind"].alias("kind"), v["rejected"].alias("rejected")))
        variants = F.slice(F.sort_array(placed), 1, most)
    out = rows.select("pair_id", *kept, answer.alias("answer"), F.inline(variants))
    chosen = F.when(F.col("kind") == "abstain_unsafe", "abstain").otherwise(F.col("answer"))
    if not alone:
        w = Window.partitionBy("pair_id").orderBy(place(F.col("kind")), "kind")
        out = out.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return out.select("pair_id", "kind", chosen.alias("chosen"), "rejected", *kept)


def orphans(prefs: DataFrame, records: DataFrame) -> DataFrame:
    """Number of preferences whose pair has no record, and of all.  Both are told from one
    join, so the preferences are made once."""
    held = records.select("pair_id").distinct().withColumn("_held", F.lit(True))
    met = prefs.select("pair_id").join(held, "pair_id", "left")
    return met.agg(F.count("*").alias("n"), F.count_if(F.col("_held").isNull()).alias("n_orphans"))
