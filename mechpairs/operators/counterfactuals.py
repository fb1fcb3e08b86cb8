"""Perturbed inputs and hard negatives for labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Flag prefixes in their order, and those that a subtype allows.
ENZYMES = ("cyp1a2", "cyp2a6", "cyp2b6", "cyp2c8", "cyp2c9", "cyp2c19", "cyp2d6", "cyp2e1", "cyp3a4", "cyp3a5")
TRANSPORTERS = ("p_gp", "bcrp", "oatp1b1", "oatp1b3", "oat1", "oat3", "oct1", "oct2")
GUT = ("p_gp", "bcrp", "cyp3a4")
ALLOWED = {
    "metabolism": ENZYMES, "serum_concentration": ENZYMES + TRANSPORTERS, "excretion_rate": TRANSPORTERS + ENZYMES,
    "active_metabolite_serum_conc": ENZYMES, "absorption_change": GUT, "bioavailability": GUT, "protein_binding": (),
}
# Families that an answer is easily taken for.
CONFUSED = {
    "PK_Metabolism": ("PK_Excretion", "PK_Distribution"), "PK_Excretion": ("PK_Metabolism", "PK_Distribution"),
    "PK_Distribution": ("PK_Metabolism", "PK_Excretion"), "PK_Absorption": ("PK_Distribution", "PK_Metabolism"),
    "PD_Activity": ("Efficacy",), "Efficacy": ("PD_Activity",), "AdverseRisk": ("PD_Activity", "Efficacy"),
}
FLIP = {"a_to_b": "b_to_a", "b_to_a": "a_to_b"}


def flipped(direction: Column) -> Column:
    """A direction seen from the other order; others stay."""
    out = direction
    for old, new in FLIP.items():
        out = F.when(direction == old, new).otherwise(out)
    return out


def prefix_order(subtype: Column) -> Column:
    """Prefixes that a subtype allows, in order."""
    out = F.array(*map(F.lit, ENZYMES + TRANSPORTERS))
    for name, prefixes in ALLOWED.items():
        out = F.when(subtype == name, F.array(*map(F.lit, prefixes)).cast("array<string>")).otherwise(out)
    return out


KINDS = ("inh", "ind", "sub")


def packed_flags(flags: DataFrame, end: str) -> DataFrame:
    """(``end``, a mask for each kind, odd): the flags of an entity in one short row, so that no
    pair is repeated for each flag of its ends.  Bit k of a mask is prefix k of the list;
    flags of other prefixes stand in ``odd``, as (prefix, kind)."""
    place = F.array_position(F.array(*map(F.lit, ENZYMES + TRANSPORTERS)), F.col("prefix"))
    bit = F.call_function("shiftleft", F.lit(1), (place - 1).cast("int"))
    rows = flags.where("prefix is not null").where(F.col("kind").isin(*KINDS)).select("entity", "prefix", "kind", place.alias("place"), bit.alias("bit"))
    masks = [F.coalesce(F.bit_or(F.when((F.col("kind") == k) & (F.col("place") > 0), F.col("bit"))), F.lit(0)).alias(f"{end}_{k}") for k in KINDS]
    odd = F.sort_array(F.collect_set(F.when(F.col("place") == 0, F.struct("prefix", "kind"))))
    return rows.groupBy(F.col("entity").alias(end)).agg(*masks, odd.alias(f"{end}_odd"))


def in_mask(mask: Column, prefix: Column) -> Column:
    """Whether a listed prefix is in a mask."""
    place = F.array_position(F.array(*map(F.lit, ENZYMES + TRANSPORTERS)), prefix)
    return F.call_function("shiftright", mask, (place - 1).cast("int")).bitwiseAND(F.lit(1)) == 1


def prefixes(mask: Column, odd: Column, kind: str) -> Column:
    """The prefixes of one kind as an array, listed ones first."""
    listed = F.filter(F.array(*map(F.lit, ENZYMES + TRANSPORTERS)), lambda p, k: F.call_function("shiftright", mask, k).bitwiseAND(F.lit(1)) == 1)
    return F.concat(listed, F.transform(F.filter(odd, lambda o: o["kind"] == kind), lambda o: o["prefix"]))


def sides(pairs: DataFrame, held: tuple[str, ...] = ()) -> DataFrame:
    """Each pair with the sides that may be its subject: the declared one, else both.  Of
    ``held`` the columns of both ends (a_id_x, b_id_x) come as those of subject and object."""
    both = F.array(*(
        F.struct(F.lit(side).alias("side"), F.col(x).alias("subject"), F.col(y).alias("object"), *(F.col(f"{e}_{c}").alias(f"{name}_{c}") for name, e in (("subject", x), ("object", y)) for c in held))
        for side, x, y in (("A", "a_id", "b_id"), ("B", "b_id", "a_id"))
    ))
    known = F.coalesce(F.col("subject_id").isin(F.col("a_id"), F.col("b_id")), F.lit(False))
    return pairs.select("pair_id", "subtype", "subject_id", F.inline(both)).where(~known | (F.col("subject_id") == F.col("subject"))).drop("subject_id")


def relevant_flips(pairs: DataFrame, flags: DataFrame) -> DataFrame:
    """(pair_id, side, subject, object, flag, prefix): the first allowed prefix that the
    subject inhibits or induces (in this order) and the object is a substrate of.

    ``flags(entity, prefix, kind)`` has one row for each true flag.  A pair meets the masks
    of its ends, and the first allowed prefix of a side follows from them.
    """
    met = pairs
    for end in ("a_id", "b_id"):
        met = met.join(packed_flags(flags, end).drop(f"{end}_odd"), end)
    rows = sides(met, KINDS).withColumn("order", prefix_order(F.col("subtype")))
    acts = F.col("subject_inh").bitwiseOR(F.col("subject_ind")).bitwiseAND(F.col("object_sub"))
    first = F.get(F.filter("order", lambda p: in_mask(acts, p)), F.lit(0))
    hits = rows.where(acts != 0).select("pair_id", "side", "subject", "object", "subject_inh", "order", F.explode(F.array(first)).alias("prefix")).where("prefix is not null")
    hits = hits.withColumn("late", ~in_mask(F.col("subject_inh"), F.col("prefix"))).withColumn("place", F.array_position("order", F.col("prefix")))
    best = F.min(F.struct("place", "side", "late", "subject", "object", "prefix", F.when(F.col("late"), "ind").otherwise("inh").alias("kind")))
    return hits.groupBy("pair_id").agg(best.alias("m")).select(
        "pair_id", "m.side", "m.subject", "m.object", F.concat_ws("_", "m.prefix", "m.kind").alias("flag"), "m.prefix")


def null_flips(relevant: DataFrame, flags: DataFrame, seed: str = "null-1") -> DataFrame:
    """(pair_id, side, flag): a true flag of the subject under another prefix that the
    object is no substrate of; of several the first in hash order."""
    rows = relevant.join(packed_flags(flags, "subject"), "subject").join(packed_flags(flags, "object"), "object", "left")
    none = F.array().cast("array<struct<prefix:string,kind:string>>")
    rows = rows.withColumn("_taken", prefixes(F.coalesce("object_sub", F.lit(0)), F.coalesce("object_odd", none), "sub"))

    def free(kind: str) -> Column:
        own = F.filter(prefixes(F.col(f"subject_{kind}"), F.col("subject_odd"), kind), lambda p: (p != F.col("prefix")) & ~F.array_contains("_taken", p))
        return F.transform(own, lambda p: F.concat_ws("_", p, F.lit(kind)))

    drawn = F.transform(F.concat(free("inh"), free("ind")), lambda f: F.struct(F.md5(F.concat_ws("|", F.lit(seed), "pair_id", f).cast("binary")).alias("x"), f.alias("flag")))
    own = rows.select("pair_id", "side", F.explode(F.array(F.array_min(drawn))).alias("m")).where("m is not null")
    return own.groupBy("pair_id", "side").agg(F.min("m").alias("m")).select("pair_id", "side", "m.flag")


def hard_negatives(rows: DataFrame, subtypes: DataFrame, most: int = 4) -> DataFrame:
    """(pair_id, kind, nth, family, subtype, direction): wrong answers close to the gold.

    Kinds in order: to_adverse, axis_swap (the families it is taken for), subtype_swap
    (the next subtype of the family by name, round the end), direction_flip; at most
    ``most`` of a pair.  ``subtypes(family, subtype, next_subtype)`` is the vocabulary.
    """
    family, subtype, direction = F.col("family"), F.col("subtype"), F.col("direction")

    def option(kind: str, when: Column, f: Column, s: Column, d: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), f.alias("n_family"), s.alias("n_subtype"), d.alias("n_direction")))

    taken = F.lit(None).cast("array<string>")
    for name, others in CONFUSED.items():
        taken = F.when(family == name, F.array(*map(F.lit, others))).otherwise(taken)
    swaps = [option("axis_swap", F.get(taken, F.lit(k)).isNotNull(), F.get(taken, F.lit(k)), subtype, direction) for k in range(2)]
    made = F.array(
        option("to_adverse", family != "AdverseRisk", F.lit("AdverseRisk"), F.lit("adverse_effects"), direction), *swaps,
        option("subtype_swap", F.col("next_subtype").isNotNull() & (F.col("next_subtype") != subtype), family, F.col("next_subtype"), direction),
        option("direction_flip", direction.isin(*FLIP), family, subtype, flipped(direction)),
    )
    out = rows.join(subtypes, ["family", "subtype"], "left").select("pair_id", F.posexplode(F.slice(F.filter(made, F.isnotnull), 1, most)).alias("nth", "x"))
    return out.select("pair_id", "nth", "x.kind", F.col("x.n_family").alias("family"), F.col("x.n_subtype").alias("subtype"), F.col("x.n_direction").alias("direction"))


def next_subtypes(labels: DataFrame) -> DataFrame:
    """(family, subtype, next_subtype): the vocabulary with the next name of the family."""
    words = labels.select("family", "subtype").distinct()
    w = Window.partitionBy("family").orderBy("subtype")
    first = F.min("subtype").over(Window.partitionBy("family"))
    return words.select("family", "subtype", F.coalesce(F.lead("subtype").over(w), first).alias("next_subtype"))


def pk_evidence(pairs: DataFrame, flags: DataFrame) -> DataFrame:
    """(pair_id, prefix, ids): the rules that ``flags`` support for each pair, in the order
    of the prefixes, and the first prefix; a prefix that fits both ways is told for A.

    Pairs move with the masks of their ends, and the rules are written out last."""
    met = pairs.select("pair_id", "a_id", "b_id")
    for end in ("a_id", "b_id"):
        met = met.join(packed_flags(flags, end), end)
    own = F.struct(*(F.col(f"{e}_{c}").alias(f"{e[0]}_{c}") for e in ("a_id", "b_id") for c in (*KINDS, "odd")))
    once = met.groupBy("pair_id").agg(F.collect_list(own).alias("ends"))

    def ways(m: Column, side: str, x: str, other: str, y: str) -> Column:
        inh, ind, sub = (prefixes(m[f"{e}_{k}"], m[f"{e}_odd"], k) for e, k in ((x, "inh"), (x, "ind"), (y, "sub")))
        place = F.array(*map(F.lit, ENZYMES + TRANSPORTERS))
        return F.transform(F.array_intersect(F.array_union(inh, ind), sub), lambda p: F.struct(
            F.array_position(place, p).alias("place"), p.alias("prefix"), F.lit(side).alias("side"), F.lit(other).alias("other"), F.array_contains(inh, p).alias("inh"), F.array_contains(ind, p).alias("ind")))

    found = F.sort_array(F.flatten(F.transform("ends", lambda m: F.concat(ways(m, "A", "a", "B", "b"), ways(m, "B", "b", "A", "a")))))
    told = once.select("pair_id", F.explode(F.array(found)).alias("found")).where(F.size("found") > 0)
    # A prefix that is found again stands behind its first.
    told = told.withColumn("_each", F.filter("found", lambda x, k: (k == 0) | (F.get("found", k - 1)["prefix"] != x["prefix"])))

    def ids(x: Column) -> Column:
        def flag(kind: str, side: Column) -> Column:
            return F.concat(F.lit("pk_flag_"), x["prefix"], F.lit(f"_{kind}_"), side)

        return F.filter(F.array(
            F.concat(F.lit("enzyme_"), F.upper(x["prefix"])), F.when(x["inh"], flag("inhibitor", x["side"])), F.when(x["ind"], flag("inducer", x["side"])), flag("substrate", x["other"]),
        ), lambda i: i.isNotNull())

    return told.select("pair_id", F.get("found", F.lit(0))["prefix"].alias("prefix"), F.flatten(F.transform("_each", ids)).alias("ids"))


def shared_evidence(a_proteins: Column, b_proteins: Column, a_pathways: Column, b_pathways: Column) -> Column:
    """Ids of the proteins and pathways that both sides have, sorted."""
    def ids(kind: str, a: Column, b: Column) -> Column:
        return F.transform(F.array_sort(F.array_intersect(F.coalesce(a, F.array()).cast("array<string>"), F.coalesce(b, F.array()).cast("array<string>"))), lambda x: F.concat(F.lit(f"{kind}_"), x))

    return F.concat(ids("protein", a_proteins, b_proteins), ids("pathway", a_pathways, b_pathways))


def picked(options: Column, salt: str) -> Column:
    """An element that a hash of the pair chooses; null of none."""
    n = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), F.col("pair_id")).cast("binary")), 1, 7), 16, 10).cast("long")
    return F.when(F.size(options) > 0, F.get(options, (n % F.size(options)).cast("int")))


def adversarial_evidence(rows: DataFrame) -> DataFrame:
    """(pair_id, kind, ids, claimed) of misleading evidence for ``rows(pair_id, family,
    prefix, a_proteins, b_proteins, a_pathways, b_pathways)``.

    A PK pair with a true prefix cites another enzyme; other PK pairs cite proteins
    (and pathways) of each side as if shared, the rest an enzyme.  Without material
    ``kind`` is the reason to skip, and ids are null.
    """
    pk = F.startswith("family", F.lit("PK_"))
    enzymes = F.array(*map(F.lit, ENZYMES))
    swap = pk & F.col("prefix").isNotNull()
    enzyme = picked(F.when(swap, F.array_remove(enzymes, F.col("prefix"))).otherwise(enzymes), "adv-1")
    rule = F.array(
        F.concat(F.lit("enzyme_"), F.upper(enzyme)), F.concat(F.lit("pk_flag_"), enzyme, F.lit("_inhibitor_A")), F.concat(F.lit("pk_flag_"), enzyme, F.lit("_substrate_B")),
    )

    def cited(kind: str, side: str, salt: str) -> Column:
        return F.concat(F.lit(f"{kind}_"), picked(F.col(f"{side}_{kind}s"), salt).cast("string"))

    proteins = F.array(cited("protein", "a", "adv-2"), cited("protein", "b", "adv-3"))
    routes = F.array(cited("pathway", "a", "adv-4"), cited("pathway", "b", "adv-5"))
    targets = (F.size("a_proteins") > 0) & (F.size("b_proteins") > 0)
    both = F.when((F.size("a_pathways") > 0) & (F.size("b_pathways") > 0), F.concat(proteins, routes)).otherwise(proteins)
    known = F.col("family").isin(*CONFUSED)
    kind = F.when(~known | F.col("family").isNull(), "unknown_family").when(swap, "enzyme_swap").when(pk & ~F.coalesce(targets, F.lit(False)), "no_proteins").otherwise("cross_family_swap")
    ids = F.when(kind == "enzyme_swap", rule).when(kind == "cross_family_swap", F.when(pk, both).otherwise(rule))
    claimed = F.when(ids.isNotNull(), F.when(swap | ~pk, "PK_Metabolism").otherwise("PD_Activity"))
    return rows.select("pair_id", kind.alias("kind"), ids.alias("ids"), claimed.alias("claimed"))
