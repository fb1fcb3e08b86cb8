"""Labels from template sentences: pairs, normalised templates, rule cascade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILIES = ("AdverseRisk", "Efficacy", "PD_Activity", "PK_Absorption", "PK_Distribution", "PK_Excretion", "PK_Metabolism")


@dataclass(frozen=True)
class Rule:
    """First matching rule labels a template.

    Group numbers of ``pattern`` tell where the parts are: ``subtype`` and
    ``polarity`` may be a fixed text instead; ``subject`` 0 means both sides.
    """

    family: str
    pattern: str
    subtype: str | int
    polarity: str | int
    subject: int = 0
    object: int = 0


# Sentence patterns, their families, subtypes and polarities.
RULES = (
    Rule("AdverseRisk", r"^The risk or severity of (.+?) can be increased when <(?:A|B)> is combined with <(?:A|B)>\.$", 1, "risk"),
    Rule("AdverseRisk", r"^The risk or severity of (.+?) can be decreased when <(?:A|B)> is combined with <(?:A|B)>\.$", 1, "risk_down"),
    Rule("PK_Metabolism", r"^The metabolism of <(A|B)> can be (increased|decreased) when combined with <(A|B)>\.$", "metabolism", 2, 3, 1),
    Rule("PK_Distribution", r"^The serum concentration of <(A|B)> can be (increased|decreased) when it is combined with <(A|B)>\.$", "serum_concentration", 2, 3, 1),
    Rule("PK_Distribution", r"^The serum concentration of the active metabolites? of <(A|B)> can be (increased|decreased) when (?:it is )?(?:used|combined) (?:in combination )?with <(A|B)>\.$", "active_metabolite_serum_conc", 2, 3, 1),
    Rule("PK_Absorption", r"^<(A|B)> can cause a(?:n)? (decrease|increase) in the absorption of <(A|B)>.*$", "absorption_change", 2, 1, 3),
    Rule("PK_Absorption", r"^The (bioavailability|absorption) of <(A|B)> can be (increased|decreased) when combined with <(A|B)>\.$", 1, 3, 4, 2),
    Rule("PK_Excretion", r"^<(A|B)> may (decrease|increase) the excretion rate of <(A|B)>.*$", "excretion_rate", 2, 1, 3),
    Rule("PK_Excretion", r"^The excretion of <(A|B)> can be (increased|decreased) when combined with <(A|B)>\.$", "excretion", 2, 3, 1),
    Rule("PK_Excretion", r"^The renal clearance of <(A|B)> can be (decreased|increased) when combined with <(A|B)>\.$", "renal_clearance", 2, 3, 1),
    Rule("PK_Distribution", r"^The protein binding of <(A|B)> can be (decreased|increased) when combined with <(A|B)>\.$", "protein_binding", 2, 3, 1),
    Rule("PD_Activity", r"^<(A|B)> may (increase|decrease) the (.+?) activities of <(A|B)>\.$", 3, 2, 1, 4),
    Rule("Efficacy", r"^The therapeutic efficacy of <(A|B)> can be (increased|decreased) when used in combination with <(A|B)>\.$", "therapeutic_efficacy", 2, 3, 1),
    Rule("Efficacy", r"^<(A|B)> may (decrease|increase) effectiveness of <(A|B)> as a diagnostic agent\.$", "diagnostic_effectiveness", 2, 1, 3),
    Rule("AdverseRisk", r"^The risk of a hypersensitivity reaction to <(A|B)> is increased when it is combined with <(A|B)>\.$", "hypersensitivity_reaction", "risk", 2, 1),
    Rule("PK_Distribution", r"^The serum concentration of the active metabolites? of <(A|B)> can be (increased|decreased) when <(?:A|B)> is used in combination with <(A|B)>\.$", "active_metabolite_serum_conc", 2, 3, 1),
    Rule("PK_Distribution", r"^The serum concentration of the active metabolites? of <(A|B)> can be reduced when <(?:A|B)> is used in combination with <(A|B)>.*$", "active_metabolite_serum_conc", "down", 2, 1),
    Rule("PK_Distribution", r"^The serum concentration of [A-Za-z0-9\- ]+, an active metabolite of <(A|B)>, can be (increased|decreased|reduced) when used in combination with <(A|B)>\.$", "active_metabolite_serum_conc", 2, 3, 1),
)
# Subtypes that mean the same.
CANONICAL = {("PK_Excretion", "excretion"): "excretion_rate", ("PK_Absorption", "absorption"): "absorption_change"}
RARE_SUBTYPE = 50


def slug(text: Column) -> Column:
    """Lower-case words joined by underscores; ``unspecified`` if nothing is left."""
    joined = F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_")
    bare = F.regexp_replace(joined, "^_+|_+$", "")
    return F.when(bare == "", F.lit("unspecified")).otherwise(bare)


def canonical_pairs(mentions: DataFrame) -> DataFrame:
    """One row for each unordered pair of ``mentions(s, o, description, ord)``.

    The first description in document order stays; a pair seen again is
    bidirectional.
    """
    keyed = mentions.select(F.least("s", "o").alias("a_id"), F.greatest("s", "o").alias("b_id"), "s", "description", "ord")
    first = F.min_by(F.struct("s", "description"), "ord")
    return keyed.groupBy("a_id", "b_id").agg(
        first.alias("first"), F.count("*").alias("n_seen"), F.count_distinct("description").alias("n_texts")
    ).select(
        F.concat_ws("|", "a_id", "b_id").alias("pair_id"), "a_id", "b_id", F.col("first.s").alias("raw_subject_id"),
        F.col("first.description").alias("description"), (F.col("n_seen") > 1).alias("bidirectional"), "n_seen", "n_texts",
    )


def with_template(pairs: DataFrame) -> DataFrame:
    """Adds ``template``: names of subject and object as ``<A>`` and ``<B>``."""
    other = F.when(F.col("raw_subject_id") == F.col("a_id"), F.col("b_id")).otherwise(F.col("a_id"))
    return pairs.withColumn("template", F.replace(F.replace("description", F.col("raw_subject_id"), F.lit("<A>")), other, F.lit("<B>")))


def classified(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds (family, subtype, polarity, subject, object) of the first rule that
    matches ``template``; family ``Other`` if none does.

    The rule's number is found first and the parts follow from it.  ``inline``
    keeps both steps apart, so each pattern is tried once for a row.
    """
    template = F.col("template")
    number = F.lit(-1)
    for k in reversed(range(len(rules))):
        number = F.when(template.rlike(rules[k].pattern), F.lit(k)).otherwise(number)
    numbered = rows.select("*", F.inline(F.array(F.struct(number.alias("rule")))))

    def pick(value, default: Column) -> Column:
        out = default
        for k, rule in enumerate(rules):
            out = F.when(F.col("rule") == k, value(rule)).otherwise(out)
        return out

    def group(rule: Rule, k: int) -> Column:
        return F.regexp_extract(template, rule.pattern, k)

    def side(k_of) -> Column:
        return pick(lambda r: group(r, k_of(r)) if k_of(r) else F.lit("both"), F.lit(""))

    parts = F.struct(
        pick(lambda r: F.lit(r.family), F.lit("Other")).alias("family"),
        pick(lambda r: F.lit(r.subtype) if isinstance(r.subtype, str) else slug(group(r, r.subtype)), F.lit("unmatched")).alias("subtype"),
        pick(
            lambda r: F.lit(r.polarity) if isinstance(r.polarity, str)
            else F.when(group(r, r.polarity).startswith("increase"), "up").otherwise("down"),
            F.lit(None).cast("string"),
        ).alias("polarity"),
        side(lambda r: r.subject).alias("subject"), side(lambda r: r.object).alias("object"),
    )
    return numbered.select("*", F.inline(F.array(parts))).drop("rule")


def label_pairs(pairs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Labels of pairs: family, canonical subtype, polarity, subject and object.

    Templates are few beside the pairs, so each is classified once.  ``templates(template)``
    are all that may come, where the caller knows them: a small table that goes to every
    task.  Pairs that have a ``template`` keep it.
    """
    bare = pairs.drop("bidirectional")
    rows = bare if "template" in pairs.columns else with_template(bare)
    if templates is None:
        kinds = classified(rows.where("template is not null").select("template").distinct())
    else:
        kinds = F.broadcast(classified(templates))
    none = {"family": "Other", "subtype": "unmatched", "subject": "", "object": ""}
    tagged = rows.join(kinds, "template", "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in none.items()})
    other = F.when(F.col("raw_subject_id") == F.col("a_id"), F.col("b_id")).otherwise(F.col("a_id"))

    def side(tag: str) -> Column:
        return F.when(F.col(tag) == "A", F.col("raw_subject_id")).when(F.col(tag) == "B", other)

    subtype = F.col("subtype")
    for (family, old), new in CANONICAL.items():
        subtype = F.when((F.col("family") == family) & (F.col("subtype") == old), F.lit(new)).otherwise(subtype)
    return tagged.select(
        "pair_id", "a_id", "b_id", "template", "family", subtype.alias("subtype"), "polarity",
        side("subject").alias("subject_id"), side("object").alias("object_id"), (F.col("subject") == "both").alias("bidirectional"),
    )


def collapse_rare(labels: DataFrame, least: int = RARE_SUBTYPE) -> DataFrame:
    """Subtypes with fewer than ``least`` pairs become ``misc_<family>``.

    Counts are aggregated and joined back, so a large family is never one task.
    """
    counts = labels.groupBy("family", "subtype").agg(F.count("*").alias("n_subtype"))
    rare = (F.col("n_subtype") < least) & (F.col("family") != "Other")
    return (
        labels.join(counts, ["family", "subtype"])
        .withColumn("subtype_original", F.col("subtype"))
        .withColumn("subtype", F.when(rare, F.concat(F.lit("misc_"), F.lower("family"))).otherwise(F.col("subtype")))
        .drop("n_subtype")
    )


def template_histogram(pairs: DataFrame) -> DataFrame:
    return with_template(pairs).groupBy("template").agg(F.count("*").alias("n_pairs"))


def taxonomy_counts(labels: DataFrame) -> DataFrame:
    """Pairs of each family and subtype, with subtotals (nulls)."""
    return labels.rollup("family", "subtype").agg(F.count("*").alias("n_pairs"))


def integrity(labels: DataFrame) -> DataFrame:
    """Counts of label rows that break a rule; all are zero on sound labels."""
    def count(c: Column, name: str) -> Column:
        return F.count_if(c).alias(name)

    known = F.col("family").isin(*FAMILIES)
    return labels.agg(
        F.count("*").alias("n_labels"),
        count(~known, "unknown_family"),
        count(F.col("subtype").isNull() | (F.col("subtype") == ""), "empty_subtype"),
        count(known & F.col("polarity").isNull(), "missing_polarity"),
        count(F.col("bidirectional") & (F.col("subject_id").isNotNull() | F.col("object_id").isNotNull()), "sided_bidirectional"),
        count(known & ~F.col("bidirectional") & (F.col("subject_id").isNull() | F.col("object_id").isNull()), "sideless_directed"),
        count(F.col("subject_id") == F.col("object_id"), "same_side"),
        count(F.col("a_id") >= F.col("b_id"), "unordered_pair"),
    )
