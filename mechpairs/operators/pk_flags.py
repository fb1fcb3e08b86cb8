"""Inhibitor, inducer and substrate flags of proteins, from actions and from prose."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import action_flag

# Proteins by identifier, and the names that prose gives them.
PROTEINS = {
    "P05177": "CYP1A2", "P11509": "CYP2A6", "P20813": "CYP2B6", "P10632": "CYP2C8", "P11712": "CYP2C9", "P33261": "CYP2C19", "P10635": "CYP2D6", "P05181": "CYP2E1",
    "P08684": "CYP3A4", "P20815": "CYP3A5", "P08183": "P-gp", "Q9UNQ0": "BCRP", "Q9Y6L6": "OATP1B1", "Q9NPD5": "OATP1B3", "Q4U2R8": "OAT1", "Q8TCC7": "OAT3",
    "O15245": "OCT1", "O15244": "OCT2",
}
NAMES = {p: (p, p.replace("CYP", "CYP ")) for p in PROTEINS.values() if p.startswith("CYP")} | {
    "P-gp": ("P-gp", "Pgp", "P-glycoprotein", "Pglycoprotein", "MDR1", "ABCB1"), "BCRP": ("BCRP", "ABCG2"), "OATP1B1": ("OATP1B1", "SLCO1B1"),
    "OATP1B3": ("OATP1B3", "SLCO1B3"), "OAT1": ("OAT1", "SLC22A6"), "OAT3": ("OAT3", "SLC22A8"), "OCT1": ("OCT1", "SLC22A1"), "OCT2": ("OCT2", "SLC22A2"),
}
# Words before a name, and words after it, for each kind of flag.
BEFORE = {
    "inh": r"(?:inhibit(?:s|ed|ion|or|ing|s of)?|block(?:s|ed|er|ing)?|suppress(?:es|ed|ing)?|reduc(?:es|ed) activity of)\s+",
    "ind": r"(?:induc(?:es|ed|tion|er|ing)|increas(?:es|ed) activity of)\s+",
    "sub": r"(?:substrate(?: of|s of)?|metaboliz(?:ed|es|ation) by|metabolism by)\s+(?:the\s+)?",
}
AFTER = {
    "inh": r"\s+(?:\w+\s+){0,3}(?:is|are)?\s*(?:inhibited|blocked)",
    "ind": r"\s+(?:\w+\s+){0,3}(?:is|are)?\s*induced",
    "sub": r"\s+substrate",
}
FEW_WORDS = r"(?:\w+\s+){0,3}"
# Upper and lower case alike; letters and blanks of all scripts.
EASY = "(?iU)"


def column(protein: str, kind: str) -> str:
    return f"{protein.replace('-', '_')}_{kind}".lower()


FLAGS = {column(p, k): (p, k) for p in NAMES for k in BEFORE}


def said(protein: str, kind: str) -> str:
    """Pattern of a protein's name in a sentence that makes it a flag of ``kind``."""
    name = "|".join(NAMES[protein])
    return rf"\b{BEFORE[kind]}{FEW_WORDS}(?:{name})\b|\b(?:{name}){AFTER[kind]}"


def prose(*columns: str) -> Column:
    """The texts that are not empty, joined by blanks."""
    return F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in columns))


def structured_flags(targets: DataFrame) -> DataFrame:
    """(entity_id, <protein>_<kind>...) from ``targets(entity_id, uniprot, actions)``.

    One row for each entity with a listed protein, all flags false where its actions say
    nothing; an identifier that is not listed and a null one make no row.
    """
    known = F.create_map(*(F.lit(x) for pair in PROTEINS.items() for x in pair))
    rows = targets.select("entity_id", F.try_element_at(known, F.col("uniprot")).alias("p"), F.transform("actions", action_flag).alias("k")).where("p is not null")
    held = [F.coalesce(F.bool_or((F.col("p") == p) & F.array_contains("k", k)), F.lit(False)).alias(c) for c, (p, k) in FLAGS.items()]
    return rows.groupBy("entity_id").agg(*held)


def with_text_flags(entities: DataFrame, structured: DataFrame, texts: tuple[str, ...]) -> DataFrame:
    """``entities`` with every flag and ``text_only``, the flags that prose alone gives.

    A flag of ``structured_flags`` stands; where it is false or the entity has none, the
    texts are searched.  They are read once for protein names, and the patterns of a
    protein run only on texts that name it, so prose that names two proteins is searched
    with six patterns and not with 54.  Null and empty texts give nothing.  Columns of
    ``entities`` that are called like a flag are replaced.
    """
    anyone = "|".join(n for names in NAMES.values() for n in names)
    found = F.regexp_extract_all("_text", F.lit(rf"{EASY}\b({anyone})\b"), F.lit(1))
    plain = F.array_distinct(F.transform(found, lambda n: F.lower(F.translate(n, " -", ""))))
    base = entities.drop(*FLAGS, "text_only").withColumn("_text", prose(*texts))
    # The list of names is a column of its own row, not made anew in each of the 54 places.
    named = base.join(structured, "entity_id", "left").withColumn("_named", F.explode(F.array(plain)))

    def from_text(protein: str, kind: str) -> Column:
        own = sorted({n.lower().replace(" ", "").replace("-", "") for n in NAMES[protein]})
        met = reduce(lambda a, b: a | b, (F.array_contains("_named", n) for n in own))
        return met & F.col("_text").rlike(EASY + said(protein, kind))

    mentioned = {c: F.when(F.coalesce(c, F.lit(False)), "structured").when((F.size("_named") > 0) & from_text(p, k), "text") for c, (p, k) in FLAGS.items()}
    marked = named.select(*(c for c in base.columns if c != "_text"), F.struct(*(m.alias(c) for c, m in mentioned.items())).alias("_by"))
    held = marked.withColumn("_by", F.explode(F.array("_by")))
    only = F.filter(F.array(*(F.when(F.col(f"_by.{c}") == "text", c) for c in FLAGS)), F.isnotnull)
    return held.select(*(c for c in marked.columns if c != "_by"), *(F.col(f"_by.{c}").isNotNull().alias(c) for c in FLAGS), only.alias("text_only"))


def text_only_counts(flagged: DataFrame) -> DataFrame:
    """(flag, n) of the flags that prose alone gave, those with none left out."""
    return flagged.select(F.explode("text_only").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
