"""Citation tokens: canonical forms, and whether a context holds them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Activity flags, enzyme and transporter names, synonyms of one of them.
FLAG = r"^([a-z][a-z0-9]*)[_-](sub(?:strate|strates)?|inh(?:ibitor|ibitors|ibit)?|ind(?:ucer|ucers|uce)?)$"
ENZYME = r"^(cyp[0-9a-z]+|p[_-]?gp|oatp[0-9a-z]*|bcrp|oct[0-9]?|mrp[0-9]?|mate[0-9]?|oat[0-9]?|ntcp|bsep|mdr[0-9]?|abc[a-z][0-9]*)$"
# A flag's parts, its kind as three letters; the rest takes the line break that "$" passes over.
SHORT = r"^([a-z][a-z0-9]*)[_-](?:(sub)(?:strates?)?|(inh)(?:ibitors?|ibit)?|(ind)(?:ucers?|uce)?)$[\s\S]*"
PGP = ("P-gp", "p-gp", "PGP", "pgp", "ABCB1", "abcb1")
METRIC = r"\s*=[\s\S]*$"


def normalized(token: Column) -> Column:
    """Lower case, hyphens as underscores, flag suffixes cut to three letters."""
    return F.regexp_replace(F.replace(F.lower(F.trim(token)), F.lit("-"), F.lit("_")), SHORT, "$1_$2$3$4")


def metric_name(token: Column) -> Column:
    """``name = value`` cut to its name."""
    return F.trim(F.regexp_replace(token, METRIC, ""))


def forms(token: Column) -> Column:
    """The forms of a cited token that may stand in a context."""
    bare = metric_name(token)
    return F.array_distinct(F.array(token, F.lower(token), bare, F.lower(bare), normalized(token)))


def expanded(ids: Column) -> Column:
    """Context ids with their case variants, canonical flags and bare enzyme names."""
    none = F.array().cast("array<string>")

    def variants(x: Column) -> Column:
        c, base = x["c"], x["base"]
        names = F.when(base.rlike(ENZYME), F.array(base, F.upper(base))).otherwise(none)
        others = F.when(base == "pgp", F.array(*map(F.lit, PGP))).otherwise(none)
        return F.concat(F.array(c, F.lower(c), F.upper(c), normalized(c)), F.when(base != "", F.concat(names, others)).otherwise(none))

    based = F.transform(ids, lambda c: F.struct(c.alias("c"), F.regexp_extract(F.lower(c), FLAG, 1).alias("base")))
    return F.array_remove(F.array_distinct(F.flatten(F.transform(based, variants))), "")


def resolved(cited: Column, context: Column) -> Column:
    """Number of cited tokens that an expanded context holds."""
    return F.size(F.filter(cited, lambda e: F.array_contains(context, e) | F.arrays_overlap(forms(e), context)))
