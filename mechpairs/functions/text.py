"""Text measures as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEDGES = ("may", "might", "could", "possibly", "perhaps", "likely", "unlikely", "suggests", "appears", "potentially")


def hedge_count(text: Column) -> Column:
    """Hedging words; null text has none."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b(" + "|".join(HEDGES) + r")\b"))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def first_percentage(text: Column) -> Column:
    """The first number that a percent sign follows, as a double; else null."""
    return F.nullif(F.regexp_extract(text, r"([0-9]+(\.[0-9]+)?) ?%", 1), F.lit("")).cast("double")
