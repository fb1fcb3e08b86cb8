"""License scans: diagonal voting.

All rolling word k-grams of every text are joined to the positions of the same
k-grams in the templates (by hash, then by the words themselves).  Hits vote for
their diagonal, document position minus template position; neighbouring
diagonals are merged, and the merged spans are verified by the share of the
template they cover.

The templates are a parameter of bounded size, so their side is broadcast and
the corpus is not shuffled; only hits are.

Defined results: null and empty texts have no words, labels or places and score
0; rows are told apart by doc_id and a hash of the text, so texts that share an id, or
have none, are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, durable, let, read_table

K = 3
MIN_COVER = 0.6
MAX_SHIFT = 2
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Fixed values of the contract: phrases and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# The method's own templates, opening words of common notices.
TEMPLATES = (
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case.  ``lower`` does the same for every word that matters
    here, but for one sign that it turns into an ASCII letter."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.contains(t, F.lit("K")), F.translate(t, UPPER, UPPER.lower())).otherwise(F.lower(t))


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BREAKS), "")


def grams(ws: Column, k: int = K) -> Column:
    """Word k-grams in order, as text."""
    starts = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (k - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.concat_ws(" ", w, *(F.get(ws, i + j) for j in range(1, k))))


def template_grams(spark: SparkSession, base=BASE, extra=TEMPLATES, k: int = K) -> DataFrame:
    """One row for each k-gram position of each template."""
    rows = []
    for tpl, (label, phrase, is_base) in enumerate([(*x, True) for x in base] + [(*x, False) for x in extra]):
        ws = phrase.split()
        rows += [(tpl, label, is_base, len(ws) - k + 1, p, " ".join(ws[p : p + k])) for p in range(len(ws) - k + 1)]
    df = spark.createDataFrame(rows, "tpl int, label string, is_base boolean, n_grams int, tpos int, gram string")
    return df.withColumn("h", F.xxhash64("gram"))


def diagonals(docs: DataFrame, templates: DataFrame, k: int = K) -> DataFrame:
    """Votes for each document, template and diagonal."""
    hits = (
        docs.select("doc_id", F.xxhash64("text").alias("own"), let(license_words(F.col("text")), lambda w: grams(w, k)).alias("g"))
        .select("doc_id", "own", F.posexplode("g").alias("pos", "gram"))
        .withColumn("h", F.xxhash64("gram"))
        .join(F.broadcast(templates), ["h", "gram"])
    )
    return hits.groupBy("doc_id", "own", "tpl", "label", "is_base", "n_grams", (F.col("pos") - F.col("tpos")).alias("diag")).agg(
        F.collect_set("tpos").alias("tpos")
    )


def verified_spans(votes: DataFrame, min_cover: float = MIN_COVER, max_shift: int = MAX_SHIFT) -> DataFrame:
    """Spans (doc_id, own, label, is_base, start, cover) that hold.

    A base phrase needs all its k-grams on one diagonal.  Other templates may
    shift by inserted or missing words: diagonals at most ``max_shift`` apart
    are merged and must cover ``min_cover`` of the template's k-grams.
    """
    exact = votes.where(F.col("is_base") & (F.size("tpos") == F.col("n_grams"))).select(
        "doc_id", "own", "label", "is_base", F.col("diag").cast("long").alias("start"), F.lit(1.0).alias("cover")
    )
    w = Window.partitionBy("doc_id", "own", "tpl").orderBy("diag")
    merged = (
        votes.where(~F.col("is_base"))
        .withColumn("new", (F.coalesce(F.col("diag") - F.lag("diag").over(w), F.lit(max_shift + 1)) > max_shift).cast("int"))
        .withColumn("chain", F.sum("new").over(w))
        .groupBy("doc_id", "own", "tpl", "label", "is_base", "n_grams", "chain")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("tpos")))).alias("hit"),
            F.min(F.col("diag") + F.array_min("tpos")).cast("long").alias("start"),
        )
        .withColumn("cover", F.col("hit") / F.col("n_grams"))
        .where(F.col("cover") >= min_cover)
    )
    return exact.unionByName(merged.select(exact.columns))


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Every document with its base places, labels and score."""
    spans = verified_spans(durable(diagonals(docs, templates)))
    base = F.col("is_base")
    found = spans.groupBy(F.col("doc_id").alias("id"), F.col("own").alias("own_text")).agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    sizes = docs.select("doc_id", F.xxhash64("text").alias("own"), F.size(license_words(F.col("text"))).cast("long").alias("n_words"))
    return sizes.join(found, (F.col("own") == F.col("own_text")) & F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"), template_grams(spark))


def oracle() -> str:
    rows = []
    for tpl, (label, phrase, is_base) in enumerate([(*x, True) for x in BASE] + [(*x, False) for x in TEMPLATES]):
        ws = phrase.split()
        rows += [f"({tpl}, '{label}', {is_base}, {len(ws) - K + 1}, {p}, '{' '.join(ws[p : p + K])}')" for p in range(len(ws) - K + 1)]
    return f"""
WITH t(tpl, label, is_base, n_grams, tpos, gram) AS (VALUES {', '.join(rows)}),
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'),
  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(greatest(len(w) - {K - 1}, 0))) AS pos FROM d),
h AS (SELECT doc_id, tpl, label, is_base, n_grams, pos - tpos AS diag, tpos
  FROM (SELECT doc_id, pos, w[pos + 1] || ' ' || w[pos + 2] || ' ' || w[pos + 3] AS gram FROM g) JOIN t USING (gram)),
v AS (SELECT doc_id, tpl, label, is_base, n_grams, diag, list(DISTINCT tpos) AS tpos FROM h GROUP BY ALL),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tpl ORDER BY diag) AS chain FROM (SELECT *,
  CASE WHEN diag - lag(diag) OVER (PARTITION BY doc_id, tpl ORDER BY diag) <= {MAX_SHIFT} THEN 0 ELSE 1 END AS new FROM v WHERE NOT is_base)),
m AS (SELECT doc_id, label, is_base, min(diag + list_min(tpos)) AS start,
  len(list_distinct(flatten(list(tpos)))) / any_value(n_grams) AS cover FROM c GROUP BY doc_id, tpl, label, is_base, chain),
s AS (SELECT doc_id, label, is_base, diag AS start, 1.0 AS cover FROM v WHERE is_base AND len(tpos) = n_grams
  UNION ALL SELECT * FROM m WHERE cover >= {MIN_COVER}),
f AS (SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(start) FILTER (is_base) AS first_word,
  max(start) FILTER (is_base) AS last_word, list_sort(list(DISTINCT label) FILTER (is_base)) AS bl,
  list_sort(list(DISTINCT label)) AS al, max(cover) AS score FROM s GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(bl, ','), '') AS base_labels, coalesce(array_to_string(al, ','), '') AS labels,
  round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN f USING (doc_id)"""
