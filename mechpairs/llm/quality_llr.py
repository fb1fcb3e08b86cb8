"""Quality rules: hashed n-gram log-likelihood ratio (target against raw).

Two multinomials over hashed token uni- and bigrams are counted: one over the
whole raw corpus, one over trusted documents.  A document's score is the mean
log ratio of its n-grams; a fixed threshold gives the verdict.  Everything is
DataFrame expressions: one counting pass, a model of ``buckets`` numbers, one
scoring pass without a shuffle.

Defined results: null or empty text has no words, fails the base rules and has
score 0; without trusted documents every score is 0; repeated rows are judged
one by one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let, read_table, words
from .ngram_join import saved

BUCKETS = 8192
THRESHOLD = -0.3
SYMBOLS = "#*$%&|<>"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters or digits, and runs of other signs."""
    signs = "a-z0-9\\p{L}\\p{N}"  # a-z and 0-9 are letters and digits too, but found faster
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{signs}]+|[^{signs}\\s]+"), F.lit(0))


def token_pairs(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep, w, v): each token and the one after it (null for the last), one row for
    each; one row of nulls for a text without tokens."""
    listed = docs.select(*keep, tokens(text).alias("_t"))
    after = F.slice("_t", F.lit(2), F.greatest(F.size("_t"), F.lit(1)))
    return listed.select(*keep, F.explode_outer(F.arrays_zip(F.col("_t").alias("w"), after.alias("v"))).alias("_z")).select(*keep, "_z.w", "_z.v")


def bucket(buckets: int, *tokens_: Column) -> Column:
    return F.pmod(F.xxhash64(*tokens_), F.lit(buckets)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled as good."""
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0) -> list[float]:
    """Log ratio for each bucket, from counts over all of ``docs``.

    ``trusted`` is broadcast up to a counted number of ids and joined by a shuffle
    beyond.  The model is ``buckets`` numbers whatever the corpus size.
    """
    flag = saved(trusted.select("doc_id").withColumn("good", F.lit(1)))
    marked = docs.select("doc_id", "text").join(flag, "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(0)))
    both = F.array(bucket(buckets, F.col("w")), F.when(F.col("v").isNotNull(), bucket(buckets, F.col("w"), F.col("v"))))
    counts = (
        token_pairs(marked, F.col("text"), "good").where("w is not null").select("good", F.explode(both).alias("b")).where("b is not null")
        .groupBy("b").agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    )
    a = F.lit(float(smoothing))
    full = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0)
    model = full.agg(
        F.array_sort(F.collect_list(F.struct("b", "raw", "target"))).alias("c"),
        F.sum("raw").alias("r"), F.sum("target").alias("t"),
    ).select(
        "t",
        F.transform(
            "c",
            lambda x: F.log((x["target"] + a) / (F.col("t") + a * buckets)) - F.log((x["raw"] + a) / (F.col("r") + a * buckets)),
        ).alias("llr"),
    ).first()
    return list(model["llr"]) if model["t"] else [0.0] * buckets


def log_ratio(model: list[float], *tokens_: Column) -> Column:
    """Log ratio of one n-gram."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    return F.get(table, bucket(len(model), *tokens_))


def repeat_words(ws: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more."""
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
    )

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            ordered,
            lambda s: F.size(F.array_distinct(F.flatten(F.transform(
                F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])),
                lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
            )))),
        )

    return F.when(
        F.size(ws) > 3,
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))),
    ).otherwise(F.lit(0))


def rule_columns(text: Column) -> Column:
    """Struct of the rule counts of one whole text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        ),
    )



def apply_rules(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Every document with rule counts, score and verdict.

    The n-grams of a text are rows of one task, so their sums are complete before
    the shuffle, which moves one row for each document.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    ruled = docs.select("doc_id", "text", rule_columns(F.col("text")).alias("r")).select(
        "doc_id", "text", *(F.col("r")[c].alias(c) for c in counts), F.monotonically_increasing_id().alias("_row")
    )
    each = token_pairs(ruled, F.col("text"), "_row", "doc_id", *counts)
    w, v = F.col("w"), F.col("v")
    one, two = F.when(w.isNotNull(), log_ratio(model, w)), F.when(v.isNotNull(), log_ratio(model, w, v))
    n = F.count("w") + F.count("v")
    score = F.when(n > 0, (F.coalesce(F.sum(one), F.lit(0.0)) + F.coalesce(F.sum(two), F.lit(0.0))) / n).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        each.groupBy("_row", "doc_id", *counts).agg(F.round(score, 6).alias("score"))
        .select("doc_id", *counts, "score", failed.alias("base_failed"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, trusted_ids(read_table(spark, sf_dir, "labels")))
    return apply_rules(docs, model)
