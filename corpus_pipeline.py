"""Corpus pipeline: five stages over ``documents``, each on what the last kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from mechpairs.llm import mil_quality, mixing, ngram_join, packing, pii
from mechpairs.llm.common import durable, read_table, words


#: Near duplicates: words of a shingle, and the Jaccard similarity from which documents link.
SHINGLE = 5
NUM, DEN = 80, 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = mil_quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return mil_quality.score(docs, model).where(F.col("quality_score") >= mil_quality.ACCEPT).drop("quality_score")


def row_key(docs: DataFrame) -> Column:
    """Text that orders rows by (doc_id, digest of the text), null ids last; two rows
    have the same one only if both are the same."""
    own = F.col("doc_id")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        own = F.lpad(F.hex(own.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(" " * 32))
    return F.concat(F.coalesce(F.concat(F.lit("0"), own.cast("string"), F.lit("\0")), F.lit("1")), digest)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the least by (doc_id, digest of the text), of each group that links.

    Each (doc_id, text) is a document here, so another text under a doc_id that
    repeats is judged by itself, and of rows that repeat both one stays (the least
    by its other columns).  A null doc_id is no id: such rows link by their texts,
    come after all others, and stay, each of them, where they hold no words.
    """
    keyed = docs.withColumn("_row", row_key(docs))
    found = ngram_join.join_documents(keyed.select(F.col("_row").alias("doc_id"), "text"), SHINGLE, NUM, DEN)
    kept = durable(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_row")).agg(F.count("*").alias("_n")))
    once = keyed.join(ngram_join.small(kept.where("_n = 1")), "_row", "left_semi").select(*docs.columns)
    more = kept.where("_n > 1")
    if more.isEmpty():
        return once
    again = keyed.join(more, "_row", "left_semi")
    bare = F.col("doc_id").isNull() & (F.size(words(F.col("text"))) == 0)
    one = again.where(~bare).groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("_least")).select("_least.*")
    return once.unionByName(one).unionByName(again.where(bare).select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities of the raked weights."""
    return mixing.sample(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", sequences),
]

#: Trained models, tokeniser ids and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
