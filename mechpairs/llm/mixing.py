"""Mixing sources to target weights: iterative proportional fitting.

Documents are counted into (source, language, topic) cells of tokens.  The cells'
probabilities start at the share of tokens to keep and are raked in turn to the three
target marginals, each step cut at one, until no probability moves by more than
``TOLERANCE`` of itself; documents are then sampled by their cell's probability.  So
marginals are met under the cut, not before it; what a value cannot reach with all
its cells at one stays open, and ``residuals`` shows it.

The corpus is read twice, without moving texts: once for the cell counts (partial
sums before the shuffle, so a hot source costs nothing), once to attach
probabilities.  Cells, not rows, go through the iterations.

Defined results: a null source or language is the value ``unknown``; null or
empty texts have no tokens, count for nothing and are kept with their cell's
probability (one, if the cell holds no tokens); values without a target get the share
they have; an empty table gives an empty result; repeated rows share their fate, as
the draw is a hash of doc_id (null counts as an id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, read_table, words

#: Raking rounds at most, and the relative change of a probability that ends them.
ROUNDS = 60
TOLERANCE = 0.001
KEEP_SHARE = 0.5
SOURCE_POWER = 0.7
LANG_TARGET = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
TOPIC_TARGET = {"prose": 0.8, "legal": 0.05, "contact": 0.05, "table": 0.05, "noise": 0.05}
SEED = "mix-1"
#: Topic by the first rule that holds.
TOPIC_RULES = (
    ("legal", ("icense",)),
    ("table", (" | ",)),
    ("noise", ("%%%", "!! ", "***")),
    ("contact", ("@", "+1 (")),
)
DIMS = ("source", "lang", "topic")


def topic(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    out = F.lit("prose")
    for name, signs in reversed(TOPIC_RULES):
        hit = F.lit(False)
        for s in signs:
            hit = hit | F.contains(t, F.lit(s))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def target(cells: DataFrame, dim: str, given: dict[str, float] | None, power: float) -> DataFrame:
    """(dim, share): target share of each value; the shares sum to one.

    Given shares hold for the values listed, others get their own share of
    tokens; without given shares the token share is flattened by ``power``.
    """
    by = cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
    if given is None:
        raw = F.pow(F.col("t"), F.lit(power))
    else:
        share = F.lit(None).cast("double")
        for k, v in given.items():
            share = F.when(F.col(dim) == k, F.lit(float(v))).otherwise(share)
        total = cells.agg(F.sum("tokens")).first()[0] or 1
        raw = F.coalesce(share, F.col("t") / F.lit(float(total)))
    raws = by.where(F.col("t") > 0).select(dim, raw.alias("raw"))
    whole = raws.agg(F.sum("raw")).first()[0] or 1.0
    return raws.select(dim, (F.col("raw") / F.lit(float(whole))).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep_share: float = KEEP_SHARE, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` that hold tokens, with the probability ``p`` that fits tokens * p to
    the marginals, and the wanted tokens of their values (``want_<dim>``).

    Every step groups the cells by one dimension and joins the sums back; the cells
    are written once a round, which keeps the plan short.
    """
    fitted = cells.where("tokens > 0")
    budget = keep_share * (fitted.agg(F.sum("tokens")).first()[0] or 0)
    for dim, shares in targets.items():
        fitted = fitted.join(shares.select(dim, (F.col("share") * F.lit(budget)).alias(f"want_{dim}")), dim)
    fitted = durable(fitted.withColumn("p", F.lit(float(keep_share))))
    for _ in range(rounds):
        step = fitted.withColumn("old", F.col("p"))
        for dim in DIMS:
            have = step.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("p")).alias("have"))
            step = step.join(have, dim).withColumn("p", F.least(F.lit(1.0), F.col("p") * F.col(f"want_{dim}") / F.col("have"))).drop("have")
        step = durable(step)
        fitted = step.drop("old")
        if step.where(F.abs(F.col("p") - F.col("old")) > TOLERANCE * F.col("old")).isEmpty():
            break
    return fitted


def residuals(fitted: DataFrame) -> DataFrame:
    """(dim, value, want, have): wanted and expected tokens of every value."""
    have = F.sum(F.col("tokens") * F.col("p")).alias("have")
    parts = [
        fitted.groupBy(F.lit(d).alias("dim"), F.col(d).alias("value")).agg(F.max(f"want_{d}").alias("want"), have) for d in DIMS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform number of a document, the same in every run."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def cell_columns() -> list[Column]:
    return [
        F.coalesce(F.col("source"), F.lit("unknown")).alias("source"),
        F.coalesce(F.col("lang"), F.lit("unknown")).alias("lang"),
        topic(F.col("text")).alias("topic"),
    ]


def fitted_cells(docs: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Raked cells of a corpus."""
    feats = docs.select(*cell_columns(), F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
    cells = durable(feats.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")))
    return rake(cells, {
        "source": target(cells, "source", None, SOURCE_POWER),
        "lang": target(cells, "lang", LANG_TARGET, 1.0),
        "topic": target(cells, "topic", TOPIC_TARGET, 1.0),
    }, keep_share)


def probabilities(docs: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """(source, lang, topic, p) of every cell that holds tokens."""
    return fitted_cells(docs, keep_share).select(*DIMS, "p")


def mix(docs: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """Every document with its cell, probability and whether it is kept."""
    feats = docs.select("doc_id", *cell_columns(), F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
    prob = F.coalesce("p", F.lit(1.0))
    return feats.join(probabilities(docs, keep_share), list(DIMS), "left").select(
        "doc_id", *DIMS, "n_tokens", F.round(prob, 6).alias("prob"), (draw(F.col("doc_id")) < prob).alias("kept")
    )


def sample(docs: DataFrame, keep_share: float = KEEP_SHARE) -> DataFrame:
    """The rows of ``docs`` that the draw keeps, unchanged."""
    odds = probabilities(docs, keep_share).select(*(F.col(d).alias(f"_cell_{d}") for d in DIMS), F.col("p").alias("_cell_p"))
    named = docs.withColumns({f"_cell_{d}": c for d, c in zip(DIMS, cell_columns(), strict=True)})
    return (
        named.join(odds, [f"_cell_{d}" for d in DIMS], "left")
        .where(draw(F.col("doc_id")) < F.coalesce("_cell_p", F.lit(1.0))).select(*docs.columns)
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same fit as a recursive query with windows in place of joins."""
    def case(dim: str, given: dict[str, float]) -> str:
        return f"CASE {dim} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in given.items()) + " ELSE t / (SELECT sum(tokens)::DOUBLE FROM c) END"

    raws = {"source": f"pow(t::DOUBLE, {SOURCE_POWER}::DOUBLE)", "lang": case("lang", LANG_TARGET), "topic": case("topic", TOPIC_TARGET)}
    wants = ",\n".join(
        f"w_{d} AS (SELECT {d}, raw / sum(raw) OVER () * {KEEP_SHARE}::DOUBLE * (SELECT sum(tokens)::DOUBLE FROM c) AS want_{d} "
        f"FROM (SELECT {d}, {raws[d]} AS raw FROM (SELECT {d}, sum(tokens)::DOUBLE AS t FROM c GROUP BY {d}) WHERE t > 0))" for d in DIMS
    )
    step, last = "r", "p"
    for k, d in enumerate(DIMS):
        step = f"(SELECT *, least(1.0::DOUBLE, {last} * want_{d} / sum(tokens * {last}) OVER (PARTITION BY {d})) AS p{k} FROM {step}{' WHERE open' if not k else ''})"
        last = f"p{k}"
    rules = " ".join("WHEN " + " OR ".join(f"contains(x, '{s}')" for s in signs) + f" THEN '{name}'" for name, signs in TOPIC_RULES)
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, CASE {rules} ELSE 'prose' END AS topic,
  len(list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'), lambda v: v <> '')) AS n_tokens FROM (SELECT *, coalesce(text, '') AS x FROM documents)),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
{wants},
r AS (SELECT 0 AS round, source, lang, topic, tokens, want_source, want_lang, want_topic, {KEEP_SHARE}::DOUBLE AS p, true AS open
  FROM c JOIN w_source USING (source) JOIN w_lang USING (lang) JOIN w_topic USING (topic)
  UNION ALL SELECT round + 1, source, lang, topic, tokens, want_source, want_lang, want_topic, {last},
  max(abs({last} - p) > {TOLERANCE}::DOUBLE * p) OVER () FROM {step} WHERE round < {ROUNDS}),
f AS (SELECT source, lang, topic, p FROM r WHERE round = (SELECT max(round) FROM r))
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(p, 1.0::DOUBLE), 6) AS prob,
  ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < coalesce(p, 1.0::DOUBLE) AS kept
FROM d LEFT JOIN f USING (source, lang, topic)"""
