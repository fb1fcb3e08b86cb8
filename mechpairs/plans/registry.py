"""All queries of the library, by name, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import agreement, curation, metrics, selective, similarity, splits, taxonomy
from ..streaming import complete, ingest
from . import frames
from .sql import _ID, query

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, run: Query, sql: str | None = None) -> None:
    _QUERIES[name] = run
    if sql:
        _SQL[name] = query(sql)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def forward(s: SparkSession, d: str) -> DataFrame:
    return frames.scored(s, d, ("ab",))


def report(s: SparkSession, d: str) -> DataFrame:
    return metrics.class_report(metrics.cells(forward(s, d)))


def tokens(s: SparkSession, d: str) -> DataFrame:
    return frames.table(s, d, "lineitem").select(frames.entity_id(F.col("l_partkey")).alias("entity"), F.col("l_suppkey").alias("token")).distinct()


def codes(s: SparkSession, d: str) -> DataFrame:
    return frames.table(s, d, "part").select(frames.entity_id(F.col("p_partkey")).alias("entity"), F.col("p_type").alias("code"))


def parts(s: SparkSession, d: str) -> DataFrame:
    return splits.entity_parts(frames.labels(s, d))


REPORT = """SELECT gold AS family, support, round(coalesce(CASE WHEN predicted > 0 THEN tp / predicted END, 0.0), 6) AS prec, round(tp / support, 6) AS recall,
round(2 * tp / (support + predicted), 6) AS f1 FROM (SELECT gold, sum(n)::BIGINT AS support, sum(CASE WHEN gold = pred THEN n ELSE 0 END)::BIGINT AS tp,
coalesce((SELECT sum(n) FROM cells c WHERE c.pred = g.gold), 0)::BIGINT AS predicted FROM cells g WHERE {0} GROUP BY gold)"""
OK = "(pred_family = family AND NOT abstain)"

register("family_report", report, REPORT.format("pred IS NOT NULL"))
register("family_report_strict", lambda s, d: metrics.class_report(metrics.cells(forward(s, d)), False), REPORT.format("true"))
register(
    "macro_f1", lambda s, d: metrics.macro(report(s, d)),
    f"SELECT round(avg(f1), 5) AS macro_f1, round(sum(f1 * support) / sum(support), 5) AS weighted_f1, count(*) AS n_families FROM ({REPORT.format('pred IS NOT NULL')})",
)
register("confusion_cells", lambda s, d: metrics.cells(forward(s, d)), "SELECT * FROM cells")
register("canonical_pairs", frames.pairs, "SELECT * FROM pairs")
register("pair_labels", frames.labels, "SELECT * FROM labels_")
register("template_histogram", lambda s, d: taxonomy.template_histogram(frames.pairs(s, d)), "SELECT template, count(*) AS n_pairs FROM tmpl GROUP BY template")
register(
    "rare_subtypes", lambda s, d: taxonomy.collapse_rare(frames.labels(s, d)).select("pair_id", "family", "subtype", "subtype_original"),
    f"""SELECT pair_id, family, CASE WHEN n < {taxonomy.RARE_SUBTYPE} AND family <> 'Other' THEN 'misc_' || lower(family) ELSE subtype END AS subtype, subtype AS subtype_original
FROM (SELECT *, count(*) OVER (PARTITION BY family, subtype) AS n FROM labels_)""",
)
register("taxonomy_counts", lambda s, d: taxonomy.taxonomy_counts(frames.labels(s, d)), "SELECT family, subtype, count(*) AS n_pairs FROM labels_ GROUP BY ROLLUP (family, subtype)")
KNOWN = "family IN (" + ", ".join(f"'{f}'" for f in taxonomy.FAMILIES) + ")"
register(
    "label_integrity", lambda s, d: taxonomy.integrity(frames.labels(s, d)),
    f"""SELECT count(*) AS n_labels, count_if(NOT {KNOWN}) AS unknown_family, count_if(subtype IS NULL OR subtype = '') AS empty_subtype,
count_if({KNOWN} AND polarity IS NULL) AS missing_polarity, count_if(bidirectional AND (subject_id IS NOT NULL OR object_id IS NOT NULL)) AS sided_bidirectional,
count_if({KNOWN} AND NOT bidirectional AND (subject_id IS NULL OR object_id IS NULL)) AS sideless_directed, count_if(subject_id = object_id) AS same_side,
count_if(a_id >= b_id) AS unordered_pair FROM labels_""",
)
register("split_random", lambda s, d: splits.random_split(frames.labels(s, d)), "SELECT * FROM rs")
register("split_entity_cold", lambda s, d: splits.entity_cold_split(frames.labels(s, d), parts(s, d)), "SELECT * FROM ec")
register("split_pair_cold", lambda s, d: splits.pair_cold_split(frames.labels(s, d), parts(s, d)), "SELECT * FROM pc")
register(
    "split_safe_subset",
    lambda s, d: splits.safe_subset(frames.labels(s, d), [
        splits.random_split(frames.labels(s, d)), splits.entity_cold_split(frames.labels(s, d), parts(s, d)), splits.pair_cold_split(frames.labels(s, d), parts(s, d)),
    ], 5000),
    """SELECT pair_id, family FROM (SELECT l.pair_id, l.family, row_number() OVER (PARTITION BY l.family ORDER BY md5('split-3|' || l.pair_id), l.pair_id) AS r,
count(*) OVER (PARTITION BY l.family) AS n, count(*) OVER () AS total FROM labels_ l JOIN rs ON rs.pair_id = l.pair_id AND rs.split = 'train'
JOIN ec ON ec.pair_id = l.pair_id AND ec.split = 'train' JOIN pc ON pc.pair_id = l.pair_id AND pc.split = 'train')
WHERE r <= greatest(1, floor(5000.0::DOUBLE * n / total))""",
)
AUDIT = """SELECT p.split, n_pairs, n_entities, n_also_train FROM (SELECT split, count(*) AS n_pairs FROM {0} GROUP BY split) p JOIN (
SELECT split, count(*) AS n_entities, sum(t)::BIGINT AS n_also_train FROM (SELECT DISTINCT e.entity, e.split, (e.entity IN (SELECT unnest([a_id, b_id]) FROM labels_ l2 JOIN {0} x
ON x.pair_id = l2.pair_id AND x.split = 'train'))::INT AS t FROM (SELECT unnest([a_id, b_id]) AS entity, s.split FROM labels_ l JOIN {0} s USING (pair_id)) e) GROUP BY split) e USING (split)"""
register("audit_random", lambda s, d: splits.split_audit(frames.labels(s, d), splits.random_split(frames.labels(s, d))), AUDIT.format("rs"))
register("audit_pair_cold", lambda s, d: splits.split_audit(frames.labels(s, d), splits.pair_cold_split(frames.labels(s, d), parts(s, d))), AUDIT.format("pc"))
register(
    "family_by_split", lambda s, d: splits.random_split(frames.labels(s, d)).groupBy("split", "family").agg(F.count("*").alias("n")),
    "SELECT split, family, count(*) AS n FROM rs GROUP BY ALL",
)
register(
    "endpoint_coverage", lambda s, d: splits.endpoint_coverage(frames.labels(s, d), splits.random_split(frames.labels(s, d))),
    """SELECT l.pair_id, least(coalesce(x.d, 0), coalesce(y.d, 0)) AS cov_min, greatest(coalesce(x.d, 0), coalesce(y.d, 0)) AS cov_max, coalesce(x.d, 0) + coalesce(y.d, 0) AS cov_sum
FROM labels_ l JOIN rs ON rs.pair_id = l.pair_id AND rs.split = 'test'
LEFT JOIN (SELECT unnest([a_id, b_id]) AS e, count(*) AS d FROM labels_ JOIN rs USING (pair_id) WHERE split = 'train' GROUP BY 1) x ON x.e = a_id
LEFT JOIN (SELECT unnest([a_id, b_id]) AS e, count(*) AS d FROM labels_ JOIN rs USING (pair_id) WHERE split = 'train' GROUP BY 1) y ON y.e = b_id""",
)
register(
    "pair_jaccard", lambda s, d: similarity.pair_jaccard(frames.pairs(s, d), tokens(s, d)).drop("united"),
    """SELECT pair_id, len(list_intersect(x.t, y.t)) AS shared, round(len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))), 6) AS jaccard
FROM pairs LEFT JOIN tset x ON x.entity = a_id LEFT JOIN tset y ON y.entity = b_id""",
)
register(
    "prefix_depth", lambda s, d: similarity.prefix_depth(frames.pairs(s, d), codes(s, d)),
    f"""SELECT pair_id, coalesce(list_max(list_transform(range(1, 8), lambda k: CASE WHEN length(x.p_type) >= k AND length(y.p_type) >= k AND x.p_type[1:k] = y.p_type[1:k] THEN k ELSE 0 END)), 0) AS depth
FROM pairs LEFT JOIN part x ON {_ID.format('x.p_partkey')} = a_id LEFT JOIN part y ON {_ID.format('y.p_partkey')} = b_id""",
)
register(
    "label_triangles", lambda s, d: similarity.triangles(frames.labels(s, d)),
    """SELECT e.a_id AS x, e.b_id AS y, f.b_id AS z, CASE WHEN e.family = f.family OR e.family = g.family THEN e.family ELSE f.family END AS family,
CASE WHEN e.family = f.family AND e.family = g.family THEN 3 ELSE 2 END AS n_agree
FROM labels_ e JOIN labels_ f ON f.a_id = e.a_id AND e.b_id < f.b_id JOIN labels_ g ON g.a_id = e.b_id AND g.b_id = f.b_id
WHERE e.family <> 'Other' AND f.family <> 'Other' AND g.family <> 'Other' AND (e.family = f.family OR e.family = g.family OR f.family = g.family)""",
)
register(
    "mirror_metrics", lambda s, d: metrics.mirror_metrics(frames.scored(s, d)),
    """SELECT family, count(*) AS n, round(count_if(oa AND ob) / count(*), 6) AS both_right,
round(count_if(oa AND ob) / count(*) - count_if(oa) * count_if(ob) / (count(*) * count(*)), 6) AS lift, round(count_if(same) / count(*), 6) AS consistency,
round(CASE WHEN count_if(oa AND ob) > 0 THEN count_if(oa AND ob AND da AND db) / count_if(oa AND ob) END, 6) AS direction_given_family,
round(count_if(same AND NOT aa AND NOT ab) / count(*), 6) AS stability FROM mir GROUP BY family""",
)
register(
    "abstention_utility", lambda s, d: metrics.abstention_utility(forward(s, d)),
    f"""SELECT family, count(*) AS n, round((count_if{OK} - count_if(NOT abstain AND pred_family <> family)) / count(*), 6) AS utility,
round(count_if(NOT abstain) / count(*), 6) AS coverage, round(CASE WHEN count_if(NOT abstain) > 0 THEN count_if{OK} / count_if(NOT abstain) END, 6) AS selective_accuracy
FROM pred WHERE input_order = 'ab' GROUP BY GROUPING SETS ((), (family))""",
)
CURVE = f"""SELECT confidence, sum(n) OVER w::BIGINT AS kept, sum(r) OVER w::BIGINT AS "right", round(sum(r) OVER w / sum(n) OVER w, 6) AS accuracy
FROM (SELECT confidence, count(*) AS n, count_if{OK} AS r FROM pred WHERE input_order = 'ab' AND NOT abstain GROUP BY confidence) WINDOW w AS (ORDER BY confidence DESC)"""
CURVE = CURVE.replace("sum(n) OVER w::BIGINT", "CAST(sum(n) OVER w AS BIGINT)").replace("sum(r) OVER w::BIGINT", "CAST(sum(r) OVER w AS BIGINT)")
register("risk_coverage", lambda s, d: metrics.risk_coverage(forward(s, d)), CURVE)
register(
    "coverage_threshold", lambda s, d: metrics.coverage_threshold(metrics.risk_coverage(forward(s, d)), 0.9),
    f"SELECT arg_max(confidence, kept) AS threshold, max(kept) AS kept FROM ({CURVE}) WHERE accuracy >= 0.9",
)
register(
    "reliability_bins", lambda s, d: metrics.reliability(forward(s, d)),
    """SELECT bin, n, accuracy, round(abs(accuracy - (bin + 0.5::DOUBLE) / 10), 6) AS gap FROM (SELECT floor(confidence * 10)::INT AS bin, count(*) AS n,
round(avg((pred_family = family)::INT::DOUBLE), 6) AS accuracy FROM pred WHERE input_order = 'ab' AND NOT abstain AND confidence < 1 GROUP BY 1)""",
)
register(
    "confidence_auroc", lambda s, d: metrics.auroc(forward(s, d)),
    """SELECT round((sum(rank * p) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(n - p)), 6) AS auroc FROM (SELECT n, p,
coalesce(sum(n) OVER (ORDER BY confidence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank
FROM (SELECT confidence, count(*) AS n, count_if(pred_family = family) AS p FROM pred WHERE input_order = 'ab' GROUP BY confidence))""",
)
register(
    "gated_score", lambda s, d: metrics.gated_score(forward(s, d)),
    f"""SELECT family, count(*) AS n, round(avg(CASE WHEN NOT {OK} THEN 0.0::DOUBLE WHEN pred_subtype <> subtype THEN 0.3::DOUBLE
WHEN pred_direction <> direction THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END), 6) AS score FROM pred WHERE input_order = 'ab' GROUP BY family""",
)
register(
    "additive_score", lambda s, d: metrics.additive_score(forward(s, d)),
    """SELECT family, round(avg(CASE WHEN abstain THEN 0.0::DOUBLE ELSE (CASE WHEN pred_family = family THEN 0.4::DOUBLE ELSE 0 END) + (CASE WHEN pred_subtype = subtype THEN 0.3::DOUBLE ELSE 0 END)
+ (CASE WHEN (CASE WHEN pred_direction IN ('a_to_b', 'b_to_a') THEN 'directed' ELSE pred_direction END) = (CASE WHEN direction IN ('a_to_b', 'b_to_a') THEN 'directed' ELSE direction END)
THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN pred_polarity = polarity THEN 0.15::DOUBLE ELSE 0 END) END), 6) AS score
FROM pred WHERE input_order = 'ab' GROUP BY family""",
)
register(
    "bias_ratio", lambda s, d: metrics.bias_ratio(forward(s, d)),
    """SELECT g.family, n_true, coalesce(n_pred, 0) AS n_pred, round(coalesce(n_pred, 0) / n_true, 6) AS bias FROM (SELECT family, count(*) AS n_true FROM pred WHERE input_order = 'ab' GROUP BY family) g
LEFT JOIN (SELECT pred_family AS family, count(*) AS n_pred FROM pred WHERE input_order = 'ab' AND NOT abstain GROUP BY 1) p ON p.family = g.family""",
)
register(
    "class_weights", lambda s, d: metrics.class_weights(frames.labels(s, d)),
    """SELECT family, n, round((1 / sqrt(n)) / (sum(sqrt(n)) OVER () / sum(n) OVER ()), 6) AS weight FROM (SELECT family, count(*) AS n FROM labels_ GROUP BY family)""",
)
register(
    "abstention_rate", lambda s, d: forward(s, d).groupBy("family").agg(F.round(F.avg(F.col("abstain").cast("double")), 6).alias("rate")),
    "SELECT family, round(avg(abstain::INT::DOUBLE), 6) AS rate FROM pred WHERE input_order = 'ab' GROUP BY family",
)
BEST = "SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY passed DESC, score DESC, candidate_id)::INT AS rank FROM cand"
register("best_candidate", lambda s, d: curation.best_of(frames.candidates(s, d)), f"SELECT * FROM ({BEST}) WHERE rank = 1")
register("prune_candidates", lambda s, d: curation.best_of(frames.candidates(s, d), 3), f"SELECT * FROM ({BEST}) WHERE rank <= 3")
register(
    "candidate_votes", lambda s, d: curation.vote(frames.candidates(s, d)),
    """SELECT pair_id, arg_max(cand_family, (votes, -first)) AS majority, arg_max(cand_family, (weight, -first)) AS weighted, max(votes) AS top_votes, sum(votes)::BIGINT AS n_votes,
round(max(votes) / sum(votes), 6) AS share FROM (SELECT pair_id, cand_family, count(*) AS votes, round(sum(score), 6) AS weight, min(candidate_id) AS first FROM cand GROUP BY ALL) GROUP BY pair_id""",
)
register(
    "consensus_weight", lambda s, d: curation.consensus_weight(frames.candidates(s, d, ("family",))),
    """SELECT pair_id, n_votes, k_family, round(least(2.5::DOUBLE, CASE WHEN n_votes >= 2 AND k_family <= 1 THEN raw * 0.5::DOUBLE ELSE raw END), 4) AS weight FROM (
SELECT pair_id, count(*) AS n_votes, count_if(cand_family = family) AS k_family, greatest(0.0::DOUBLE, 1 + 0.5::DOUBLE * (count_if(cand_family = family) - 1)) AS raw
FROM cand JOIN labels_ USING (pair_id) GROUP BY pair_id)""",
)
register(
    "complete_pairs", lambda s, d: curation.complete_pairs(frames.candidate_numbers(s, d), frames.N_CANDIDATES),
    f"SELECT pair_id, count(DISTINCT candidate_id) AS n, count(DISTINCT candidate_id) >= {frames.N_CANDIDATES} AS done FROM cand GROUP BY pair_id",
)
LEVELS = """SELECT family, confidence, sum(n) OVER w AS kept, sum(r) OVER w AS hit, sum(n) OVER (PARTITION BY family) AS total FROM (
SELECT family, confidence, count(*) AS n, count_if(pred_family = family) AS r FROM pred WHERE input_order = 'ab' AND NOT abstain GROUP BY ALL)
WINDOW w AS (PARTITION BY family ORDER BY confidence DESC)"""
register(
    "family_coverage", lambda s, d: selective.at_coverage(forward(s, d)),
    f"""SELECT family, coverage, arg_max(confidence, confidence) AS threshold, arg_max(kept, confidence)::BIGINT AS kept, round(arg_max(hit / kept, confidence), 6) AS accuracy
FROM ({LEVELS}) l, (SELECT unnest([0.5::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE]) AS coverage) c WHERE kept >= coverage * total GROUP BY ALL""",
)
register(
    "family_thresholds", lambda s, d: selective.family_thresholds(forward(s, d)),
    f"""SELECT family, coalesce(low, high) AS threshold, low IS NOT NULL AS met FROM (SELECT family,
min(CASE WHEN hit >= 0.7::DOUBLE * kept AND kept >= 0.3::DOUBLE * total THEN confidence END) AS low,
max(CASE WHEN kept >= 0.3::DOUBLE * total THEN confidence END) AS high FROM ({LEVELS}) GROUP BY family)""",
)
register(
    "area_under_risk", lambda s, d: selective.area_under_risk(forward(s, d)),
    f"""SELECT family, round(sum((x - coalesce(px, 0)) * (y + coalesce(py, 0)) / 2), 6) AS aurc FROM (
SELECT family, x, y, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (SELECT family, confidence, kept / total AS x, 1 - hit / kept AS y FROM ({LEVELS}))
WINDOW w AS (PARTITION BY family ORDER BY confidence DESC)) GROUP BY family""",
)
register(
    "rescue_list", lambda s, d: selective.rescue_list(forward(s, d), 0.5, 200),
    "SELECT pair_id, family, pred_family, confidence FROM pred WHERE input_order = 'ab' AND confidence < 0.5 ORDER BY confidence, pair_id LIMIT 200",
)
register(
    "vote_entropy", lambda s, d: agreement.vote_entropy(frames.candidates(s, d)),
    """SELECT pair_id, sum(n)::BIGINT AS n_votes, count(*) AS n_families, abs(round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6)) AS entropy
FROM (SELECT pair_id, cand_family, count(*) AS n FROM cand GROUP BY ALL) GROUP BY pair_id""",
)
register(
    "candidate_tiers", lambda s, d: agreement.tiers(frames.candidates(s, d, ("family",))),
    """SELECT family, CASE WHEN NOT passed THEN 'drop' WHEN cand_family = family AND score >= 0.3::DOUBLE THEN 'full_correct' WHEN cand_family = family THEN 'family_correct'
ELSE 'near_miss' END AS tier, count(*) AS n, round(avg(score), 6) AS mean_score FROM cand JOIN labels_ USING (pair_id) GROUP BY ALL""",
)
register(
    "order_mcnemar", lambda s, d: agreement.mcnemar(frames.scored(s, d)),
    """SELECT *, round(CASE WHEN only_ab + only_ba > 0 THEN power(greatest(abs(only_ab - only_ba) - 1, 0), 2) / (only_ab + only_ba) END, 6) AS statistic FROM (
SELECT family, count_if(oa AND ob)::BIGINT AS both, count_if(oa AND NOT ob)::BIGINT AS only_ab, count_if(ob AND NOT oa)::BIGINT AS only_ba, count_if(NOT oa AND NOT ob)::BIGINT AS neither FROM mir GROUP BY family)""",
)
register(
    "bootstrap_accuracy", lambda s, d: agreement.bootstrap_accuracy(forward(s, d)),
    f"""SELECT family, round, sum(w)::BIGINT AS n, round(sum(CASE WHEN {OK} THEN w ELSE 0 END) / sum(w), 6) AS accuracy FROM (
SELECT *, CASE WHEN u < 6171934 THEN 0 WHEN u < 12343867 THEN 1 WHEN u < 15429833 THEN 2 WHEN u < 16458488 THEN 3 ELSE 4 END AS w FROM (
SELECT p.*, r.round::INT AS round, ('0x' || substr(md5(pair_id || '|' || r.round), 1, 6))::BIGINT AS u FROM pred p, range(20) r(round) WHERE input_order = 'ab')) GROUP BY family, round""",
)
register(
    "top_subtypes", lambda s, d: agreement.top_subtypes(frames.labels(s, d), 5),
    """SELECT family, subtype, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, subtype)::INT AS rank
FROM (SELECT family, subtype, count(*) AS n FROM labels_ GROUP BY ALL)) WHERE rank <= 5""",
)
register(
    "hedging_density",
    lambda s, d: frames.table(s, d, "documents").select(
        "doc_id", text.hedge_count(F.col("text")).alias("hedges"), text.word_count(F.col("text")).alias("n_words"), text.first_percentage(F.col("text")).alias("percentage"),
    ),
    r"""SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '\b(%s)\b'))::INT AS hedges, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::INT AS n_words,
TRY_CAST(nullif(regexp_extract(text, '([0-9]+(\.[0-9]+)?) ?%%', 1), '') AS DOUBLE) AS percentage FROM documents""" % "|".join(text.HEDGES),
)
register("ingest_events", lambda s, d: ingest.ingest(s, f"{d}/events.parquet", "event_id", "ts"), "SELECT DISTINCT * FROM events")
register(
    "complete_events", lambda s, d: complete.complete_table(s, f"{d}/events.parquet", "user_id", "event_id", "ts", 70),
    "SELECT DISTINCT e.* FROM events e JOIN (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_id) >= 70) USING (user_id)",
)
