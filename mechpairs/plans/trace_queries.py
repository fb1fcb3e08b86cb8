"""Queries over reasoning steps, probes, abstention and candidate choice, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations
from ..operators.taxonomy import FAMILIES
from ..operators import curation, distributions, metrics, selective, splits, traces, voting
from . import frames
from . import trace_frames as tf
from .registry import register
from .sql import _quote

STRICT = """SELECT gold, support, 2 * tp / (support + predicted) AS f1 FROM (SELECT gold, sum(n)::BIGINT AS support, sum(CASE WHEN gold = pred THEN n ELSE 0 END)::BIGINT AS tp,
coalesce((SELECT sum(n) FROM {0} c WHERE c.pred = g.gold), 0)::BIGINT AS predicted FROM {0} g GROUP BY gold)"""
MFS = """SELECT pair_id, family, count_if(counted)::BIGINT AS n_counted, coalesce(avg(CASE WHEN counted THEN {0} END), 0.0::DOUBLE) AS score FROM cited GROUP BY ALL"""
HIT, PART = "(hit > 0)::INT::DOUBLE", "(CASE WHEN len(evidence) > 0 THEN hit / len(evidence) ELSE 0.0::DOUBLE END)"
LEVELS = """WITH t AS ({0}), e AS (SELECT family, count(*) AS n, avg({1}) AS m FROM t GROUP BY family)
SELECT family, n, round(m, 6) AS score, 'family' AS level FROM e UNION ALL SELECT NULL, sum(n)::BIGINT, round(avg(m), 6), 'macro' FROM e
UNION ALL SELECT NULL, sum(n)::BIGINT, round(sum(m * n) / sum(n), 6), 'weighted' FROM e"""


def nested(sql: str) -> str:
    """A query of its own common tables as one that may follow others."""
    return f"SELECT * FROM ({sql})"


register("trace_faithfulness", lambda s, d: traces.by_family(traces.faithfulness(tf.steps(s, d))), nested(LEVELS.format(MFS.format(HIT), "score")))
register("trace_faithfulness_share", lambda s, d: traces.by_family(traces.faithfulness(tf.steps(s, d), True)), nested(LEVELS.format(MFS.format(PART), "score")))
register(
    "trace_degenerate", lambda s, d: traces.faithfulness(tf.steps(s, d)).groupBy("n_counted").agg(F.count("*").alias("n")),
    f"SELECT n_counted, count(*) AS n FROM ({MFS.format(HIT)}) GROUP BY 1",
)
register(
    "citation_forms",
    lambda s, d: tf.steps(s, d).select(F.explode("evidence").alias("cited")).groupBy("cited").agg(F.count("*").alias("n")).select(
        "cited", "n", citations.normalized(F.col("cited")).alias("canonical"), citations.metric_name(F.col("cited")).alias("bare")),
    """SELECT cited, count(*) AS n, CASE cited WHEN 'CYP3A4_substrate' THEN 'cyp3a4_sub' ELSE lower(cited) END AS canonical, regexp_replace(cited, ' = .*', '') AS bare
FROM (SELECT unnest(evidence) AS cited FROM steps_) GROUP BY cited""",
)
CUE_SQL = "\nUNION ALL ".join(
    f"SELECT pair_id, step_id, {k} AS k, '{f}' AS f FROM s WHERE regexp_matches(claim, {_quote('|'.join(f'(?:{c})' for c in cues).replace('(?!ic effect)', ''))})"
    for k, (f, cues) in enumerate(traces.CUES.items())
)
IMPLIED = f"""WITH s AS (SELECT pair_id, step_id, lower(claim) AS claim FROM steps_ WHERE role NOT IN ('conclusion', 'abstention', 'evidence_gap')),
h AS ({CUE_SQL}), b AS (SELECT pair_id, arg_max(f, (n, -s0, -k0)) AS implied FROM (SELECT pair_id, f, count(*) AS n, min(step_id) AS s0, arg_min(k, (step_id, k)) AS k0 FROM h GROUP BY ALL) GROUP BY pair_id),
g AS (SELECT pair_id, bool_or(role IN ('abstention', 'evidence_gap')) AS gap FROM steps_ GROUP BY pair_id) SELECT g.pair_id, gap, implied FROM g LEFT JOIN b USING (pair_id)"""


def traced(s, d):
    return tf.with_steps(s, d, steps=lambda k, x: F.struct(tf.role(F.lit(k), x).alias("role"), tf.claim(x).alias("claim")))


register("trace_implied_family", lambda s, d: traces.implied_family(traced(s, d).select("pair_id", "steps")), nested(IMPLIED))
register(
    "trace_coherence", lambda s, d: traces.coherence(traces.implied_family(traced(s, d))),
    f"""SELECT family, count(*) AS n, round(avg((CASE WHEN abstain THEN gap ELSE coalesce(implied = pred_family, false) END)::INT::DOUBLE), 6) AS coherent,
round(avg((NOT abstain AND implied IS NULL)::INT::DOUBLE), 6) AS indeterminate FROM (SELECT * FROM pred WHERE input_order = 'ab') JOIN ({IMPLIED}) USING (pair_id) GROUP BY family""",
)
SCORES = """SELECT pair_id, family, round(avg(score), 6) AS mean, round(l[1], 6) AS least, round(l[1] + 0.1::DOUBLE * coalesce(l[2], l[1]), 6) AS min_plus, round(exp(avg(ln(greatest(score, 1e-9::DOUBLE)))), 6) AS geomean,
round(arg_max(score, step_id), 6) AS final FROM (SELECT *, list_sort(list(score) OVER (PARTITION BY pair_id)) AS l FROM steps_ {0}) GROUP BY pair_id, family, l"""
register("trace_step_scores", lambda s, d: traces.step_scores(tf.steps(s, d)), SCORES.format(""))
register("trace_step_scores_no_meta", lambda s, d: traces.step_scores(tf.steps(s, d), True), SCORES.format("WHERE role NOT IN ('conclusion', 'abstention', 'evidence_gap')"))
register("trace_step_score_levels", lambda s, d: traces.by_family(traces.step_scores(tf.steps(s, d)), "mean"), nested(LEVELS.format(SCORES.format(""), "mean")))
MENTIONS = " || ".join(f"regexp_extract_all(claim, {_quote(p)})" for p in traces.ENTITIES)
UNKNOWN = f"SELECT pair_id, family, claim, m, m IS NOT NULL AND upper(m) NOT IN ({', '.join(_quote(k.upper()) for k in tf.KNOWN)}) AS fresh FROM (SELECT *, unnest(CASE WHEN len(x) > 0 THEN x ELSE [NULL] END) AS m FROM (SELECT *, {MENTIONS} AS x FROM steps_))"
register(
    "trace_hallucination", lambda s, d: traces.hallucination(tf.steps(s, d), tf.known_entities(s)),
    f"SELECT pair_id, family, count(m) AS n_mentions, count_if(fresh)::BIGINT AS n_unknown, round(CASE WHEN count(m) > 0 THEN count_if(fresh) / count(m) ELSE 0 END, 6) AS rate FROM ({UNKNOWN}) GROUP BY pair_id, family",
)
register("trace_unknown_entities", lambda s, d: traces.top_unknown(tf.steps(s, d), tf.known_entities(s)), f"SELECT m, count(*) AS n FROM ({UNKNOWN}) WHERE fresh GROUP BY m ORDER BY n DESC, m LIMIT 20")
register("trace_hint_majority", lambda s, d: traces.hint_majority(tf.steps(s, d)).drop("counts"), "SELECT * FROM hints")
RESCUE = """SELECT pair_id, family, pred_family, CASE WHEN go THEN winner END AS rescue, CASE WHEN go THEN winner ELSE pred_family END AS final FROM (SELECT p.*, h.winner,
coalesce(n_hints >= 3 AND winner <> pred_family AND n_winner >= 0.5 * n_hints AND coalesce(own, 0) < n_winner AND coalesce(own, 0) <= {0} * n_hints AND confidence <= {1}, false) AS go FROM (SELECT * FROM pred WHERE input_order = 'ab') p LEFT JOIN hints h USING (pair_id)
LEFT JOIN (SELECT pair_id, count(*) AS own FROM steps_ WHERE role <> 'conclusion' AND hint = pred_family GROUP BY pair_id) USING (pair_id))"""


def hinted(s, d):
    return tf.with_steps(s, d, hints=lambda k, x: F.when(F.lit(k != tf.N_STEPS), tf.hint(F.lit(k), x)))


register("trace_rescue", lambda s, d: traces.rescued(hinted(s, d), None), RESCUE.format(1.0, 1.0))
register("trace_rescue_uncertain", lambda s, d: traces.rescued(hinted(s, d), None, max_share=0.1, max_confidence=0.6), RESCUE.format(0.1, 0.6))
register(
    "reasoning_audit", lambda s, d: traces.reasoning_audit(tf.forward(s, d), tf.steps(s, d)),
    """SELECT family, count(*) AS n, count_if(apart)::BIGINT AS disagree, count_if(apart AND winner = family)::BIGINT AS mended, count_if(apart AND pred_family = family)::BIGINT AS spoiled,
(count_if(apart AND winner = family) - count_if(apart AND pred_family = family))::BIGINT AS net FROM (SELECT p.*, winner, winner IS NOT NULL AND winner <> pred_family AS apart FROM pred p LEFT JOIN (
SELECT pair_id, arg_max(hint, (n, -first)) AS winner FROM (SELECT pair_id, hint, count(*) AS n, min(step_id) AS first FROM steps_ GROUP BY ALL) GROUP BY pair_id) USING (pair_id)
WHERE input_order = 'ab' AND NOT abstain) GROUP BY family""",
)
register("trace_errors", lambda s, d: traces.trace_errors(tf.steps(s, d)), "SELECT DISTINCT pair_id, '' AS errors FROM steps_")
register("trace_banned", lambda s, d: traces.banned_phrases(tf.steps(s, d)), "SELECT DISTINCT pair_id, false AS banned FROM steps_")
register(
    "step_labels", lambda s, d: traces.step_labels(tf.steps(s, d)),
    "SELECT pair_id, step_id, (len(evidence) > 0 AND hit = len(evidence) AND hint = family)::INT AS label FROM cited",
)
register(
    "step_text", lambda s, d: traces.step_text(tf.steps(s, d)),
    "SELECT pair_id, string_agg('Step ' || step_id || ' [' || role || '] ' || claim, chr(10) ORDER BY step_id) AS text FROM steps_ GROUP BY pair_id",
)
register(
    "step_counts", lambda s, d: traces.step_counts(tf.steps(s, d)),
    "SELECT n_steps, ok, count(*) AS n FROM (SELECT pair_id, count_if(counted)::BIGINT AS n_steps, bool_or(NOT abstain AND pred_family = family) AS ok FROM cited GROUP BY pair_id) GROUP BY ALL",
)
register(
    "step_holdout", lambda s, d: traces.holdout(tf.steps(s, d)),
    "SELECT pair_id, step_id, CASE WHEN ('0x' || substr(md5('prm-1|' || pair_id), 1, 8))::BIGINT / 4294967296.0 < 0.05 THEN 'val' ELSE 'train' END AS part FROM steps_",
)
register(
    "subtype_match", lambda s, d: tf.forward(s, d).groupBy("subtype", "pred_subtype").agg(F.count("*").alias("n")).select("subtype", "pred_subtype", "n", traces.keyword_overlap(F.col("subtype"), F.col("pred_subtype")).alias("same")),
    "SELECT subtype, pred_subtype, count(*) AS n, subtype = pred_subtype AS same FROM pred WHERE input_order = 'ab' GROUP BY ALL",
)
# Probes.
FLIPS = """SELECT 'flag_' || (('0x' || substr(x, 2, 1))::BIGINT % 3) AS perturbation, ('0x' || substr(x, 1, 1))::BIGINT < 8 AS relevant, confidence AS c,
CASE WHEN ('0x' || substr(x, 1, 1))::BIGINT < 8 THEN confidence * 0.5::DOUBLE ELSE confidence * 0.98::DOUBLE END AS c2 FROM (SELECT *, md5(pair_id || '|f1') AS x FROM pred WHERE input_order = 'ab')"""
DIV = f"""SELECT perturbation, relevant, p1 * ln(p1 / q1) + p2 * ln(p2 / q2) AS d FROM (SELECT *, (c + 1e-9::DOUBLE) / s AS p1, (1 - c + 1e-9::DOUBLE) / s AS p2, (c2 + 1e-9::DOUBLE) / s AS q1, (1 - c2 + 1e-9::DOUBLE) / s AS q2
FROM (SELECT *, 1 + 2e-9::DOUBLE AS s FROM ({FLIPS})))"""
register(
    "counterfactual_sensitivity", lambda s, d: distributions.sensitivity(tf.flips(s, d)),
    f"""SELECT perturbation, count_if(relevant)::BIGINT AS n_relevant, count_if(NOT relevant)::BIGINT AS n_null, round(coalesce(avg(d) FILTER (relevant), 0), 5) AS on_relevant,
round(coalesce(avg(d) FILTER (NOT relevant), 0), 5) AS on_null, round(coalesce(avg(d) FILTER (relevant), 0) - coalesce(avg(d) FILTER (NOT relevant), 0), 5) AS gap FROM ({DIV}) GROUP BY GROUPING SETS ((), (perturbation))""",
)
PROBE = "('0x' || substr(x, {0}, 1))::BIGINT < {1}"
register(
    "evidence_intervention", lambda s, d: distributions.intervention(tf.evidence_probes(s, d)),
    f"""SELECT family, n, round(t / n, 6) AS acc_true, round(a / n, 6) AS acc_adv, round(CASE WHEN b > 0 THEN z / b END, 6) AS acc_none, round(t / n - a / n, 6) AS drop, a / n >= CASE WHEN b > 0 THEN z / b END AS robust FROM (
SELECT family, count(*) AS n, count_if({PROBE.format(1, 12)}) AS t, count_if({PROBE.format(2, 8)}) AS a, count_if({PROBE.format(4, 14)}) AS b, count_if({PROBE.format(4, 14)} AND {PROBE.format(3, 10)}) AS z
FROM (SELECT family, md5(pair_id || '|r1') AS x FROM pred WHERE input_order = 'ab') GROUP BY GROUPING SETS ((), (family)))""",
)
register("label_entropy", lambda s, d: tf.gated_inputs(s, d).select("pair_id", "entropy"), "SELECT pair_id, entropy FROM ginp")
# Headline metrics.
register("headline_f1", lambda s, d: metrics.headline(tf.forward(s, d), 2000), f"""SELECT round(avg(f1), 5) AS macro_f1, round(sum(f1 * support) / sum(support), 5) AS weighted_f1,
round(avg(CASE WHEN support < 2000 THEN f1 END), 5) AS rare_macro_f1 FROM ({STRICT.format('cells')})""".replace("2 * tp / (support + predicted) AS f1", "round(2 * tp / (support + predicted), 6) AS f1"))
SUBCELLS = "(SELECT subtype AS gold, CASE WHEN NOT abstain THEN pred_subtype END AS pred, count(*) AS n FROM pred WHERE input_order = 'ab' GROUP BY ALL)"
register(
    "subtype_report", lambda s, d: metrics.subtype_report(tf.forward(s, d)),
    f"""SELECT * FROM (SELECT round(count_if(ok) / count(*), 6) AS accuracy, round(count_if(ok AND fam) / count_if(fam), 6) AS accuracy_given_family FROM (
SELECT NOT abstain AND pred_subtype = subtype AS ok, NOT abstain AND pred_family = family AS fam FROM pred WHERE input_order = 'ab')),
(SELECT round(avg(f1), 5) AS macro_f1, round(sum(f1 * support) / sum(support), 5) AS weighted_f1 FROM ({STRICT.format(SUBCELLS).replace('2 * tp / (support + predicted) AS f1', 'round(2 * tp / (support + predicted), 6) AS f1')}))""",
)
register("confusion_shares", lambda s, d: metrics.confusion_shares(metrics.cells(tf.forward(s, d))), "SELECT *, round(n / sum(n) OVER (PARTITION BY gold), 6) AS share FROM cells")
SIDES = "FROM (SELECT a.family, a.pred_family = a.family AS x, b.pred_family = b.family AS y, a.pred_family = b.pred_family AS same, a.pred_direction = a.direction AND b.pred_direction = b.direction AS turn, CASE WHEN a.direction = 'bidirectional' THEN 'bidirectional' ELSE 'directed' END AS kind FROM pred a JOIN pred b ON a.pair_id = b.pair_id AND a.input_order = 'ab' AND b.input_order = 'ba')"
register(
    "symmetry", lambda s, d: metrics.symmetry(frames.scored(s, d)),
    f"""SELECT count(*) AS n, round(count_if(x AND y) / count(*), 6) AS csa, round(count_if(x) / count(*), 6) AS acc_ab, round(count_if(y) / count(*), 6) AS acc_ba, round(count_if(x) * count_if(y) / (count(*) * count(*)), 6) AS product,
round(count_if(x AND y) / count(*) - count_if(x) * count_if(y) / (count(*) * count(*)), 6) AS lift, round(count_if(same) / count(*), 6) AS consistency {SIDES}""",
)
register(
    "direction_symmetry", lambda s, d: metrics.direction_symmetry(frames.scored(s, d)),
    f"SELECT kind, count(*) AS n, round(coalesce(CASE WHEN count_if(x AND y) > 0 THEN count_if(x AND y AND turn) / count_if(x AND y) END, -1.0::DOUBLE), 6) AS given_family, round(count_if(turn) / count(*), 6) AS unconditional {SIDES} GROUP BY GROUPING SETS ((), (kind))",
)
LEVEL = "CASE WHEN abstain OR pred_family <> family THEN 0.0::DOUBLE WHEN pred_subtype <> subtype THEN 0.3::DOUBLE WHEN pred_direction <> direction THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END"
register(
    "gated_levels", lambda s, d: metrics.gated_levels(tf.forward(s, d)),
    f"""SELECT round(avg(s / n), 5) AS macro, round(sum(s) / sum(n), 5) AS weighted, round(avg(k / n), 5) AS family_only, round(sum(l0) / sum(n), 6) AS share_0, round(sum(l1) / sum(n), 6) AS share_1, round(sum(l2) / sum(n), 6) AS share_2, round(sum(l3) / sum(n), 6) AS share_3
FROM (SELECT family, count(*) AS n, sum(l) AS s, count_if(NOT abstain AND pred_family = family) AS k, count_if(l = 0.0) AS l0, count_if(l = 0.3::DOUBLE) AS l1, count_if(l = 0.7::DOUBLE) AS l2, count_if(l = 1.0) AS l3 FROM (SELECT *, {LEVEL} AS l FROM pred WHERE input_order = 'ab') GROUP BY family)""",
)
register(
    "expected_calibration", lambda s, d: metrics.ece(tf.forward(s, d)),
    "SELECT sum(n)::BIGINT AS n, round(sum(n * abs(acc - (bin + 0.5::DOUBLE) / 10)) / sum(n), 6) AS ece FROM (SELECT CASE WHEN confidence < 1 THEN floor(confidence * 10)::INT END AS bin, count(*) AS n, avg((pred_family = family)::INT::DOUBLE) AS acc FROM pred WHERE input_order = 'ab' GROUP BY 1)",
)
RECON = "SELECT a.pair_id, a.family, CASE WHEN a.pred_family = b.pred_family OR a.confidence >= b.confidence THEN a.pred_family ELSE b.pred_family END AS pred_family, a.pred_family <> b.pred_family AS conflict FROM pred a JOIN pred b ON a.pair_id = b.pair_id AND a.input_order = 'ab' AND b.input_order = 'ba'"
register("mirror_reconciled", lambda s, d: metrics.reconciled(frames.scored(s, d)), RECON)


def three_models(s, d):
    rows = frames.scored(s, d)
    votes = curation.vote(frames.candidates(s, d)).select("pair_id", F.col("majority").alias("pred_family"), F.lit(0).alias("ord"))
    by = {o: rows.where(F.col("input_order") == o).select("pair_id", "pred_family", F.lit(0).alias("ord")) for o in ("ab", "ba")}
    return metrics.common_support(frames.labels(s, d).where("family <> 'Other'"), by | {"votes": votes})


VOTES = "SELECT pair_id, arg_max(cand_family, (votes, -first)) AS votes FROM (SELECT pair_id, cand_family, count(*) AS votes, min(candidate_id) AS first FROM cand GROUP BY ALL) GROUP BY pair_id"
SUPPORT = f"SELECT a.pair_id, a.family, a.pred_family AS ab, b.pred_family AS ba, votes FROM pred a JOIN pred b ON a.pair_id = b.pair_id AND a.input_order = 'ab' AND b.input_order = 'ba' JOIN ({VOTES}) v ON v.pair_id = a.pair_id"
register("common_support", three_models, SUPPORT)
register(
    "error_overlap", lambda s, d: metrics.error_overlap(three_models(s, d), ["ab", "ba", "votes"]),
    f"""SELECT 'errors' AS kind, concat_ws('+', CASE WHEN ab <> family THEN 'ab' END, CASE WHEN ba <> family THEN 'ba' END, CASE WHEN votes <> family THEN 'votes' END) AS key, count(*)::DOUBLE AS value FROM ({SUPPORT}) GROUP BY 2
UNION ALL SELECT 'agreement', unnest(['ab=ba', 'ab=votes', 'ba=votes']), unnest([round(avg((ab = ba)::INT::DOUBLE), 6), round(avg((ab = votes)::INT::DOUBLE), 6), round(avg((ba = votes)::INT::DOUBLE), 6)]) FROM ({SUPPORT})""",
)
register(
    "pair_set_difference", lambda s, d: metrics.same_pairs(splits.random_split(frames.labels(s, d)), splits.pair_cold_split(frames.labels(s, d), splits.entity_parts(frames.labels(s, d)))),
    "SELECT pair_id, 'missing' AS side FROM rs ANTI JOIN pc USING (pair_id) UNION ALL SELECT pair_id, 'extra' FROM pc ANTI JOIN rs USING (pair_id)",
)
CURVE = "SELECT confidence, CAST(sum(n) OVER w AS BIGINT) AS kept, CAST(sum(r) OVER w AS BIGINT) AS hit FROM (SELECT confidence, count(*) AS n, count_if(NOT abstain AND pred_family = family) AS r FROM pred WHERE input_order = 'ab' AND NOT abstain GROUP BY confidence) WINDOW w AS (ORDER BY confidence DESC)"
register(
    "utility_at_coverage", lambda s, d: metrics.utility_at(metrics.risk_coverage(tf.forward(s, d)), None),
    f"""SELECT coverage, round(arg_min(u, kept), 6) AS utility FROM (SELECT kept, m, (hit - (kept - hit)) / m AS u FROM ({CURVE}), (SELECT max(kept) AS m FROM ({CURVE}))), (SELECT unnest([0.5::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE]) AS coverage) WHERE kept >= coverage * m GROUP BY coverage
UNION ALL SELECT NULL, round(max((hit - (kept - hit)) / m), 6) FROM ({CURVE}), (SELECT max(kept) AS m FROM ({CURVE}))""",
)
register("full_report", lambda s, d: metrics.full_report(frames.scored(s, d)))
# Abstention.
PCTS = (0.50, 0.60, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)
LOWS = tuple(k / 20 for k in range(1, 15))
WHOLE = "(SELECT count(*) AS n, avg(ok::INT::DOUBLE) AS base FROM ginp{0})"


def threshold_sql(score: str, shares, high: bool, where: str) -> str:
    t = f"CASE WHEN nxt IS NULL THEN v + 1e-6::DOUBLE ELSE (v + nxt) / 2 END" if high else "v"
    keep = f"g.{score} >= t" if high else f"g.{score} <= t"
    return f"""SELECT any_value(t) AS threshold, round(arg_max(kept / n, (gain, -p)), 6) AS coverage, round(arg_max(sel, (gain, -p)), 6) AS accuracy, round(any_value(base), 6) AS baseline FROM (
SELECT p, first_value(t) OVER (ORDER BY gain DESC, p) AS t, kept, n, sel, base, gain FROM (SELECT p, t, n, base, kept, hit / kept AS sel, hit / kept - base AS gain FROM (SELECT q.p, q.t, q.n, q.base, count(*) AS kept, count_if(g.ok) AS hit FROM (
SELECT p, n, base, {t} AS t FROM (SELECT p, n, base, v, (SELECT min({score}) FROM ginp WHERE {score} > v) AS nxt FROM (SELECT p, n, base, l[greatest(0, least(n - 1, floor(p * n)))::BIGINT + 1] AS v
FROM (SELECT list_sort(list({score})) AS l, count(*) AS n, avg(ok::INT::DOUBLE) AS base FROM ginp{where}), (SELECT unnest({list(shares)}::DOUBLE[]) AS p)))) q JOIN ginp g ON {keep} GROUP BY ALL) WHERE 1.0 - kept / n <= 0.1))"""


register("entropy_threshold", lambda s, d: selective.quantile_thresholds(tf.gated_inputs(s, d), "entropy", "ok", PCTS, False), threshold_sql("entropy", PCTS, False, ""))
register("score_threshold", lambda s, d: selective.quantile_thresholds(tf.gated_inputs(s, d), "prm", "ok", LOWS, True), threshold_sql("prm", LOWS, True, " WHERE prm IS NOT NULL"))
CAL = """WITH s AS (SELECT {g} AS g, confidence AS c, count(*) AS n, count_if(pred_family = family) AS r FROM pred WHERE input_order = 'ab' GROUP BY ALL),
l AS (SELECT g, c, sum(n) OVER w AS kept, sum(r) OVER w AS hit, sum(n) OVER (PARTITION BY g) AS total FROM s WINDOW w AS (PARTITION BY g ORDER BY c DESC)),
f AS (SELECT *, hit >= 0.75::DOUBLE * kept AS ok, kept >= 0.5::DOUBLE * total AS wide FROM l), a AS (SELECT *, max(CASE WHEN ok AND wide THEN c END) OVER (PARTITION BY g) AS start FROM f),
b AS (SELECT *, max(CASE WHEN wide AND NOT ok AND c < start THEN c END) OVER (PARTITION BY g) AS stop FROM a),
k AS (SELECT g, min(CASE WHEN ok AND wide AND {run} THEN c END) AS normal, min(CASE WHEN ok AND kept >= 10 THEN c END) AS relaxed, max(CASE WHEN kept >= total - floor(total / 2) THEN c END) AS med FROM b GROUP BY g)"""
CAL_F = nested(CAL.format(g="pred_family", run="coalesce(c > stop, true)") + " SELECT g AS family, coalesce(normal, relaxed, med) AS tau, CASE WHEN normal IS NOT NULL THEN 'none' WHEN relaxed IS NOT NULL THEN 'relaxed_coverage' ELSE 'median_unreachable' END AS fallback FROM k")
CAL_ALL = nested(CAL.format(g="'all'", run="true") + " SELECT NULL::VARCHAR AS family, coalesce(normal, med) AS tau, CASE WHEN normal IS NOT NULL THEN 'none' ELSE 'median_unreachable' END AS fallback FROM k")
register("calibrated_thresholds", lambda s, d: selective.calibrated(tf.forward(s, d), 0.75), f"{CAL_F} UNION ALL {CAL_ALL}")
register(
    "gated_predictions", lambda s, d: selective.gated(tf.forward(s, d), selective.calibrated(tf.forward(s, d), 0.75)),
    f"""SELECT pair_id, p.family, pred_family, confidence, confidence IS NULL OR confidence < coalesce(t.tau, (SELECT tau FROM ({CAL_ALL}))) AS abstain FROM pred p LEFT JOIN ({CAL_F}) t ON t.family = pred_family WHERE input_order = 'ab'""",
)
DECIDE = "SELECT pair_id, concat_ws(',', CASE WHEN confidence < 0.5 THEN 'confidence' END, CASE WHEN entropy > 0.6 THEN 'entropy' END, CASE WHEN prm < 0.2 THEN 'prm' END) AS reasons FROM ginp"
register("abstention_decisions", lambda s, d: selective.decisions(tf.gated_inputs(s, d), 0.5, 0.6, 0.2), f"SELECT pair_id, reasons <> '' AS abstain, reasons FROM ({DECIDE})")
register(
    "abstention_reasons", lambda s, d: selective.decisions(tf.gated_inputs(s, d), 0.5, 0.6, 0.2).where("abstain").select(F.explode(F.split("reasons", ",")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")),
    f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM ({DECIDE}) WHERE reasons <> '') GROUP BY reason",
)
COVER = "SELECT l.pair_id, coalesce(x.d, 0) + coalesce(y.d, 0) AS cov FROM labels_ l JOIN rs ON rs.pair_id = l.pair_id AND rs.split = 'test' LEFT JOIN (SELECT unnest([a_id, b_id]) AS e, count(*) AS d FROM labels_ JOIN rs USING (pair_id) WHERE split = 'train' GROUP BY 1) x ON x.e = a_id LEFT JOIN (SELECT unnest([a_id, b_id]) AS e, count(*) AS d FROM labels_ JOIN rs USING (pair_id) WHERE split = 'train' GROUP BY 1) y ON y.e = b_id"


def covered(s, d):
    labels = frames.labels(s, d)
    cov = splits.endpoint_coverage(labels, splits.random_split(labels)).select("pair_id", F.col("cov_sum").alias("cov"))
    return tf.forward(s, d).select("pair_id", "confidence", (F.col("pred_family") == F.col("family")).cast("double").alias("ok")).join(cov, "pair_id")


register(
    "coverage_deciles", lambda s, d: selective.deciles(covered(s, d), "cov", "ok"),
    f"""SELECT least(9, floor((total - upto) * 10 / total))::INT AS part, sum(c)::BIGINT AS n, min(cov) AS lo, max(cov) AS hi, round(sum(v) / sum(c), 6) AS mean FROM (SELECT cov, c, v, sum(c) OVER (ORDER BY cov DESC) AS upto, sum(c) OVER () AS total FROM (
SELECT cov, count(*) AS c, sum((pred_family = family)::INT) AS v FROM pred JOIN ({COVER}) USING (pair_id) WHERE input_order = 'ab' GROUP BY cov)) GROUP BY 1""",
)
register(
    "coverage_spearman", lambda s, d: selective.spearman(covered(s, d), "cov", "confidence"),
    f"""SELECT count(*) AS n, round(corr(ra, rb), 5) AS rho FROM (SELECT rank() OVER (ORDER BY cov) + (count(*) OVER (PARTITION BY cov) - 1) / 2 AS ra, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2 AS rb
FROM pred JOIN ({COVER}) USING (pair_id) WHERE input_order = 'ab')""",
)
# Candidate choice.
AGG = """WITH v AS (SELECT *, passed AND cand_family IS NOT NULL AS vt FROM cand), f AS (SELECT pair_id, cand_family, count_if(vt) AS n, round(sum(CASE WHEN vt THEN score ELSE 0 END), 9) AS w, min(CASE WHEN vt THEN candidate_id END) AS first FROM v GROUP BY ALL),
g AS (SELECT pair_id, sum(n)::BIGINT AS votes, arg_max(cand_family, (n, -first)) FILTER (n > 0) AS major, arg_max(cand_family, (w, -first)) FILTER (n > 0) AS heavy, list_sort(list(n), 'DESC') AS c FROM f GROUP BY pair_id),
r AS (SELECT pair_id, count(*) AS n_rows, arg_min(cand_family, candidate_id) AS greedy, arg_max(cand_family, (passed, score, -candidate_id)) AS best, arg_max(cand_family, (score, -candidate_id)) FILTER (passed) AS top,
  arg_max(cand_family, (passed, score, -candidate_id)) FILTER (candidate_id < 1) AS a1, arg_max(cand_family, (passed, score, -candidate_id)) FILTER (candidate_id < 2) AS a2,
  arg_max(cand_family, (passed, score, -candidate_id)) FILTER (candidate_id < 4) AS a4, arg_max(cand_family, (passed, score, -candidate_id)) FILTER (candidate_id < 8) AS a8 FROM cand GROUP BY pair_id),
j AS (SELECT *, c[1] AS n1, coalesce(c[2], 0) AS n2 FROM g JOIN r USING (pair_id)), maj AS (SELECT *, CASE WHEN votes > 0 THEN major ELSE best END AS m FROM j)"""
ROWS = [
    ("greedy", "greedy", "false", "NULL"), ("argmax_1", "a1", "false", "NULL"), ("argmax_2", "a2", "false", "NULL"), ("argmax_4", "a4", "false", "NULL"), ("argmax_8", "a8", "false", "NULL"), ("vote_majority", "m", "false", "NULL"),
    ("vote_then_argmax", "CASE WHEN votes > 0 AND n1 > floor(n_rows / 2) THEN major ELSE best END", "false", "NULL"), ("vote_weighted", "CASE WHEN votes > 0 THEN heavy ELSE best END", "false", "NULL"),
    ("vote_consensus", "CASE WHEN votes > 0 THEN top ELSE greedy END", "NOT coalesce(votes > 0 AND top = major, false)", "round(n1 / n_rows, 6)"),
    ("vote_margin", "m", "false", "CASE WHEN votes > 0 THEN round((n1 - n2) / n_rows, 6) END"),
]
register(
    "candidate_aggregators", lambda s, d: voting.aggregated(frames.candidates(s, d)),
    nested(AGG + " " + " UNION ALL ".join(f"SELECT pair_id, '{t}' AS aggregator, {f} AS family, {z} AS abstain, {c}::DOUBLE AS confidence FROM maj" for t, f, z, c in ROWS)),
)
register(
    "candidate_log_vote", lambda s, d: voting.log_vote(frames.candidates(s, d)),
    """SELECT pair_id, arg_max(cand_family, (w, -first)) AS family, round(max(w) / CASE WHEN sum(w) > 0 THEN sum(w) ELSE 1 END, 5) AS confidence FROM (SELECT pair_id, cand_family, round(sum(greatest(ln(greatest(score, 1e-12::DOUBLE)) + 12, 0)), 6) AS w,
min(candidate_id) AS first FROM cand WHERE passed GROUP BY ALL) GROUP BY pair_id""",
)
register(
    "candidate_signals", lambda s, d: voting.signals(frames.candidate_tallies(s, d)),
    """SELECT pair_id, round((c[1] - coalesce(c[2], 0)) / n_all, 6) AS margin, round(CASE WHEN k > 1 THEN 1 - (ln(n_all) - h / n_all) / ln(k) ELSE 1.0 END, 5) AS certainty, round(hi, 6) AS score_max, round(s / n_all, 6) AS score_mean, round(mt, 6) AS score_top_family FROM (
SELECT pair_id, sum(n) AS n_all, count(*) AS k, list_sort(list(n), 'DESC') AS c, sum(n * ln(n)) AS h, sum(s) AS s, max(hi) AS hi, arg_max(s / n, (n, -first)) AS mt FROM (SELECT pair_id, cand_family, count(*) AS n, sum(score) AS s, max(score) AS hi, min(candidate_id) AS first FROM cand GROUP BY ALL) GROUP BY pair_id)""",
)
register(
    "oracle_ceiling", lambda s, d: voting.oracle_ceiling(frames.candidates(s, d, ("family",))),
    "SELECT family, count(*) AS n, round(avg(a::INT::DOUBLE), 6) AS ceiling FROM (SELECT pair_id, family, bool_or(cand_family = family) AS a FROM cand JOIN labels_ USING (pair_id) GROUP BY ALL) GROUP BY family",
)
register(
    "partial_rescue", lambda s, d: voting.partial_rescue(tf.forward(s, d), frames.candidates(s, d, ("family",)).where("cand_family = family")),
    """SELECT share, m, round((r + m) / n, 6) AS accuracy FROM (SELECT share, count_if(rk <= floor(share * nn))::BIGINT AS m FROM (SELECT row_number() OVER (ORDER BY md5('fix-1|' || pair_id), pair_id) AS rk, count(*) OVER () AS nn FROM pred
WHERE input_order = 'ab' AND pred_family <> family AND pair_id IN (SELECT pair_id FROM cand JOIN labels_ USING (pair_id) WHERE cand_family = family)), (SELECT unnest([0.3::DOUBLE, 0.5::DOUBLE, 0.7::DOUBLE, 1.0::DOUBLE]) AS share) GROUP BY share),
(SELECT count(*) AS n, count_if(pred_family = family) AS r FROM pred WHERE input_order = 'ab')""",
)


def votes_as_model(s, d):
    return curation.vote(frames.candidates(s, d)).select("pair_id", F.col("majority").alias("pred_family"), F.col("share").alias("confidence"))


register(
    "decoder_vote", lambda s, d: voting.weighted_modes({"ab": (tf.forward(s, d), 1.0), "ba": (frames.scored(s, d).where("input_order = 'ba'"), 1.0), "votes": (votes_as_model(s, d), 0.6)}),
    f"""SELECT pair_id, arg_max(f, (w, -k)) AS family FROM (SELECT pair_id, f, sum(w) AS w, min(k) AS k FROM (SELECT pair_id, pred_family AS f, 1.0::DOUBLE AS w, CASE input_order WHEN 'ab' THEN 0 ELSE 1 END AS k FROM pred
UNION ALL SELECT pair_id, votes, 0.6::DOUBLE, 2 FROM ({VOTES})) GROUP BY ALL) GROUP BY pair_id""",
)
register(
    "mode_table", lambda s, d: voting.mode_table(tf.forward(s, d), votes_as_model(s, d).join(frames.labels(s, d).select("pair_id", "family"), "pair_id")),
    f"""SELECT family, count_if(x AND y)::BIGINT AS "both", count_if(x AND NOT y)::BIGINT AS only_a, count_if(NOT x AND y)::BIGINT AS only_b, count_if(NOT x AND NOT y)::BIGINT AS "none" FROM (SELECT family, pred_family = family AS x, votes = family AS y FROM pred JOIN ({VOTES}) USING (pair_id) WHERE input_order = 'ab') GROUP BY family""",
)
register(
    "majority_baseline", lambda s, d: voting.majority_baseline(splits.random_split(frames.labels(s, d)).where("split = 'train'"), splits.random_split(frames.labels(s, d)).where("split = 'test'")),
    "SELECT pair_id, family, (SELECT family FROM rs WHERE split = 'train' GROUP BY family ORDER BY count(*) DESC, family DESC LIMIT 1) AS pred_family FROM rs WHERE split = 'test'",
)


def mirrored_model(s, d):
    return frames.scored(s, d).where("input_order = 'ba'").select("pair_id", "pred_family", "abstain", "confidence", tf.distribution(F.col("confidence"), F.col("pred_family")).alias("dist"))


NEXT = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in zip(FAMILIES, (*FAMILIES[1:], FAMILIES[0]), strict=True)) + " END"
TWO = f"""WITH m AS (SELECT a.pair_id, a.family, a.pred_family AS fa, b.pred_family AS fb, a.abstain AS za, b.abstain AS zb, a.confidence AS ca, b.confidence AS cb FROM pred a JOIN pred b ON a.pair_id = b.pair_id AND a.input_order = 'ab' AND b.input_order = 'ba'),
d AS (SELECT pair_id, 'a' AS t, ca AS c, fa AS f, ca AS p FROM m UNION ALL SELECT pair_id, 'a', ca, {NEXT.format('fa')}, 1 - ca FROM m UNION ALL SELECT pair_id, 'b', cb, fb, cb FROM m UNION ALL SELECT pair_id, 'b', cb, {NEXT.format('fb')}, 1 - cb FROM m),
k AS (SELECT pair_id, f, round(sum(p * 0.5::DOUBLE), 9) AS h, round(sum(p * c), 9) AS w FROM d GROUP BY ALL), q AS (SELECT pair_id, arg_min(f, (-h, f)) AS avg_f, arg_min(f, (-w, f)) AS con_f FROM k GROUP BY pair_id), x AS (SELECT * FROM m JOIN q USING (pair_id))"""
TWO_ROWS = [("solo_a", "fa", "za"), ("solo_b", "fb", "zb"), ("rescue_abstain", "CASE WHEN za THEN fb ELSE fa END", "za AND zb"), ("max_confidence", "CASE WHEN cb > ca THEN fb ELSE fa END", "false"), ("prob_average", "avg_f", "false"), ("confidence_weighted", "con_f", "false"), ("agree", "fa", "fa <> fb")]
register(
    "two_model_ensembles", lambda s, d: voting.two_models(tf.gated_inputs(s, d), mirrored_model(s, d)),
    nested(TWO + " " + " UNION ALL ".join(f"SELECT pair_id, family, '{r}' AS rule, {f} AS pred_family, {z} AS abstain FROM x" for r, f, z in TWO_ROWS)),
)
GRID = (0.3, 0.5, 0.7, 0.9)
register(
    "threshold_router", lambda s, d: voting.threshold_router(tf.forward(s, d), votes_as_model(s, d), splits.halves(tf.forward(s, d).select("pair_id")).where("half = 'tune'"), GRID),
    f"""SELECT tau, n_right, round(n_right / n, 6) AS accuracy, n_right = max(n_right) OVER () AS best FROM (SELECT tau, count(*) AS n, count_if(CASE WHEN share >= tau THEN votes ELSE pred_family END = family)::BIGINT AS n_right FROM (
SELECT p.pair_id, family, pred_family FROM (SELECT *, row_number() OVER (ORDER BY md5('half-1|' || pair_id), pair_id) AS rk, count(*) OVER () AS nn FROM pred WHERE input_order = 'ab') p WHERE rk <= floor(nn / 2)) JOIN ({VOTES}) USING (pair_id)
JOIN (SELECT pair_id, round(max(v) / sum(v), 6) AS share FROM (SELECT pair_id, cand_family, count(*) AS v FROM cand GROUP BY ALL) GROUP BY pair_id) USING (pair_id), (SELECT unnest({list(GRID)}::DOUBLE[]) AS tau) GROUP BY tau)""",
)
register(
    "rebalanced", lambda s, d: voting.rebalanced(tf.forward(s, d), frames.candidates(s, d).where("candidate_id < 3").select("pair_id", F.col("cand_family").alias("vote")), metrics.bias_ratio(tf.forward(s, d)), 0.9),
    """SELECT pair_id, p.family, CASE WHEN go THEN other ELSE pred_family END AS pred_family, coalesce(go, false) AS switched FROM (SELECT p.*, other, b > 0.9 AND confidence < 0.6 AND other IS NOT NULL AND other <> pred_family AS go FROM pred p
LEFT JOIN (SELECT pair_id, arg_max(cand_family, (n, cand_family)) AS other FROM (SELECT pair_id, cand_family, count(*) AS n FROM cand WHERE candidate_id < 3 GROUP BY ALL) WHERE n >= 2 GROUP BY pair_id) USING (pair_id)
LEFT JOIN (SELECT g.family, round(coalesce(np, 0) / nt, 6) AS b FROM (SELECT family, count(*) AS nt FROM pred WHERE input_order = 'ab' GROUP BY 1) g LEFT JOIN (SELECT pred_family AS family, count(*) AS np FROM pred WHERE input_order = 'ab' AND NOT abstain GROUP BY 1) USING (family)) q ON q.family = p.pred_family
WHERE input_order = 'ab') p""",
)


def stages(s, d):
    base = tf.forward(s, d)
    rescue = traces.rescued(base, tf.steps(s, d)).select("pair_id", "family", F.col("final").alias("pred_family"))
    return voting.stage_gains({"greedy": base, "mirror": metrics.reconciled(frames.scored(s, d)), "rescue": rescue})


register(
    "stage_gains", stages,
    f"""SELECT step, stage, n, acc AS accuracy, round(acc - lag(acc) OVER (ORDER BY step), 6) AS gain FROM (SELECT 0 AS step, 'greedy' AS stage, count(*) AS n, round(avg((pred_family = family)::INT::DOUBLE), 6) AS acc FROM pred WHERE input_order = 'ab'
UNION ALL SELECT 1, 'mirror', count(*), round(avg((pred_family = family)::INT::DOUBLE), 6) FROM ({RECON}) UNION ALL SELECT 2, 'rescue', count(*), round(avg((final = family)::INT::DOUBLE), 6) FROM ({RESCUE.format(1.0, 1.0)}))""",
)
# Samples and splits.
register(
    "split_overlap", lambda s, d: splits.overlap(splits.random_split(frames.labels(s, d)).where("split = 'train'"), {"random_test": splits.random_split(frames.labels(s, d)).where("split = 'test'"), "pair_cold_test": splits.pair_cold_split(frames.labels(s, d), splits.entity_parts(frames.labels(s, d))).where("split = 'test'")}),
    "SELECT 'random_test' AS name, count(*) AS n FROM rs a JOIN rs b USING (pair_id) WHERE a.split = 'train' AND b.split = 'test' UNION ALL SELECT 'pair_cold_test', count(*) FROM rs JOIN pc USING (pair_id) WHERE rs.split = 'train' AND pc.split = 'test'",
)
for mode in ("balanced", "proportional", "sqrt_inverse"):  # the rounds of seats have no short SQL; tests count them by hand
    register(f"quota_{mode}", lambda s, d, mode=mode: splits.quota_sample(frames.labels(s, d), 1000, mode))
CELL = "SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY md5('{1}|' || pair_id), pair_id) AS rk, count(*) OVER (PARTITION BY {0}) AS nn FROM pred WHERE input_order = 'ab'"
register(
    "cell_sample", lambda s, d: splits.cell_sample(tf.forward(s, d).select("pair_id", "family", "pred_family"), ["family", "pred_family"], 20),
    f"SELECT pair_id, family, pred_family FROM ({CELL.format('family, pred_family', 'cell-1')}) WHERE rk <= 20",
)
register(
    "stratum_split", lambda s, d: splits.stratum_split(tf.forward(s, d).select("pair_id", "family", "polarity"), ["family", "polarity"]),
    f"SELECT pair_id, family, polarity, CASE WHEN nn > 1 AND rk <= least(nn - 1, greatest(1, round_even(nn * 0.1::DOUBLE, 0))) THEN 'val' ELSE 'train' END AS part FROM ({CELL.format('family, polarity', 'val-1')})",
)
register(
    "tuning_halves", lambda s, d: splits.halves(tf.forward(s, d).select("pair_id")),
    "SELECT pair_id, CASE WHEN rk <= floor(nn / 2) THEN 'tune' ELSE 'hold' END AS half FROM (SELECT pair_id, row_number() OVER (ORDER BY md5('half-1|' || pair_id), pair_id) AS rk, count(*) OVER () AS nn FROM pred WHERE input_order = 'ab')",
)
register(
    "importance_sample", lambda s, d: splits.importance_sample(tf.forward(s, d).select("pair_id", F.col("confidence").alias("weight"))),
    "SELECT pair_id, confidence AS weight FROM pred WHERE input_order = 'ab' AND ('0x' || substr(md5('imp-1|' || pair_id), 1, 8))::BIGINT / 4294967296.0 <= confidence / (SELECT max(confidence) FROM pred WHERE input_order = 'ab')",
)
register(
    "mirror_rows", lambda s, d: splits.mirrored(tf.forward(s, d).select("pair_id", "direction", F.col("family").alias("text_a"), F.col("subtype").alias("text_b"))),
    """SELECT pair_id, direction, family AS text_a, subtype AS text_b, 'ab' AS input_order FROM pred WHERE input_order = 'ab' UNION ALL
SELECT pair_id, CASE direction WHEN 'a_to_b' THEN 'b_to_a' WHEN 'b_to_a' THEN 'a_to_b' ELSE direction END, subtype, family, 'ba' FROM pred WHERE input_order = 'ab'""",
)
