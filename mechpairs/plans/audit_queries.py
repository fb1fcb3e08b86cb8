"""Queries over audits, selections, counterfactuals and hard negatives, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, curation, gates, splits
from ..operators import counterfactuals as cf
from ..operators.taxonomy import FAMILIES
from . import frames
from . import trace_frames as tf
from .curation_queries import GATED, PREF, RR, WIN, answers, known, tiered, winners
from .registry import codes, parts, register, tokens
from .sql import _list, _quote
from .trace_queries import nested

FORWARD = "(SELECT * FROM pred WHERE input_order = 'ab')"

register("template_cover", lambda s, d: audits.template_cover(frames.pairs(s, d)), """SELECT any_value(total)::BIGINT AS n_pairs, count(*) AS n_templates, min(r) FILTER (held >= ceil(round(total * 0.95::DOUBLE, 6))) AS n_cover FROM (
SELECT row_number() OVER w AS r, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS held, sum(n) OVER () AS total FROM (SELECT template, count(*) AS n FROM tmpl GROUP BY template) WINDOW w AS (ORDER BY n DESC, template))""")
register("description_spread", lambda s, d: audits.description_spread(frames.mentions(s, d)), """SELECT n_descriptions, count(*) AS n_pairs, count_if(x AND y AND NOT e)::BIGINT AS n_asymmetric FROM (SELECT a, b, count(*) AS n_descriptions, bool_or(x) AS x, bool_or(y) AS y, bool_and(x AND y) AS e
FROM (SELECT least(s, o) AS a, greatest(s, o) AS b, description, bool_or(s < o) AS x, bool_or(s > o) AS y FROM ment GROUP BY ALL) GROUP BY a, b) GROUP BY n_descriptions""")


def overlaps(s: SparkSession, d: str) -> DataFrame:
    return audits.split_overlaps(frames.labels(s, d), None, parts(s, d))


ENDS = "SELECT e, bool_or(split = 'train') AS tr, bool_or(split = 'val') AS va, bool_or(split = 'test') AS te FROM (SELECT unnest([a_id, b_id]) AS e, ec.split FROM wp JOIN ec USING (pair_id)) GROUP BY e"
register("split_overlaps", overlaps, f"""SELECT * FROM (SELECT count_if(tr)::BIGINT AS train_entities, count_if(va)::BIGINT AS val_entities, count_if(te)::BIGINT AS test_entities, count_if(tr AND te)::BIGINT AS train_test, count_if(tr AND va)::BIGINT AS train_val, count_if(va AND te)::BIGINT AS val_test FROM ({ENDS})),
(SELECT count_if(pa = 'test' OR pb = 'test')::BIGINT AS train_pairs_in_test_part, count_if(pa = 'val' OR pb = 'val')::BIGINT AS train_pairs_in_val_part FROM wp JOIN ec USING (pair_id) WHERE split = 'train')""")
register("degree_distribution", lambda s, d: audits.degree_distribution(frames.labels(s, d)), "SELECT degree, count(*) AS n_entities FROM (SELECT e, count(*) AS degree FROM (SELECT unnest([a_id, b_id]) AS e FROM labels_) GROUP BY e) GROUP BY degree")


def split_sizes(s: SparkSession, d: str) -> DataFrame:
    labels, own = frames.labels(s, d), parts(s, d)
    return audits.complementarity({"random": splits.random_split(labels), "entity_cold": splits.entity_cold_split(labels, own), "pair_cold": splits.pair_cold_split(labels, own)})


SIZES = " UNION ALL ".join(f"SELECT '{n}' AS name, split, count(*) AS n FROM {t} GROUP BY split" for n, t in (("random", "rs"), ("entity_cold", "ec"), ("pair_cold", "pc")))
register("split_sizes", split_sizes, f"SELECT name, split, n, round(n / sum(n) OVER (PARTITION BY name), 6) AS share FROM ({SIZES})")
register("family_prevalence", lambda s, d: audits.prevalence(splits.random_split(frames.labels(s, d)).where("split = 'train'"), tf.forward(s, d)), f"""SELECT family, round(t / nt, 6) AS train_share, round(g / n, 6) AS gold_share, round(p / n, 6) AS pred_share, round(2 * r / (g + p), 6) AS f1 FROM (SELECT family, count(*) AS t, (SELECT count(*) FROM rs WHERE split = 'train') AS nt FROM rs WHERE split = 'train' GROUP BY family)
JOIN (SELECT family, count(*) AS g, count_if(NOT abstain AND pred_family = family) AS r, (SELECT count(*) FROM {FORWARD}) AS n FROM {FORWARD} GROUP BY family) USING (family) LEFT JOIN (SELECT pred_family AS family, count(*) AS p FROM {FORWARD} WHERE NOT abstain GROUP BY 1) USING (family)""")
register("brier_score", lambda s, d: audits.brier(tf.forward(s, d).select("confidence", (F.col("pred_family") == F.col("family")).alias("ok")), "confidence", "ok"), f"""SELECT count(*) AS n, round(avg(power(confidence - y, 2)), 6) AS brier, round(avg(((confidence >= 0.5::DOUBLE) = (y = 1))::INT::DOUBLE), 6) AS accuracy, avg(power(confidence - y, 2)) <= 0.25::DOUBLE AS ok FROM (SELECT confidence, (pred_family = family)::INT AS y FROM {FORWARD})""")


def both_orders(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = frames.scored(s, d)
    return rows.where("input_order = 'ab'"), rows.where("input_order = 'ba'")


WINS = "SELECT pair_id, family, CASE WHEN oa AND ob THEN 'both_correct' WHEN oa THEN 'llm_win' WHEN ob THEN 'baseline_win' ELSE 'both_wrong' END AS bucket FROM mir"
register("win_loss", lambda s, d: audits.win_loss(*both_orders(s, d)), WINS)
register("win_loss_sample", lambda s, d: splits.cell_sample(audits.win_loss(*both_orders(s, d)), ["bucket", "family"], 20).select("pair_id", "family", "bucket"), f"SELECT pair_id, family, bucket FROM (SELECT *, row_number() OVER (PARTITION BY bucket, family ORDER BY md5('cell-1|' || pair_id), pair_id) AS r FROM ({WINS})) WHERE r <= 20")
register("candidate_places", lambda s, d: audits.ranked_scores(tiered(s, d), ["score", "final"]), f"SELECT pair_id, candidate_id, {', '.join(f'round(1 / row_number() OVER (PARTITION BY pair_id ORDER BY {c} DESC, candidate_id), 6) AS {c}_place' for c in ('score', 'final'))} FROM ({GATED})")
QUOTAS = dict(zip(FAMILIES, (90, 80, 70, 60, 50, 40, 30), strict=True))
LIMIT = "CASE family " + " ".join(f"WHEN '{f}' THEN {n}" for f, n in QUOTAS.items()) + " END"
register(
    "quota_selection", lambda s, d: audits.quota_selection(tf.forward(s, d), QUOTAS, [F.col("confidence")], splits.random_split(frames.labels(s, d)).where("split = 'val'")).select("pair_id", "family", "rank"),
    f"SELECT pair_id, family, rank::INT AS rank FROM (SELECT pair_id, family, row_number() OVER (PARTITION BY family ORDER BY confidence, pair_id) AS rank FROM {FORWARD} WHERE pair_id NOT IN (SELECT pair_id FROM rs WHERE split = 'val')) WHERE rank <= {LIMIT}",
)


def said(s: SparkSession, d: str) -> DataFrame:
    rows = tf.steps(s, d).groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("step_id", "claim"))).alias("l"))
    return rows.select("pair_id", F.array_join(F.transform("l", lambda x: x["claim"]), "\n").alias("said"))


def clusters(s: SparkSession, d: str) -> DataFrame:
    rows = tf.with_steps(s, d, claims=lambda _, x: tf.claim(x))
    return rows.select("*", frames.apart(said=F.array_join("claims", "\n"))).select("pair_id", "family", frames.apart(cluster=audits.error_cluster(F.col("said"))))


SAID = "(SELECT pair_id, string_agg(claim, chr(10) ORDER BY step_id) AS said FROM steps_ GROUP BY pair_id)"
ADVERSE = " ".join(
    f"WHEN pred_family = 'AdverseRisk' AND family = '{f}' THEN " + (f"CASE WHEN regexp_matches(lower(said), {_quote('|'.join(audits.CUES[f]))}) THEN '{x}' ELSE '{y}' END" if f in audits.CUES else f"'{x}'") for f, (x, y) in audits.TO_ADVERSE.items())
CLUSTER = f"""SELECT pair_id, family, CASE WHEN abstain THEN 'parse_or_schema_failure' WHEN pred_family = family AND pred_direction <> direction THEN 'direction_only_error' WHEN pred_family = family AND pred_subtype <> subtype THEN 'subtype_only_error' WHEN pred_family = family THEN 'correct'
WHEN pred_subtype = subtype THEN 'axis_ambiguity_same_subtype' {ADVERSE} WHEN pred_family = 'AdverseRisk' THEN 'rare_family_mislabeled_as_adverse' WHEN family = 'AdverseRisk' THEN 'adverse_mislabeled_as_non_adverse' WHEN starts_with(family, 'PK_') AND starts_with(pred_family, 'PK_') THEN 'pk_family_confusion'
WHEN family = 'Efficacy' AND pred_family = 'PD_Activity' THEN 'efficacy_vs_pd_confusion' WHEN family = 'PD_Activity' AND pred_family = 'Efficacy' THEN 'pd_vs_efficacy_confusion' ELSE 'other_family_error' END AS cluster FROM {FORWARD} JOIN {SAID} USING (pair_id)"""
register("error_clusters", lambda s, d: clusters(s, d).groupBy("cluster", "family").agg(F.count("*").alias("n")), f"SELECT cluster, family, count(*) AS n FROM ({CLUSTER}) GROUP BY ALL")
register("cluster_targets", lambda s, d: audits.first_seen(clusters(s, d).where("cluster <> 'correct'"), "cluster", 50, ["pair_id"]).select("pair_id", "cluster"), f"SELECT pair_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pair_id) AS r FROM ({CLUSTER}) WHERE cluster <> 'correct') WHERE r <= 50")
register(
    "capped_subset", lambda s, d: audits.capped_subset(frames.labels(s, d).where("family <> 'Other'"), 500, 0.003),
    nested("""WITH c AS (SELECT * FROM (SELECT pair_id, family, a_id, b_id, row_number() OVER (PARTITION BY family ORDER BY md5('cap-1|' || pair_id), pair_id) AS r FROM labels_ WHERE family <> 'Other') WHERE r <= 500)
SELECT pair_id, any_value(family) AS family FROM (SELECT pair_id, family, row_number() OVER (PARTITION BY e ORDER BY r, pair_id) AS seat FROM (SELECT pair_id, family, r, unnest([a_id, b_id]) AS e FROM c)) GROUP BY pair_id HAVING max(seat) <= (SELECT ceil(round(count(*) * 0.003::DOUBLE, 6)) FROM c)"""),
)
register("drop_reasons", lambda s, d: audits.drop_reasons(frames.labels(s, d)), "SELECT pair_id, family, CASE WHEN family = 'Other' THEN 'unmatched_codename' WHEN NOT bidirectional AND subject_id = object_id THEN 'ambiguous_synonym_same_id' END AS reason FROM labels_")
FULL = ("full_correct", "family_correct")


def cascade(s: SparkSession, d: str) -> DataFrame:
    rows = answers(s, d)
    return audits.kept_tiers(rows, gates.preferences(rows, FAMILIES, alone=True, kept=("tier",)), FULL)[1].select("pair_id", "kind")


register("kept_preferences", cascade, nested(f"SELECT pair_id, kind FROM ({PREF}) WHERE pair_id IN (SELECT pair_id FROM ({WIN}) WHERE tier IN ('full_correct', 'family_correct'))"))
register(
    "reranked_records", lambda s, d: audits.reranked_records(gates.reranked(winners(known(s, d)), ["final"], "pick"), None, None),
    f"""SELECT pair_id, coalesce(p.candidate_id, w.candidate_id) AS candidate_id, coalesce(p.tier, w.tier) AS tier, coalesce(p.candidate_id <> w.candidate_id, false) AS changed FROM ({WIN}) w LEFT JOIN (
SELECT f.pair_id, f.candidate_id, g.tier FROM {RR.format('final')} f JOIN ({GATED}) g ON f.pair_id = g.pair_id AND f.candidate_id = g.candidate_id AND g.tier <> 'drop') p USING (pair_id)""",
)


def held(s: SparkSession, d: str) -> DataFrame:
    part = frames.table(s, d, "part").select(frames.entity_id(F.col("p_partkey")).alias("entity"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    ends = frames.pairs(s, d).select(F.explode(F.array("a_id", "b_id")).alias("entity"))
    return audits.completeness(part, {"pairs": ends, "tokens": tokens(s, d), "codes": codes(s, d)}, ["name", "brand"])


register("entity_completeness", held, """SELECT *, has_name::INT + has_brand::INT + in_pairs::INT + in_tokens::INT + in_codes::INT AS n_held FROM (SELECT entity, coalesce(trim(p_name) <> '', false) AS has_name, coalesce(trim(p_brand) <> '', false) AS has_brand,
entity IN (SELECT unnest([a_id, b_id]) FROM pairs) AS in_pairs, entity IN (SELECT entity FROM toks) AS in_tokens, true AS in_codes FROM (SELECT *, 'P' || lpad(p_partkey::VARCHAR, 9, '0') AS entity FROM part))""")


def checked(s: SparkSession, d: str) -> DataFrame:
    rows = tf.with_steps(s, d, claims=lambda _, x: tf.claim(x))
    return audits.crosscheck(winners(rows.select("*", frames.apart(said=F.array_join("claims", "\n"))).drop("claims", "confidence")))


POLARITY = "CASE polarity " + " ".join(f"WHEN '{g}' THEN coalesce(pred_polarity IN ({', '.join(map(_quote, f))}), false)" for g, f in audits.POLARITIES.items()) + " ELSE polarity IS NULL OR pred_polarity = polarity END"
WORDS = f"list_filter(regexp_split_to_array(lower(subtype), '[_\\s-]+'), lambda w: len(w) > 2 AND w NOT IN ({', '.join(map(_quote, audits.STOPWORDS))}))"
AXES = ("family_ok", "subtype_ok", "polarity_ok", "direction_ok", "all_ok")
register(
    "tier_crosscheck", checked,
    f"""SELECT tier, count(*) AS n, {', '.join(f'round(avg({c}::INT::DOUBLE), 6) AS {c}' for c in AXES)} FROM (SELECT *, family_ok AND subtype_ok AND polarity_ok AND direction_ok AS all_ok FROM (SELECT tier, pred_family = family AS family_ok,
len({WORDS}) = 0 OR len(list_filter({WORDS}, lambda w: contains(lower(said), w))) > 0 AS subtype_ok, {POLARITY} AS polarity_ok, pred_direction = direction AS direction_ok FROM {FORWARD} JOIN (SELECT pair_id, tier FROM ({WIN})) USING (pair_id) JOIN {SAID} USING (pair_id))) GROUP BY tier""",
)
GRID = (0.0, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 1.0)


def routing(s: SparkSession, d: str) -> DataFrame:
    a, b = both_orders(s, d)
    rows = a.select("pair_id", "family", "pred_family", "confidence").join(b.select("pair_id", F.col("pred_family").alias("base_family")), "pair_id")
    return audits.confusion_routing(rows, splits.random_split(frames.labels(s, d)).where("split = 'val'"), GRID)


register("confusion_routing", routing, nested(f"""WITH t AS (SELECT a.pair_id, a.family, a.pred_family, b.pred_family AS base_family, a.confidence FROM pred a JOIN pred b ON a.pair_id = b.pair_id AND a.input_order = 'ab' AND b.input_order = 'ba' WHERE a.pair_id IN (SELECT pair_id FROM rs WHERE split = 'val')),
k AS (SELECT tau, family, pred_family, base_family, confidence < tau AS low, count(*) AS n FROM t, (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in GRID)}]) AS tau) GROUP BY ALL),
r AS (SELECT k.*, predicted, low AND coalesce(predicted = pred_family, false) AS handed FROM k, (SELECT unnest([NULL, {', '.join(map(_quote, FAMILIES))}]) AS predicted)),
f AS (SELECT tau, predicted, family, CASE WHEN handed THEN base_family ELSE pred_family END AS said, n, CASE WHEN handed THEN n ELSE 0 END AS m FROM r),
y AS (SELECT tau, predicted, c, sum(g) AS g, sum(p) AS p, sum(r) AS r, sum(m) AS m FROM (SELECT tau, predicted, family AS c, n AS g, 0 AS p, CASE WHEN said = family THEN n ELSE 0 END AS r, m FROM f UNION ALL SELECT tau, predicted, said, 0, n, 0, 0 FROM f) GROUP BY ALL),
z AS (SELECT tau, predicted, avg(2 * r / (g + p)) AS f1, sum(m)::BIGINT AS n FROM y WHERE g > 0 GROUP BY ALL)
SELECT tau, predicted, n, gain, n >= 20 AND gain > 0 AS use FROM (SELECT z.tau, z.predicted, z.n, round(z.f1 - b.f1, 6) + 0.0::DOUBLE AS gain FROM z JOIN z b ON z.tau = b.tau AND b.predicted IS NULL WHERE z.predicted IS NOT NULL)"""))


def order_gain(s: SparkSession, d: str) -> DataFrame:
    votes = curation.vote(frames.candidates(s, d)).select("pair_id", F.col("majority").alias("pred_family"))
    return audits.compared(tf.forward(s, d), votes)


VOTES = "SELECT pair_id, arg_max(cand_family, (votes, -first)) AS z FROM (SELECT pair_id, cand_family, count(*) AS votes, min(candidate_id) AS first FROM cand GROUP BY ALL) GROUP BY pair_id"
register("before_after", order_gain, f"""SELECT family, count(*) AS n, round(count_if(pred_family = family) / count(*), 6) AS before, round(count_if(z = family) / count(*), 6) AS after, round((count_if(z = family) - count_if(pred_family = family)) / count(*), 6) AS gain
FROM {FORWARD} JOIN ({VOTES}) USING (pair_id) GROUP BY GROUPING SETS ((), (family))""")

# Counterfactuals and hard negatives.
PREFIXES, KINDS = cf.ENZYMES + cf.TRANSPORTERS, ("inh", "ind", "sub")


def flags(s: SparkSession, d: str) -> DataFrame:
    """(entity, prefix, kind) of true flags, from digests of entity and token."""
    x = F.md5(F.concat_ws("|", "entity", F.col("token").cast("string"), F.lit("fl")).cast("binary"))
    rows = tokens(s, d).withColumn("x", x)
    return rows.select("entity", tf.choose(frames.hex_int(F.col("x"), 1, 2) % len(PREFIXES), [F.lit(p) for p in PREFIXES]).alias("prefix"), tf.choose(frames.hex_int(F.col("x"), 3, 1) % 3, [F.lit(k) for k in KINDS]).alias("kind")).distinct()


def pk_pairs(s: SparkSession, d: str) -> DataFrame:
    return frames.labels(s, d).where(F.col("family").startswith("PK_"))


ORDER = "CASE subtype " + " ".join(f"WHEN '{n}' THEN {_list(p)}" for n, p in cf.ALLOWED.items()) + f" ELSE {_list(PREFIXES)} END"
FLAGS = f"fl AS (SELECT DISTINCT entity, ({_list(PREFIXES)})[(('0x' || substr(x, 1, 2))::BIGINT % {len(PREFIXES)} + 1)] AS prefix, ({_list(KINDS)})[(('0x' || substr(x, 3, 1))::BIGINT % 3 + 1)] AS kind FROM (SELECT *, md5(entity || '|' || token || '|fl') AS x FROM toks))"
REL = f"""sd AS (SELECT pair_id, subtype, 'A' AS side, a_id AS subject, b_id AS object FROM labels_ WHERE starts_with(family, 'PK_') AND subject_id IS DISTINCT FROM b_id UNION ALL SELECT pair_id, subtype, 'B', b_id, a_id FROM labels_ WHERE starts_with(family, 'PK_') AND subject_id IS DISTINCT FROM a_id),
rl AS (SELECT pair_id, side, subject, object, prefix || '_' || kind AS flag, prefix FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY place, side, late) AS r FROM (
SELECT sd.*, u.prefix, (u.kind = 'ind')::INT AS late, u.kind, list_position({ORDER}, u.prefix) AS place FROM sd JOIN fl u ON u.entity = subject AND u.kind <> 'sub' JOIN fl v ON v.entity = object AND v.kind = 'sub' AND v.prefix = u.prefix) WHERE place > 0) WHERE r = 1)"""
register("relevant_flips", lambda s, d: cf.relevant_flips(pk_pairs(s, d), flags(s, d)), nested(f"WITH {FLAGS}, {REL} SELECT * FROM rl"))
register("null_flips", lambda s, d: cf.null_flips(cf.relevant_flips(pk_pairs(s, d), flags(s, d)), flags(s, d)), nested(f"""WITH {FLAGS}, {REL} SELECT pair_id, side, arg_min(flag, md5('null-1|' || pair_id || '|' || flag)) AS flag FROM (
SELECT rl.pair_id, rl.side, u.prefix || '_' || u.kind AS flag FROM rl JOIN fl u ON u.entity = subject AND u.kind <> 'sub' AND u.prefix <> rl.prefix WHERE NOT EXISTS (SELECT 1 FROM fl v WHERE v.entity = object AND v.kind = 'sub' AND v.prefix = u.prefix)) GROUP BY pair_id, side"""))
TAKEN = "CASE family " + " ".join(f"WHEN '{f}' THEN {_list(o)}" for f, o in cf.CONFUSED.items()) + " END"


def option(kind: str, when: str, f: str, s: str, d: str) -> str:
    return f"CASE WHEN {when} THEN {{'kind': '{kind}', 'f': {f}, 's': {s}, 'd': {d}}} END"


TURN = "CASE direction WHEN 'a_to_b' THEN 'b_to_a' WHEN 'b_to_a' THEN 'a_to_b' ELSE direction END"
OPTIONS = ", ".join([
    option("to_adverse", "family <> 'AdverseRisk'", "'AdverseRisk'", "'adverse_effects'", "direction"), *(option("axis_swap", f"({TAKEN})[{k}] IS NOT NULL", f"({TAKEN})[{k}]", "subtype", "direction") for k in (1, 2)),
    option("subtype_swap", "next_subtype <> subtype", "family", "next_subtype", "direction"), option("direction_flip", "direction IN ('a_to_b', 'b_to_a')", "family", "subtype", TURN),
])
register(
    "hard_negatives", lambda s, d: cf.hard_negatives(tf.forward(s, d).select("pair_id", "family", "subtype", "direction"), cf.next_subtypes(frames.labels(s, d))),
    nested(f"""WITH v AS (SELECT family, subtype, coalesce(lead(subtype) OVER (PARTITION BY family ORDER BY subtype), min(subtype) OVER (PARTITION BY family)) AS next_subtype FROM (SELECT DISTINCT family, subtype FROM labels_)),
l AS (SELECT pair_id, list_filter([{OPTIONS}], lambda x: x IS NOT NULL)[1:4] AS l FROM {FORWARD} JOIN v USING (family, subtype)) SELECT pair_id, (i - 1)::INT AS nth, l[i].kind AS kind, l[i].f AS family, l[i].s AS subtype, l[i].d AS direction FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l)"""),
)
