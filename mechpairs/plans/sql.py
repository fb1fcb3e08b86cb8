"""The domain frames as SQL, for checks by another engine."""

from __future__ import annotations

import re

from ..functions.citations import ENZYME, FLAG
from ..operators.taxonomy import CANONICAL, FAMILIES, RULES
from .frames import N_CANDIDATES, TEMPLATES
from .trace_frames import CLAIMS, CONTEXTS, EVIDENCE, N_STEPS


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _describe() -> str:
    return "CASE kind " + " ".join(f"WHEN {k} THEN replace(replace({_quote(t)}, '{{s}}', s), '{{o}}', o)" for k, t in enumerate(TEMPLATES)) + " END"


def _cascade(what: str) -> str:
    out = []
    for r in RULES:
        def group(k: int, r=r) -> str:
            return f"regexp_extract(template, {_quote(r.pattern)}, {k})"

        slug = "coalesce(nullif(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unspecified')"
        value = {
            "family": _quote(r.family),
            "subtype": _quote(r.subtype) if isinstance(r.subtype, str) else slug.format(group(r.subtype)),
            "polarity": _quote(r.polarity) if isinstance(r.polarity, str) else f"CASE WHEN starts_with({group(r.polarity)}, 'increase') THEN 'up' ELSE 'down' END",
            "subject": group(r.subject) if r.subject else "'both'",
            "object": group(r.object) if r.object else "'both'",
        }[what]
        out.append(f"WHEN regexp_matches(template, {_quote(r.pattern)}) THEN {value}")
    rest = {"family": "'Other'", "subtype": "'unmatched'", "polarity": "NULL", "subject": "''", "object": "''"}[what]
    return f"CASE {' '.join(out)} ELSE {rest} END"


def _next(col: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{f}' THEN '{FAMILIES[(k + 1) % len(FAMILIES)]}'" for k, f in enumerate(FAMILIES)) + " END"


def _hex(start: int, n: int) -> str:
    return f"('0x' || substr(d, {start}, {n}))::BIGINT"


def _bare(e: str) -> str:
    return f"trim(regexp_replace({e}, '\\s*=[\\s\\S]*$', ''))"


def _norm(e: str) -> str:
    t = f"replace(lower(trim({e})), '-', '_')"
    return f"CASE WHEN regexp_matches({t}, '{FLAG}') THEN regexp_extract({t}, '{FLAG}', 1) || '_' || substr(regexp_extract({t}, '{FLAG}', 2), 1, 3) ELSE {t} END"


_CANON = " ".join(f"WHEN family = '{f}' AND subtype = '{o}' THEN '{n}'" for (f, o), n in CANONICAL.items())
_ID = "'P' || lpad({0}::VARCHAR, 9, '0')"

CTES = {
    "ment": f"""SELECT *, {_describe()} AS description FROM (SELECT {_ID.format('x.l_partkey')} AS s, {_ID.format('y.l_partkey')} AS o,
  x.l_orderkey AS x1, x.l_linenumber AS x2, y.l_linenumber AS x3, x.l_suppkey AS x4, y.l_suppkey AS x5,
  (ascii(x.l_returnflag) + ascii(x.l_linestatus) + 3 * x.l_linenumber + y.l_linenumber) % {len(TEMPLATES)} AS kind
  FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey <> y.l_partkey
  AND (x.l_linenumber < y.l_linenumber OR (x.l_linenumber = y.l_linenumber AND x.l_partkey < y.l_partkey)))""",
    "pairs": """SELECT a_id || '|' || b_id AS pair_id, a_id, b_id, s AS raw_subject_id, description, n_seen > 1 AS bidirectional, n_seen, n_texts FROM (
  SELECT *, row_number() OVER (PARTITION BY a_id, b_id ORDER BY x1, x2, x3, x4, x5, s, o, kind) AS rn, count(*) OVER (PARTITION BY a_id, b_id) AS n_seen,
  count(DISTINCT description) OVER (PARTITION BY a_id, b_id) AS n_texts FROM (SELECT *, least(s, o) AS a_id, greatest(s, o) AS b_id FROM ment)) WHERE rn = 1""",
    "tmpl": """SELECT *, replace(replace(description, raw_subject_id, '<A>'), CASE WHEN raw_subject_id = a_id THEN b_id ELSE a_id END, '<B>') AS template FROM pairs""",
    # Templates are few: each is classified once.
    "tcls": f"SELECT template, {', '.join(f'{_cascade(w)} AS {w}' for w in ('family', 'subtype', 'polarity', 'subject', 'object'))} FROM (SELECT DISTINCT template FROM tmpl)",
    "casc": "SELECT pair_id, a_id, b_id, raw_subject_id, template, family, subtype, polarity, subject, object FROM tmpl JOIN tcls USING (template)",
    "labels_": f"""SELECT pair_id, a_id, b_id, template, family, CASE {_CANON} ELSE subtype END AS subtype, polarity,
  CASE subject WHEN 'A' THEN raw_subject_id WHEN 'B' THEN CASE WHEN raw_subject_id = a_id THEN b_id ELSE a_id END END AS subject_id,
  CASE object WHEN 'A' THEN raw_subject_id WHEN 'B' THEN CASE WHEN raw_subject_id = a_id THEN b_id ELSE a_id END END AS object_id,
  subject = 'both' AS bidirectional FROM casc""",
    "pred": f"""SELECT pair_id, input_order, family, subtype, polarity, direction,
  CASE WHEN {_hex(1, 4)} < 45875 THEN family ELSE {_next('family')} END AS pred_family,
  CASE WHEN {_hex(1, 4)} < 45875 AND {_hex(11, 1)} < 13 THEN subtype ELSE 'other' END AS pred_subtype,
  CASE WHEN {_hex(10, 1)} < 12 THEN direction ELSE 'n/a' END AS pred_direction, {_hex(9, 1)} = 0 AS abstain,
  CASE WHEN {_hex(1, 4)} < 45875 AND {_hex(12, 1)} < 14 THEN polarity ELSE 'other' END AS pred_polarity,
  round(0.5::DOUBLE * {_hex(5, 4)} / 65535 + CASE WHEN {_hex(1, 4)} < 45875 THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END, 3) AS confidence
  FROM (SELECT l.*, o.input_order, md5(pair_id || '|' || input_order || '|p1') AS d,
  CASE WHEN bidirectional THEN 'bidirectional' WHEN (subject_id = a_id) = (input_order = 'ab') THEN 'a_to_b' ELSE 'b_to_a' END AS direction
  FROM labels_ l, (VALUES ('ab'), ('ba')) o(input_order) WHERE family <> 'Other')""",
    "cand": f"""SELECT pair_id, candidate_id, CASE WHEN {_hex(1, 4)} < 39321 THEN family ELSE {_next('family')} END AS cand_family,
  {_hex(9, 1)} < 11 AS passed, round({_hex(5, 4)}::DOUBLE / 65535, 3) AS score
  FROM (SELECT pair_id, family, candidate_id, md5(pair_id || '|' || candidate_id || '|c1') AS d FROM labels_, range({N_CANDIDATES}) r(candidate_id) WHERE family <> 'Other')
  WHERE {_hex(12, 2)} > 2""",
    "cells": "SELECT family AS gold, CASE WHEN NOT abstain THEN pred_family END AS pred, count(*) AS n FROM pred WHERE input_order = 'ab' GROUP BY ALL",
    "mir": """SELECT a.pair_id, a.family, a.pred_family = a.family AND NOT a.abstain AS oa, b.pred_family = b.family AND NOT b.abstain AS ob,
  a.pred_family = b.pred_family AS same, a.abstain AS aa, b.abstain AS ab,
  a.pred_direction = a.direction AS da, b.pred_direction = b.direction AS db
  FROM pred a JOIN pred b ON a.pair_id = b.pair_id AND a.input_order = 'ab' AND b.input_order = 'ba'""",
    "rs": """SELECT pair_id, family, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT pair_id, family, row_number() OVER (PARTITION BY family ORDER BY md5('split-1|' || pair_id), pair_id) AS r, count(*) OVER (PARTITION BY family) AS n
  FROM labels_ WHERE family <> 'Other')""",
    "parts_": """SELECT entity, CASE WHEN r <= floor(n * 0.8) THEN 'train' WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS part
  FROM (SELECT entity, row_number() OVER (ORDER BY md5('split-2|' || entity), entity) AS r, count(*) OVER () AS n
  FROM (SELECT DISTINCT unnest([a_id, b_id]) AS entity FROM labels_))""",
    "wp": "SELECT l.*, a.part AS pa, b.part AS pb FROM labels_ l JOIN parts_ a ON a.entity = a_id JOIN parts_ b ON b.entity = b_id WHERE family <> 'Other'",
    "ec": "SELECT pair_id, family, CASE WHEN pa = 'train' AND pb = 'train' THEN 'train' WHEN pa = 'test' OR pb = 'test' THEN 'test' ELSE 'val' END AS split FROM wp",
    "pc": "SELECT pair_id, family, pa AS split FROM wp WHERE pa = pb",
    "toks": "SELECT DISTINCT " + _ID.format("l_partkey") + " AS entity, l_suppkey AS token FROM lineitem",
    "tset": "SELECT entity, list(token) AS t FROM toks GROUP BY entity",
}


def _list(values) -> str:
    return "[" + ", ".join(_quote(v) for v in values) + "]::VARCHAR[]"


CTES |= {
    "steps_": f"""SELECT pair_id, family, pred_family, abstain, confidence, step_id,
  CASE WHEN step_id = {N_STEPS} THEN 'conclusion' WHEN {_hex(1, 1)} < 7 THEN 'pk_flag' WHEN {_hex(1, 1)} < 13 THEN 'protein' ELSE 'evidence_gap' END AS role,
  [{", ".join(_quote(c) for c in CLAIMS)}][({_hex(2, 1)} % {len(CLAIMS)} + 1)] AS claim, [{", ".join(_list(e) for e in EVIDENCE)}][({_hex(3, 1)} % {len(EVIDENCE)} + 1)] AS evidence,
  CASE WHEN step_id = {N_STEPS} OR {_hex(4, 1)} >= 9 THEN pred_family ELSE family END AS hint, round({_hex(5, 4)}::DOUBLE / 65535, 3) AS score,
  [{", ".join(_list(c) for c in CONTEXTS)}][(('0x' || substr(md5(pair_id || '|x1'), 1, 1))::BIGINT % 2 + 1)] AS context
  FROM (SELECT p.*, k.step_id::INT AS step_id, md5(pair_id || '|' || k.step_id || '|s1') AS d FROM pred p, range(1, {N_STEPS + 1}) k(step_id) WHERE input_order = 'ab')""",
    "expd": f"""SELECT DISTINCT context, list_distinct(flatten(list_transform(context, lambda c: [c, lower(c), upper(c), {_norm('c')}]
  || CASE WHEN regexp_matches(regexp_extract(lower(c), '{FLAG}', 1), '{ENZYME}') THEN [regexp_extract(lower(c), '{FLAG}', 1), upper(regexp_extract(lower(c), '{FLAG}', 1))] ELSE [] END))) AS pool FROM steps_""",
    "cited": f"""SELECT s.*, len(list_filter(evidence, lambda e: list_has_any([e, lower(e), {_bare('e')}, lower({_bare('e')}), {_norm('e')}], pool))) AS hit,
  role NOT IN ('conclusion', 'abstention', 'evidence_gap') AND len(regexp_extract_all(claim, '\\S+')) >= 3 AS counted FROM steps_ s JOIN expd USING (context)""",
    "hints": """SELECT pair_id, arg_max(hint, (n, -first)) AS winner, sum(n)::BIGINT AS n_hints, max(n) AS n_winner FROM (
  SELECT pair_id, hint, count(*) AS n, min(step_id) AS first FROM steps_ WHERE role <> 'conclusion' GROUP BY ALL) GROUP BY pair_id""",
    "ginp": f"""SELECT *, pred_family = family AS ok, CASE WHEN prm0 < 0.95 THEN prm0 END AS prm, round(-(CASE WHEN confidence > 0 THEN confidence * ln(confidence) ELSE 0 END
  + CASE WHEN confidence < 1 THEN (1 - confidence) * ln(1 - confidence) ELSE 0 END), 6) AS entropy
  FROM (SELECT *, round(('0x' || substr(md5(pair_id || '|g1'), 1, 4))::BIGINT::DOUBLE / 65535, 3) AS prm0 FROM pred WHERE input_order = 'ab')""",
}


def query(body: str) -> str:
    """``body`` after the frames that it names, directly or through others."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b{name}\b", text) and name not in need:
                add(CTES[name])
                need.append(name)

    add(body)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in need) + "\n" + body if need else body
