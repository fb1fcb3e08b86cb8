"""Queries over protein flags from actions and prose, with their SQL.

Targets are the distinct lines of a part and a supplier; the four texts of a part are
sentences about a protein that digests choose, a third of them negative examples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pk_flags as pk
from . import frames
from .frames import hex_int
from .registry import register, tokens
from .sql import _list, _quote
from .trace_frames import choose, texts
from .trace_queries import nested

TEXTS = ("metabolism", "pharmacodynamics", "mechanism_of_action", "description")
IDS = (*pk.PROTEINS, "P02768", "P00533")
ALIASES = tuple(n for names in pk.NAMES.values() for n in names)
ACTIONS = (("inhibitor",), ("Inducer", "substrate"), ("metabolised",), ("activator",), (), ("weak inhibitor", "substrate"))
SENTENCES = (
    "It inhibits {p} in vitro.", "A strong inhibitor of hepatic {p} in man", "{p} is slightly inhibited by it.", "Blocks the uptake by the transporter called {p}.", "It induces liver {p}.",
    "{p} are induced.", "Mostly metabolized by the enzyme {p} there", "A {p} substrate.", "Inhibition\tof {p} is not known.", "{p}x is induced", "It has no effect on {p}", "",
)


def written(s: SparkSession, d: str) -> DataFrame:
    """(entity_id, four texts) of the parts."""
    rows = frames.table(s, d, "part").select(frames.entity_id(F.col("p_partkey")).alias("entity_id"))
    for k, name in enumerate(TEXTS):
        x = F.md5(F.concat_ws("|", "entity_id", F.lit(f"t{k}")).cast("binary"))
        sentence = choose(hex_int(x, 1, 2) % len(SENTENCES), [F.lit(t) for t in SENTENCES])
        rows = rows.withColumn(name, F.replace(sentence, F.lit("{p}"), choose(hex_int(x, 3, 2) % len(ALIASES), [F.lit(a) for a in ALIASES])))
    return rows


def targets(s: SparkSession, d: str) -> DataFrame:
    x = F.md5(F.concat_ws("|", "entity", F.col("token").cast("string"), F.lit("ta")).cast("binary"))
    return tokens(s, d).withColumn("x", x).select(
        F.col("entity").alias("entity_id"), choose(hex_int(F.col("x"), 1, 2) % len(IDS), [F.lit(i) for i in IDS]).alias("uniprot"),
        choose(hex_int(F.col("x"), 3, 1) % len(ACTIONS), [texts(a) for a in ACTIONS]).alias("actions"),
    )


def flagged(s: SparkSession, d: str) -> DataFrame:
    return pk.with_text_flags(written(s, d), pk.structured_flags(targets(s, d)), TEXTS)


def _n(v: str, k: int, n: int) -> str:
    return f"('0x' || substr({v}, {k}, {n}))::BIGINT"


def _text(k: int) -> str:
    x = f"md5(entity_id || '|t{k}')"
    return f"replace(({_list(SENTENCES)})[({_n(x, 1, 2)} % {len(SENTENCES)} + 1)], '{{p}}', ({_list(ALIASES)})[({_n(x, 3, 2)} % {len(ALIASES)} + 1)])"


BAG = f"""bag AS (SELECT entity_id, concat_ws(' ', {", ".join(f"nullif({_text(k)}, '')" for k in range(len(TEXTS)))}) AS t FROM (SELECT 'P' || lpad(p_partkey::VARCHAR, 9, '0') AS entity_id FROM part))"""
HELD = f"""held AS (SELECT DISTINCT entity AS entity_id, replace(lower(p), '-', '_') || '_' || kind AS flag FROM (SELECT entity, map({_list(pk.PROTEINS)}, {_list(pk.PROTEINS.values())})[({_list(IDS)})[({_n('x', 1, 2)} % {len(IDS)} + 1)]] AS p,
unnest(list_transform([{", ".join(_list(a) for a in ACTIONS)}][({_n('x', 3, 1)} % {len(ACTIONS)} + 1)], lambda a: CASE WHEN contains(lower(a), 'inhibit') THEN 'inh' WHEN contains(lower(a), 'induc') THEN 'ind' WHEN regexp_matches(a, 'substrate|metabol') THEN 'sub' END)) AS kind
FROM (SELECT *, md5(entity || '|' || token || '|ta') AS x FROM toks)) WHERE p IS NOT NULL AND kind IS NOT NULL)"""
WRITTEN = f"""told AS (SELECT entity_id, unnest(list_filter([{", ".join(f"CASE WHEN regexp_matches(t, {_quote('(?i)' + pk.said(p, k))}) THEN '{c}' END" for c, (p, k) in pk.FLAGS.items())}], lambda f: f IS NOT NULL)) AS flag FROM bag)"""
PK = f"{BAG}, {HELD}, {WRITTEN}, new AS (SELECT * FROM told ANTI JOIN held USING (entity_id, flag))"

register(
    "text_flags", lambda s, d: flagged(s, d).select(
        "entity_id", F.array_join(F.array_sort(F.filter(F.array(*(F.when(F.col(c), c) for c in pk.FLAGS)), F.isnotnull)), ",").alias("flags"), F.array_join(F.array_sort("text_only"), ",").alias("text_only")),
    nested(f"""WITH {PK} SELECT entity_id, coalesce(flags, '') AS flags, coalesce(text_only, '') AS text_only FROM bag
LEFT JOIN (SELECT entity_id, string_agg(flag, ',' ORDER BY flag) AS flags FROM (SELECT * FROM held UNION SELECT * FROM told) GROUP BY entity_id) USING (entity_id)
LEFT JOIN (SELECT entity_id, string_agg(flag, ',' ORDER BY flag) AS text_only FROM new GROUP BY entity_id) USING (entity_id)"""),
)
register("text_flag_counts", lambda s, d: pk.text_only_counts(flagged(s, d)), nested(f"WITH {PK} SELECT flag, count(*) AS n FROM new GROUP BY flag"))
