"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression with the literal tokens it needs.  Token
frequencies are counted over all URLs by a Spark job, each rule is filed under
its rarest token, and a URL fetches only the rules filed under its own tokens
(plus the few rules without a literal token).  Only those run.  Tokens of host and
path count alike; a rule's path gives those that something ends within the rule, as
its last one may be the beginning of a longer token.

Defined results: a null URL or one without ``://`` has an empty host and path
and no rule, and is allowed; repeated rows are judged one by one; ids of
any type are handed through, null included; other columns are ignored.  The rule list is a parameter and does not grow with the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, read_table

TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``name`` is reported where ``listed``; ``rank`` orders rules that fit."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: tuple[int, int]
    listed: bool


def host_rule(verdict: str, target: str) -> Rule:
    """Rule ``host/path``: the host and its subdomains, by path prefix."""
    host, _, rest = target.partition("/")
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}\n{re.escape('/' + rest)}"
    ended = re.findall("[a-z0-9]+(?=[^a-z0-9])", rest)
    return Rule(target, verdict, pattern, (*TOKEN.findall(host), *ended), (1, len(target)), True)


def word_rule(verdict: str, phrase: str) -> Rule:
    """The method's own rule: the words of ``phrase`` in a row in the host."""
    parts = phrase.split("-")
    pattern = rf"^(?:[^\n]*[^a-z0-9\n])?{'[-_.]'.join(map(re.escape, parts))}(?![a-z0-9])[^\n]*\n"
    return Rule(phrase, verdict, pattern, tuple(parts), (0, len(phrase)), False)


# Fixed values of the contract.
LISTED = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
SPAM_HOSTS = ("casino-win", "free-bets", "cheap-pills", "online-casino", "adult-cams", "payday-loans")
RULES = tuple(host_rule(*x) for x in LISTED) + tuple(word_rule("block", x) for x in SPAM_HOSTS)
DEFAULT = "allow"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def token_counts(parts: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many URLs hold each token that some rule names."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    rows = (
        parts.select(F.explode(F.array_distinct(F.split(F.concat_ws("\n", "host", "path"), "[^a-z0-9]+"))).alias("token"))
        .where(F.col("token").isin(wanted)).groupBy("token").count().collect()
    )
    return {r["token"]: r["count"] for r in rows}


def index_rules(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules by rarest token, and the rules that have none."""
    by_token: dict[str, list[Rule]] = {}
    always = []
    for rule in rules:
        if rule.tokens:
            rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
            by_token.setdefault(rarest, []).append(rule)
        else:
            always.append(rule)
    return by_token, always


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = DEFAULT) -> DataFrame:
    """Verdict of the best fitting rule for each URL.

    A longer listed rule beats a shorter one, listed rules beat the method's.
    """
    host, path = host_path(F.col("url"))
    parts = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    by_token, always = index_rules(rules, token_counts(parts, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {r: re.compile(r.pattern) for r in rules}
        for batch in batches:
            names, verdicts = [], []
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                place = f"{h}\n{p}"
                tokens = dict.fromkeys(TOKEN.findall(place))
                candidates = [r for t in tokens for r in by_token.get(t, ())] + always
                fits = [r for r in candidates if compiled[r].search(place)]
                best = max(fits, key=lambda r: r.rank, default=None)
                names.append(best.name if best and best.listed else None)
                verdicts.append(best.verdict if best else default)
            made = [pa.array(names, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return parts.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))


def oracle() -> str:
    cases = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{v}:{t}'"
        for v, t in sorted(LISTED, key=lambda x: -len(x[1])) for h, _, p in [t.partition("/")]
    )
    spam = "|".join(x.replace("-", "[-_.]") for x in SPAM_HOSTS)
    return f"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{UPPER.lower()}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {cases} END AS hit FROM b)
SELECT page_id, host, path, nullif(split_part(coalesce(hit, ''), ':', 2), '') AS rule,
  CASE WHEN hit IS NOT NULL THEN split_part(hit, ':', 1)
       WHEN regexp_matches(host, '(^|[^a-z0-9])({spam})([^a-z0-9]|$)') THEN 'block' ELSE '{DEFAULT}' END AS verdict
FROM c"""
