"""Secret scans: who else owns this value?

Patterns propose spans in every whole text; each span's value is hashed, and the hash is
counted over the corpus by the distinct repositories and owners that hold it.  A value
that many owners hold is a copied example; one that few hold and that looks like a real
credential is live.  Base spans (the contract's three kinds) always stay and carry their
verdict; spans of the method's own patterns are added where they are live and apart from
every base span.

All of it is SQL expressions, joins and windows.  Texts are read once; what goes on is
one row for each span.

*Skew.*  Values are counted in two steps, by (value, owner, repository) and then by value,
so every step is summed before it is shuffled.  Counts go back to the spans by a join:
values with more than 1 / ``HOT`` of all spans (fewer than ``HOT`` of them, whatever the
corpus) are broadcast, and no other value has more rows than that share.

Defined results: null and empty texts have no spans; repeated rows are scanned one by one
and count once for their owner; ids are handed through, null included; a null owner or
repository is a name like any other; positions are code points, end exclusive; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, let, read_table, tallied

BASE_KINDS = ("assign", "access", "hex")
MORE_KINDS = ("pem", "url", "github", "slack", "stripe", "google", "jwt", "token")
KINDS = BASE_KINDS + MORE_KINDS

#: Owners from which on a value is a copied example; see ``HOT`` in the module's text.
WIDE_OWNERS = 3
HOT = 1000
#: Array elements that are summed by appending; longer arrays go by blocks of it.
BLOCK = 256

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Patterns of the kinds.  Runs too short to count are left out where no other match can
#: begin inside them, which gives the contract's matches.
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
#: The method's own proposals: key blocks, credentials in a URL, long opaque tokens.
MORE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]*"
    r"|://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/:@]{3,128}@"
    r"|[A-Za-z0-9_+/=-]{20,}(\.[A-Za-z0-9_-]+)*"
)
#: First signs of a proposal by kind, in the order in which they are tried.
SIGNS = {
    "pem": "^-----BEGIN", "url": "^://", "github": "^gh[pousr]_", "slack": "^xox[abprs]-", "stripe": "^[rs]k_live_",
    "google": "^AIza", "jwt": r"^eyJ[^.]*\.eyJ[^.]*\.",
}
#: Words of values that stand for a secret and are none.
STAND_INS = "example|sample|dummy|changeme|change_me|placeholder|your|xxxx|0123456|1234567|abcdefg"
SHORTEST, LONGEST = 12, 8192


def running(lengths: Column) -> Column:
    """array<bigint>: the sum of the lengths before each element.

    Appending costs the square of an array, so sums are formed in blocks.
    """
    none = F.array().cast("array<bigint>")

    def before(xs: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
        return F.aggregate(xs, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    starts = F.sequence(F.lit(1), F.size(lengths), F.lit(BLOCK))

    def shifted(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, before(totals), lambda b, t: F.transform(before(b), lambda x: x + t)))

    return F.when(F.size(lengths) > 0, let(F.transform(starts, lambda s: F.slice(lengths, s, F.lit(BLOCK))), shifted)).otherwise(none)


def located(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches, in time linear in the text."""
    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")

    def place(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))

        def spans(p: Column) -> Column:
            ends = running(F.transform(p, lambda x: (x["g"] + F.length(x["m"])).cast("bigint")))
            return F.zip_with(p, ends, lambda x, at: F.struct((at + x["g"]).alias("s"), (at + x["g"] + F.length(x["m"])).alias("e"), x["m"].alias("m")))

        return let(steps, spans)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) > 0, place(f)).otherwise(none))


def live_looking(value: Column) -> Column:
    """Letters and digits, many different signs, and no stand-in."""
    signs = F.size(F.array_distinct(F.split(F.substring(value, 1, LONGEST), "")))
    length = F.length(value)
    return (
        length.between(SHORTEST, LONGEST) & value.rlike("[A-Za-z]") & value.rlike("[0-9]")
        & (3 * signs >= F.least(length, F.lit(24))) & ~F.lower(value).rlike(STAND_INS)
    )


def candidates(text: Column) -> Column:
    """array<struct<k, s, e, h, live>> of all proposals: kind number, place, hash of the
    value, and whether it looks live."""

    def described(kind: Column, x: Column, value: Column) -> Column:
        return F.struct(kind.cast("int").alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.md5(value).alias("h"), live_looking(value).alias("live"))

    def base(k: int, kind: str) -> Column:
        if kind != "assign":
            return F.transform(located(text, PATTERNS[kind]), lambda x: described(F.lit(k), x, x["m"]))
        held = F.filter(located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 8)
        return F.transform(held, lambda x: described(F.lit(k), x, F.regexp_extract(x["m"], ASSIGN, 2)))

    def own_kind(m: Column) -> Column:
        out = F.lit(KINDS.index("token"))
        for kind, sign in reversed(SIGNS.items()):
            out = F.when(m.rlike(sign), F.lit(KINDS.index(kind))).otherwise(out)
        return out

    more = F.filter(located(text, MORE), lambda x: live_looking(x["m"]))
    return F.concat(*(base(k, kind) for k, kind in enumerate(BASE_KINDS)), F.transform(more, lambda x: described(own_kind(x["m"]), x, x["m"])))


def ownership(spans: DataFrame) -> DataFrame:
    """(h, n, n_repos, n_owners): spans, distinct repositories and owners of each value."""
    return (
        spans.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"))
        .groupBy("h", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("n_repos"))
        .groupBy("h").agg(F.sum("n").alias("n"), F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"))
    )


def judged(spans: DataFrame, total: int) -> DataFrame:
    """``spans`` with n_repos and n_owners of their values."""
    counts = durable(ownership(spans))
    hot = counts.where(F.col("n") * HOT > total)
    keys = F.broadcast(hot.select("h"))
    often = spans.join(F.broadcast(hot.drop("n")), "h")
    return often.unionByName(spans.join(keys, "h", "left_anti").join(counts.where(F.col("n") * HOT <= total).drop("n"), "h"))


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, wide: int = WIDE_OWNERS) -> DataFrame:
    """(doc_id, spans) of every row, spans by start, then kind as listed:
    array<struct<start, kind, end, base, verdict, n_owners, n_repos>>.

    The verdict is ``example`` for a value of ``wide`` owners or more, ``live`` for another
    that looks live, else ``weak``.  The owner is ``source`` where none is named, the
    repository the owner's documents of one ``lang``.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.col("lang") if repository is None else repository
    found, total = tallied(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", owner.cast("string").alias("owner"), repository.cast("string").alias("repo"),
            let(F.coalesce("text", F.lit("")), candidates).alias("c"),
        ),
        F.sum(F.size("c")),
    )
    spans = judged(found.select("row", "owner", "repo", F.inline("c")), total)
    base = F.col("k") < len(BASE_KINDS)
    by_start = Window.partitionBy("row").orderBy("s", "k").rowsBetween(Window.unboundedPreceding, -1)
    by_end = Window.partitionBy("row").orderBy(F.desc("s"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.select(
        "*", F.max(F.when(base, F.col("e"))).over(by_start).alias("left"), F.min(F.when(base, F.col("s"))).over(by_end).alias("right"),
    )
    apart = (F.coalesce("left", F.lit(0)) <= F.col("s")) & (F.coalesce("right", F.col("e")) >= F.col("e"))
    verdict = F.when(F.col("n_owners") >= wide, "example").when(F.col("live"), "live").otherwise("weak")
    names = F.array(*(F.lit(k) for k in KINDS))
    kept = placed.withColumn("verdict", verdict).where(base | (apart & (F.col("verdict") == "live")))
    lists = kept.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        F.col("s").alias("start"), "k", F.get(names, F.col("k")).alias("kind"), F.col("e").alias("end"), base.alias("base"), "verdict", "n_owners", "n_repos",
    ))).alias("spans"))
    none = F.array().cast(lists.schema["spans"].dataType)
    return found.select("row", "doc_id").join(lists, "row", "left").select(
        "doc_id", F.transform(F.coalesce("spans", none), lambda x: x.dropFields("k")).alias("spans")
    )


def text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read_table(spark, sf_dir, "documents"))

    def number(field: str, value: str) -> Column:
        return F.size(F.filter("spans", lambda x: x[field] == value)).cast("long")

    return out.select(
        "doc_id", *(number("kind", k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(text_of(F.filter("spans", lambda x: x["base"])), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"),
        number("verdict", "live").alias("n_live"), number("verdict", "example").alias("n_example"),
    )


def oracle() -> str:
    def quoted(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    patterns = [*((k, PATTERNS[kind]) for k, kind in enumerate(BASE_KINDS)), (len(BASE_KINDS), MORE)]
    found = " UNION ALL ".join(
        f"SELECT row, owner, repo, {k} AS p, unnest(regexp_extract_all(text, {quoted(x)})) AS m, unnest(regexp_split_to_array(text, {quoted(x)})[:-2]) AS g, "
        f"generate_subscripts(regexp_extract_all(text, {quoted(x)}), 1) AS i FROM d" for k, x in patterns
    )
    kinds = " ".join(f"WHEN regexp_matches(m, {quoted(sign)}) THEN {KINDS.index(kind)}" for kind, sign in SIGNS.items())
    names = "[" + ", ".join(quoted(k) for k in KINDS) + "]"
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, kind in enumerate(BASE_KINDS))
    shown = f"concat_ws(':', {names}[k + 1], s, e)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source AS owner, lang AS repo, coalesce(text, '') AS text FROM documents),
f AS ({found}),
l AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY row, p ORDER BY i) AS e FROM f),
v AS (SELECT row, owner, repo, p, m, e - length(m) AS s, e, CASE WHEN p = 0 THEN regexp_extract(m, {quoted(ASSIGN)}, 2) ELSE m END AS v FROM l),
x AS (SELECT *, CASE WHEN p < 3 THEN p {kinds} ELSE {KINDS.index("token")} END AS k,
  length(v) BETWEEN {SHORTEST} AND {LONGEST} AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')
  AND 3 * len(list_distinct(string_split(v, ''))) >= least(length(v), 24) AND NOT regexp_matches(lower(v), '{STAND_INS}') AS live FROM v),
c AS (SELECT * FROM x WHERE CASE p WHEN 0 THEN length(v) >= 8 WHEN 3 THEN live ELSE true END),
o AS (SELECT v, count(DISTINCT coalesce(owner, ' null')) AS n_owners FROM c GROUP BY v),
j AS (SELECT c.*, CASE WHEN n_owners >= {WIDE_OWNERS} THEN 'example' WHEN live THEN 'live' ELSE 'weak' END AS verdict FROM c JOIN o USING (v)),
b AS (SELECT row, s, e FROM j WHERE p < 3),
k AS (SELECT * FROM j WHERE p < 3 OR (verdict = 'live' AND NOT EXISTS (SELECT 1 FROM b WHERE b.row = j.row AND b.s < j.e AND j.s < b.e))),
r AS (SELECT row, {counts}, string_agg({shown}, ',' ORDER BY s, k) FILTER (p < 3) AS base, string_agg({shown}, ',' ORDER BY s, k) AS spans,
  count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example') AS n_example FROM k GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN r USING (row)"""
