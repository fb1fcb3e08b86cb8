"""PII: weak supervision over span candidates.

Patterns propose spans (mail addresses, IPv4 addresses, card and phone numbers,
secrets).  Labelers vote on each: a strict format check, gazetteers, context
words, and the span's surroundings.  Expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is; the posteriors then train
a final classifier on span features, which decides which further spans are
added.  Spans that the contract's base rules find always stay.

All of it is SQL expressions.  Texts are read once; what goes on is the array of
candidates of each document.  The EM sees one row per vote pattern (at most
``5 * 3**4``), the classifier one row per feature value, whatever the corpus size.

Defined results: null and empty texts have no spans; repeated rows are treated
one by one; positions are code points, end exclusive; other columns are ignored
(and kept by ``redact``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, let, read_table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
EM_ROUNDS = 25
ACCEPT = 0.5
CONTEXT = 40

#: Same matches as the contract's patterns.  Possessive runs and the look-behind
#: (or the end of the last match) keep the search linear in long runs; runs too
#: short to pass the digit count are left out.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}+(?![A-Za-z0-9_])",
}
#: A sign without which a text cannot hold the kind.
NEEDS = {"email": "@", "phone": "+"}

# Gazetteers and context words of the labelers.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")
SECRET_NAMES = ("password", "passwd", "token", "secret", "api_key", "apikey", "key")
CUES = {
    "email": "mail|contact|write|e-mail|correo|kontakt",
    "ip": "ip|server|host|address|login|from",
    "card": "card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|anruf|appel",
    "secret": "password|passwd|token|secret|api_?key|auth",
}


def matches(text: Column, kind: str) -> Column:
    """array<struct<s, e, m>> of the leftmost non-overlapping matches."""
    pattern = PATTERNS[kind]

    def place(found: Column) -> Column:
        # Texts before, between and after the matches give their places.
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["g"]
            e = s + F.length(x["m"])
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

        pairs = F.arrays_zip(found.alias("m"), gaps.alias("g"))
        return F.aggregate(F.slice(pairs, F.lit(1), F.size(found)), zero, step)["out"]

    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) > 0, place(f)).otherwise(none))
    need = NEEDS.get(kind)
    return F.when(F.contains(text, F.lit(need)), found).otherwise(none) if need else found


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    ds = F.array_remove(F.split(F.reverse(digits(m)), ""), "")
    total = F.aggregate(
        F.transform(ds, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int"))),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The contract's check of a match; no base span of kind ``secret``."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return (F.length(digits(m)) >= 13) & (F.length(digits(m)) <= 19) & luhn(m)
    if kind == "phone":
        return (F.length(digits(m)) >= 9) & (F.length(digits(m)) <= 15)
    return F.lit(kind == "email")


def strict(kind: str, m: Column) -> Column:
    """Labeler: format beyond the proposal pattern."""
    if kind == "email":
        return m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return valid(kind, m)


def gazetteer(kind: str, m: Column, before: Column) -> Column:
    """Labeler: 1 known, 0 unknown, null where there is nothing to look up."""
    if kind == "email":
        return F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(*TOP_DOMAINS)
    if kind == "ip":
        return ~m.rlike(r"^(0|127|22[4-9]|2[3-5][0-9])\.")
    if kind == "card":
        return m.rlike("^[3-6]")
    if kind == "phone":
        return m.rlike(r"^\+[1-9]") | F.lit(None)
    return F.lower(before).rlike("(" + "|".join(SECRET_NAMES) + r")\W{0,5}$") | F.lit(None)


def candidates(text: Column) -> Column:
    """All proposals of a text: kind, place, base flag, votes and features."""

    def describer(k: int, kind: str):
        def describe(x: Column) -> Column:
            m = x["m"]
            start = F.greatest(x["s"] - CONTEXT, F.lit(0))
            before = F.substring(text, start + 1, x["s"] - start)
            after = F.substring(text, x["e"] + 1, F.lit(1))
            clean = ~before.rlike("[A-Za-z0-9_.-]$") & ~after.rlike("[A-Za-z0-9_@]")

            def vote(c: Column) -> Column:
                return F.when(c, F.lit(2)).when(~c, F.lit(0)).otherwise(F.lit(1))

            return F.struct(
                F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), valid(kind, m).alias("base"),
                F.array(
                    vote(strict(kind, m)),
                    vote(gazetteer(kind, m, before)),
                    F.when(F.lower(before).rlike(f"(^|[^a-z])({CUES[kind]})"), F.lit(2)).otherwise(F.lit(1)),
                    vote(clean),
                ).alias("v"),
                F.array(
                    F.concat(F.lit(f"{kind}|len|"), F.least(F.floor(F.length(m) / 4), F.lit(12)).cast("string")),
                    F.concat(F.lit(f"{kind}|dig|"), F.floor(4 * F.length(digits(m)) / F.length(m)).cast("string")),
                    F.concat(F.lit(f"{kind}|hex|"), m.rlike("^[0-9a-f]+$").cast("string")),
                    F.concat(F.lit(f"{kind}|ok|"), strict(kind, m).cast("string")),
                    F.concat(F.lit(f"{kind}|pre|"), F.when(before.rlike(r"[=:]\s?\W?$"), F.lit("assign")).when(clean, F.lit("space")).otherwise(F.lit("glued"))),
                ).alias("f"),
            )

        return describe

    return F.concat(*(F.transform(matches(text, kind), describer(k, kind)) for k, kind in enumerate(KINDS)))


def pattern_key(c: Column) -> Column:
    return F.concat(c["k"].cast("string"), F.lit(":"), F.array_join(c["v"].cast("array<string>"), ""))


def em(counts: DataFrame, rounds: int = EM_ROUNDS, smooth: float = 1.0) -> DataFrame:
    """(key, k, n, post) for each vote pattern, by EM over two hidden classes.

    The start trusts the format check most.  Within a kind, labelers are independent given the class; votes are 0 (no), 1 (abstain) and
    2 (yes).  The state is one struct of arrays that an ``aggregate`` folds.
    """
    n_kinds, n_votes = len(KINDS), 4
    packed = counts.agg(F.array_sort(F.collect_list(F.struct("k", "v", "n"))).alias("ps"))
    ps = F.col("ps")

    def posterior(state: Column, p: Column) -> Column:
        yes, no = F.get(state["prior"], p["k"]), 1 - F.get(state["prior"], p["k"])
        for j in range(n_votes):
            at = 3 * n_votes * p["k"] + 3 * j + F.get(p["v"], j)
            yes, no = yes * F.get(state["p1"], at), no * F.get(state["p0"], at)
        return yes / (yes + no)

    def total(value) -> Column:
        return F.aggregate(F.col("ps"), F.lit(0.0), lambda a, p: a + value(p))

    def step(state: Column, _i: Column) -> Column:
        def fold(posts: Column) -> Column:
            rows = F.transform(ps, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), p["n"].alias("n"), F.get(posts, i).alias("y")))

            def inner(r: Column) -> Column:
                def tot(value) -> Column:
                    return F.aggregate(r, F.lit(0.0), lambda a, p: a + value(p))

                def share(k: int, j: int, v: int, yes: bool) -> Column:
                    def w(p: Column) -> Column:
                        return F.when(p["k"] == k, p["n"] * (p["y"] if yes else 1 - p["y"])).otherwise(0.0)

                    return (tot(lambda p: F.when(F.get(p["v"], j) == v, w(p)).otherwise(0.0)) + smooth) / (tot(w) + 3 * smooth)

                return F.struct(
                    F.array(*((tot(lambda p, k=k: F.when(p["k"] == k, p["n"] * p["y"]).otherwise(0.0)) + smooth)
                              / (tot(lambda p, k=k: F.when(p["k"] == k, p["n"]).otherwise(0.0).cast("double")) + 2 * smooth) for k in range(n_kinds))).alias("prior"),
                    F.array(*(share(k, j, v, True) for k in range(n_kinds) for j in range(n_votes) for v in range(3))).alias("p1"),
                    F.array(*(share(k, j, v, False) for k in range(n_kinds) for j in range(n_votes) for v in range(3))).alias("p0"),
                )

            return let(rows, inner)

        return let(F.transform(ps, lambda p: posterior(state, p)), fold)

    first = F.struct(
        F.array(*(F.lit(0.5) for _ in range(n_kinds))).alias("prior"),
        F.array(*(F.lit(x) for _ in range(n_kinds) for j in range(n_votes) for x in ((0.02, 0.08, 0.9) if j == 0 else (0.1, 0.3, 0.6)))).alias("p1"),
        F.array(*(F.lit(x) for _ in range(n_kinds) for j in range(n_votes) for x in ((0.9, 0.08, 0.02) if j == 0 else (0.6, 0.3, 0.1)))).alias("p0"),
    )
    fitted = packed.select("ps", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step).alias("state"))
    return fitted.select(F.explode(F.transform("ps", lambda p: F.struct(
        F.concat(p["k"].cast("string"), F.lit(":"), F.array_join(p["v"].cast("array<string>"), "")).alias("key"),
        p["k"].alias("k"), p["n"].alias("n"), posterior(F.col("state"), p).alias("post"),
    ))).alias("r")).select("r.*")


def literal_map(values: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for kv in sorted(values.items()) for x in kv)) if values else F.create_map(F.lit(""), F.lit(0.0))


def classifier(found: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log odds by kind and by feature value, from the EM's soft labels.

    Both tables have one entry for each kind or feature value, so they are small
    and the same size for every corpus.
    """
    spans = found.select(F.explode("c").alias("c"))
    counts = spans.groupBy(F.col("c.k").alias("k"), F.col("c.v").alias("v")).agg(F.count("*").cast("double").alias("n"))
    post = {r["key"]: (r["k"], r["n"], r["post"]) for r in em(counts).collect()}
    prior, odds = {}, {}
    for k, kind in enumerate(KINDS):
        mine = [(n, y) for kk, n, y in post.values() if kk == k]
        yes, no = sum(n * y for n, y in mine) + 1, sum(n * (1 - y) for n, y in mine) + 1
        prior[kind] = math.log(yes / no)
        odds[kind] = (yes, no)
    y = F.element_at(literal_map({k: v[2] for k, v in post.items()}), pattern_key(F.col("c")))
    stats = (
        spans.select(F.explode("c.f").alias("f"), y.alias("y"))
        .groupBy("f").agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no")).collect()
    )
    values = {}
    for r in stats:
        yes, no = odds[r["f"].split("|")[0]]
        values[r["f"]] = math.log((r["yes"] + 1) / (yes + 1)) - math.log((r["no"] + 1) / (no + 1))
    return prior, values


def spans(found: DataFrame, prior: dict[str, float], values: dict[str, float], accept: float = ACCEPT) -> DataFrame:
    """``found`` with base and all spans, each by kind as listed, then start.

    An added span needs the classifier's consent and must not overlap a base one.
    """
    kinds = F.array(*(F.lit(prior[k]) for k in KINDS))
    table = literal_map(values)

    def logit(c: Column) -> Column:
        return F.aggregate(c["f"], F.get(kinds, c["k"]), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))

    base = F.filter("c", lambda c: c["base"])
    cut = math.log(accept / (1 - accept))
    more = F.filter("c", lambda c: ~c["base"] & (logit(c) >= cut) & ~F.exists(F.col("base"), lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return found.withColumn("base", base).withColumn("all", F.array_sort(F.transform(F.concat("base", more), lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))))


def text_of(spans_: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans_, lambda c: F.concat_ws(":", F.get(names, c["k"]), c["s"].cast("string"), c["e"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, all) spans of every document."""
    found = durable(docs.select("doc_id", let(F.coalesce("text", F.lit("")), candidates).alias("c")))
    return spans(found, *classifier(found))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(read_table(spark, sf_dir, "documents"))
    kinds_found = F.transform("base", lambda c: c["k"])
    counts = [(F.size(kinds_found) - F.size(F.array_remove(kinds_found, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    return out.select("doc_id", *counts, F.sha2(text_of(F.col("base")), 256).alias("base_sha256"), text_of(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))


def masked(text: Column, all_spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of
    overlapping spans the first leads and the later one's rest goes with it."""
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))
    by_start = F.array_sort(F.transform(all_spans, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        clear = x["s"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(clear, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.get(names, x["k"]))).otherwise(acc["out"]).alias("out"),
        )

    whole = let(F.aggregate(by_start, zero, step), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(all_spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans masked and n_chars brought up to date.

    Candidates are found again in the row that is masked, so no text is
    shuffled; the model comes from the candidates of all documents.
    """
    found = durable(docs.select(let(F.coalesce("text", F.lit("")), candidates).alias("c")).where(F.size("c") > 0))
    prior, values = classifier(found)
    rows = docs.select(F.struct(*docs.columns).alias("row"), let(F.coalesce("text", F.lit("")), candidates).alias("c"))
    hit = F.size("all") > 0
    new = {"text": masked(F.col("row.text"), F.col("all"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(new["text"]).cast("long")).otherwise(F.col("row.n_chars"))
    out = spans(rows, prior, values)
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
