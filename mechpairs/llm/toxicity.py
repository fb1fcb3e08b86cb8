"""Toxicity: a weighted finite-state pattern grammar.

Lexicon: words and word beginnings that toxic documents hold and others do not,
with log-odds weights, learned from labelled rows on top of short seed lists.
They are found by one automaton over the lower-cased text.

Grammar: three small transducers rewrite the classes of a clause's tokens and
are composed into one: negation marks insults and threats in its scope, reported
speech those after a speech verb or in quotes, target those that address
somebody.  What is scored is the matched clause in its reading, not the word:
each reading has its own weight, fitted on the labelled rows.

Everything learned comes from at most ``MAX_LABELLED`` labelled documents outside
the held-out fold; scoring is one pass over all whole texts without a shuffle.

Defined results: null and empty texts, like all texts without a match, get the
score of no match; without labels of both kinds only the seeds count; repeated
rows are scored one by one; ids of any type are handed through, a null one has no fold
(``held_out`` is null) and is never learned from; of several rows of one id the least text
is learned from; columns other than the text are never inputs, and one named
``toxic_score`` gives way to the score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod4, durable, learning_rows, read_table, with_column

MAX_LABELLED = 6000
ACCEPT = 0.3
PREFIXES = range(3, 8)
MIN_DOCS = 3
MIN_ODDS = math.log(20)

WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;\n]")

# Seed lists of the transducers.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "imbecile", "dummkopf", "crétin", "estúpido")
THREATS = ("kill", "destroy", "hurt", "töten", "tuer", "matar")
TARGETS = frozenset("you your yours he she they them this these du ihr dein sie tu vous ton il elle tú usted ellos".split())
NEGATIONS = frozenset("not no never nor isn aren don nicht kein keine nie ne pas jamais nunca jamás".split())
REPORTS = frozenset("said says wrote claimed called quoted sagte schrieb dit écrit dijo escribió".split())


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol); others pass unchanged."""

    start: object
    arcs: dict[tuple[object, str], tuple[object, str]]

    def step(self, state: object, symbol: str) -> tuple[object, str]:
        return self.arcs.get((state, symbol), (state, symbol))

    def run(self, symbols: str) -> str:
        state, out = self.start, []
        for s in symbols:
            state, o = self.step(state, s)
            out.append(o)
        return "".join(out)


#: Token classes: insult, threat, target, negation, report, quote, word.
ALPHABET = "ityrnqwNRTHV"


def compose(a: Transducer, b: Transducer, alphabet: str = ALPHABET) -> Transducer:
    """One transducer that reads a's input and writes b's output."""
    start = (a.start, b.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            sa, mid = a.step(state[0], symbol)
            sb, out = b.step(state[1], mid)
            arcs[state, symbol] = ((sa, sb), out)
            if (sa, sb) not in seen:
                seen.add((sa, sb))
                todo.append((sa, sb))
    return Transducer(start, arcs)


def negation(scope: int = 3) -> Transducer:
    """Insults (i) and threats (t) up to ``scope`` tokens after a negation: N."""
    arcs = {(k, "n"): (scope, "n") for k in range(scope + 1)}
    for k in range(1, scope + 1):
        arcs |= {(k, "i"): (k - 1, "N"), (k, "t"): (k - 1, "N")} | {(k, s): (k - 1, s) for s in "wyrq"}
    return Transducer(0, arcs)


def reported() -> Transducer:
    """Those after a speech verb, or inside quotes: R."""
    arcs = {("out", "r"): ("said", "r"), ("out", "q"): ("in", "q"), ("said", "q"): ("in", "q"), ("in", "q"): ("out", "q")}
    return Transducer("out", arcs | {(at, s): (at, "R") for at in ("said", "in") for s in "it"})


def targeted() -> Transducer:
    """Insults to somebody: T; threats: V to somebody, H otherwise."""
    arcs = {("none", "y"): ("some", "y"), ("none", "t"): ("none", "H")}
    return Transducer("none", arcs | {("some", "i"): ("some", "T"), ("some", "t"): ("some", "V")})


GRAMMAR = compose(compose(negation(), reported()), targeted())
READINGS = "iTNRHV"
#: Weights of the readings before any label is seen.
PRIOR = np.array([1.0, 1.1, 0.2, 0.4, 0.8, 1.0])
PRIOR_BIAS = -2.5


@dataclass
class Lexicon:
    """weights: of whole words (``word$``) and word beginnings."""

    weights: dict[str, float]
    threats: frozenset[str]

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term in self.weights:
            found.add_word(term.rstrip("$"), None)
        for term in {t.rstrip("$") for t in self.weights}:
            found.add_word(term, term)
        if len(found):
            found.make_automaton()
        return found


def readings(text: object, lexicon: Lexicon, automaton) -> np.ndarray:
    """Sum of lexicon weights for each reading, over the matched clauses."""
    out = np.zeros(len(READINGS))
    if not isinstance(text, str) or not text or not len(automaton):
        return out
    t = text.lower()
    hits: dict[int, float] = {}
    kinds: dict[int, str] = {}
    for end, term in automaton.iter(t):
        start = end - len(term) + 1
        if start and t[start - 1].isalpha():
            continue
        whole = end + 1 == len(t) or not t[end + 1].isalpha()
        w = max(lexicon.weights.get(term, 0.0), lexicon.weights.get(term + "$", 0.0) if whole else 0.0)
        if w > hits.get(start, 0.0):
            hits[start], kinds[start] = w, "t" if term in lexicon.threats else "i"
    todo = sorted(hits)
    ends = [m.start() for m in CLAUSE_END.finditer(t)] if todo else []
    while todo:
        at = todo[0]
        nr = bisect_left(ends, at)
        left = ends[nr - 1] + 1 if nr else 0
        right = ends[nr] if nr < len(ends) else len(t)
        symbols, weights = [], []
        for m in re.finditer(r"[^\W\d_]+|[\"“”«»]", t[left:right]):
            here, word = left + m.start(), m[0]
            if here in hits:
                symbol = kinds[here]
            elif word in TARGETS:
                symbol = "y"
            elif word in NEGATIONS:
                symbol = "n"
            elif word in REPORTS:
                symbol = "r"
            else:
                symbol = "w" if word[0].isalpha() else "q"
            symbols.append(symbol)
            weights.append(hits.get(here, 0.0))
        for reading, w in zip(GRAMMAR.run("".join(symbols)), weights, strict=True):
            if w:
                out[READINGS.index(reading)] += w
        todo = [h for h in todo if h >= right]
    return out


def terms(text: str) -> set[str]:
    out = set()
    for w in set(WORD.findall(text.lower())):
        out.add(w + "$")
        out.update(w[:n] for n in PREFIXES if n <= len(w))
    return out


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms that explain the toxic documents of ``sample(doc_id, text, y)``.

    Counts are made by Spark tasks; all terms with clear odds come to the driver,
    bounded by what the sampled rows hold.  A greedy cover then takes the term
    that explains most toxic documents not explained yet, so words that merely
    travel along with a copied document are left out.  Documents with the same
    terms, such as copies, come to the driver as one set with their number.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, pos = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                found = terms(text if isinstance(text, str) else "")
                n.update(found)
                if y == 1:
                    pos.update(found)
        yield pd.DataFrame({"term": pd.Series(list(n), dtype=object), "n": list(n.values()), "pos": [pos[t] for t in n]})

    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    yes, no = totals["pos"] + 1.0, totals["n"] - totals["pos"] + 1.0
    odds = F.log((F.col("pos") + 0.5) / yes) - F.log((F.col("n") - F.col("pos") + 0.5) / no)
    clear = (
        sample.mapInPandas(count, "term string, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        .where(F.col("pos") >= MIN_DOCS).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS)
        .collect()
    )
    weight = {r["term"]: float(r["odds"]) for r in clear}

    def which(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"terms": [sorted(weight.keys() & terms(t if isinstance(t, str) else "")) for t in batch["text"]]})

    held = (
        sample.where("y = 1").mapInPandas(which, "terms array<string>").where(F.size("terms") > 0)
        .groupBy("terms").agg(F.count("*").alias("n")).collect() if weight else []
    )
    gain: Counter[str] = Counter()
    holders: dict[str, list[int]] = {}
    for k, r in enumerate(held):
        for t in r["terms"]:
            gain[t] += r["n"]
            holders.setdefault(t, []).append(k)
    explained: set[int] = set()
    chosen: dict[str, float] = {}
    while gain:
        best = max(gain, key=lambda t: (gain[t] * weight[t], len(t), t))
        if gain[best] < MIN_DOCS:
            break
        chosen[best] = weight[best]
        for k in set(holders[best]) - explained:
            explained.add(k)
            for t in held[k]["terms"]:
                gain[t] -= held[k]["n"]
                if not gain[t]:
                    del gain[t]
    # Terms as good as the chosen ones where they are about as frequent, so that
    # every insult of a document counts and not only one.
    pos = {r["term"]: r["pos"] for r in clear}
    seen_clean = {r["term"]: r["n"] - r["pos"] for r in clear}
    if chosen:
        floor = 0.2 * min(pos[t] for t in chosen)
        for t in weight:
            if t.endswith("$") and pos[t] >= max(floor, 5 * MIN_DOCS) and not seen_clean[t]:
                chosen.setdefault(t, weight[t])
    for seed in (*INSULTS, *THREATS):
        chosen.setdefault(seed + "$", 1.0)
    return Lexicon(chosen, frozenset(THREATS))


def logistic(x: np.ndarray, y: np.ndarray, strength: float = 0.2) -> tuple[np.ndarray, float]:
    """Newton steps for a logistic model pulled towards PRIOR."""
    a = np.column_stack((x, np.ones(len(x))))
    prior = np.append(PRIOR, PRIOR_BIAS)
    w = prior.copy()
    keep = np.diag(np.append(np.full(x.shape[1], strength), 1e-3))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + keep @ (w - prior)
        hess = (a * (p * (1 - p))[:, None]).T @ a + keep + 1e-6 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return w[:-1], float(w[-1])


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def probability(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.log1p(sums) @ self.weights + self.bias, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, cap: int = MAX_LABELLED) -> Model:
    chosen = learning_rows(labels, "toxic", cap)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = durable(found.groupBy("doc_id", "y").agg(F.min("text").alias("text")))
    lexicon = learn_lexicon(sample)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "r": [readings(t, lexicon, automaton) for t in batch["text"]]})

    rows = sample.mapInPandas(measure, "y int, r array<double>").collect()
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, PRIOR, PRIOR_BIAS)
    x = np.log1p(np.array([r["r"] for r in rows]))
    order = np.lexsort((*x.T, y))
    return Model(lexicon, *logistic(x[order], y[order]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the score of each whole text in ``toxic_score``."""

    def measure():
        automaton = model.lexicon.automaton()

        def scores(texts: list) -> np.ndarray:
            sums = np.array([readings(t, model.lexicon, automaton) for t in texts]).reshape(len(texts), len(READINGS))
            return model.probability(sums)

        return scores

    return with_column(docs, "toxic_score", "double", measure)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (crc_mod4(F.col("doc_id")) == 2).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= ACCEPT).cast("int").alias("predicted"),
    )
