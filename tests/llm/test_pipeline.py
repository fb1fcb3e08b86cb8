"""Stages of the corpus pipeline against plain Python."""

import random

import pytest

import corpus_pipeline
from mechpairs.llm import ngram_join

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOC).repartition(3)


def shingles(text, k):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(rows, k, num, den):
    """Least id of each id's component, from all pairs."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and den * len(a & b) >= num * len(a | b):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: find(i) for i in root}


def edited(rng, words, n):
    """``words`` with n words replaced by new ones."""
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**9)}"
    return out


def near_copies():
    """Texts of many sizes, each with copies of 0.7 to 1 on five-word shingles."""
    rng, rows = random.Random(7), []
    for n in (6, 12, 30, 60, 100, 250, 700):
        for _ in range(4):
            base = [f"w{rng.randrange(10**9)}" for _ in range(n)]
            rows += [base, base + base[: n // 5], edited(rng, base, 1), edited(rng, base, max(1, n // 50)), base[n // 8 :], base[n // 4 :]]
    rng.shuffle(rows)
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize("k, num, den", [(5, 80, 100), (4, 85, 100)])
def test_join_at_other_thresholds(spark, k, num, den):
    rows = near_copies()
    got = {r.doc_id: r.component_id for r in ngram_join.join_documents(table(spark, rows), k, num, den).collect()}
    assert got == components(rows, k, num, den)


def test_near_duplicates_take_five_words_and_080(spark):
    words = [f"w{i}" for i in range(100)]
    other = [f"v{i}" for i in range(100)]
    changed = [*words[:30], "x", *words[31:60], "y", *words[61:]]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(other)), (4, " ".join([*other, *(f"u{i}" for i in range(20))]))]
    got = corpus_pipeline.near_duplicates(spark, table(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


def prose(seed, n=40):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b, c, d, big = prose("a"), prose("b"), prose("c"), prose("d"), 2**60 + 1
    rows = [
        (5, a), (5, a), (5, b), (3, b), (None, c), (None, c + " end"), (None, b), (None, d), (big, c + " stop"), (-4, prose("e")),
        (None, ""), (None, None), (None, ""), (7, ""), (7, ""), (8, " \n"),
    ]
    got = corpus_pipeline.near_duplicates(spark, table(spark, rows), "").select("doc_id", "text").collect()
    want = [(5, a), (3, b), (None, d), (big, c + " stop"), (-4, prose("e")), (None, ""), (None, None), (None, ""), (7, ""), (8, " \n")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_join_with_null_and_repeated_ids(spark):
    a, b, c, big = prose("a"), prose("b"), prose("c"), 2**60 + 1
    rows = [(5, a), (5, b), (5, ""), (3, b + " end"), (big, a + " end"), (None, c), (None, ""), (9, c), (10, c), (4, None)]
    got = ngram_join.join_documents(table(spark, rows)).collect()
    n = [37, 37, 0, 38, 38, 37, 0, 37, 37, 0]
    want = [(i, k, comp) for (i, _), k, comp in zip(rows, n, [3, 3, 3, 3, 3, None, None, 9, 9, 4], strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
