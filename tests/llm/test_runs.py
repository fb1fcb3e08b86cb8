"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from mechpairs.llm import periodic_runs as pr


def brute(w):
    """Every maximal stretch of each period that is long enough and has no smaller one."""
    n, out = len(w), []
    for q in range(1, n):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            first = i
            while i < n and w[i] == w[i - q]:
                i += 1
            start, length = first - q, i - first + q
            smaller = any(all(w[k] == w[k - d] for k in range(start + d, start + length)) for d in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90))
def test_random_words(ids):
    assert pr.find_runs(np.array(ids, np.uint32)) == brute(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 8)), max_size=6))
def test_planted_words(parts):
    ids = [x for block, times, rest in parts for x in block * times + block[:rest]]
    assert pr.find_runs(np.array(ids, np.uint32)) == brute(ids)


def test_long_texts_end_soon():
    rng = random.Random(5)
    for ids in (
        [7] * 200_000,
        list(range(1000)) * 300,
        [rng.randrange(2) for _ in range(200_000)],
        [x for _ in range(400) for x in [0] * rng.randrange(900) + [1]],
    ):
        runs = pr.find_runs(np.array(ids, np.uint32))
        assert len(set(runs)) == len(runs)
    assert pr.find_runs(np.zeros(200_000, np.uint32)) == [(0, 200_000, 1)]
    assert pr.find_runs(np.array(list(range(1000)) * 300, np.uint32)) == [(0, 300_000, 1000)]


def whole(doc_id, text):
    w = [x for x in (text or "").replace("\x1f", "_u_").translate({k: " " for k in range(9, 14)}).split(" ") if x]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    w = [x.replace("_u_", "\x1f") for x in w]
    return (
        doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(collapsed(w, runs).encode()).hexdigest(),
    )


def test_query_by_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(2**60 + 1, "a b " * 9, "x"), (None, "c " * 7, "x"), (2**60 + 3, None, None), (5, "", "x"), (5, "", "x"), (6, " \t\x0b ", "x"), (7, "a\x1fb a\x1fb a\xa0b " * 4, "ä")]
    for k in range(400):
        vocab = rng.choice(["ab", "abc", "abcdefghijkl"])
        rows.append((k, rng.choice([" ", "\n", " \t"]).join(rng.choice(vocab) for _ in range(rng.randrange(60))), "y"))
    schema = "doc_id long, text string, runs string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, pr.op11_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    want = sorted((whole(i, t) for i, t, _ in rows), key=repr)
    assert got == want


def test_empty_table_and_text_ids(spark):
    assert pr.periodic_runs(spark.createDataFrame([], "doc_id string, text string")).collect() == []
    got = pr.periodic_runs(spark.createDataFrame([("k", "a b a b a b a b c")], "doc_id string, text string")).first()
    assert (got.doc_id, got.n_words, [tuple(r) for r in got.runs], got.collapsed) == ("k", 9, [(0, 8, 2)], "a b c")
