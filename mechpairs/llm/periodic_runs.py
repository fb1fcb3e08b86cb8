"""Periodic runs of words: an online sparse diagonal DP.

A run is a stretch of words that repeats itself with a smallest period ``q``, holds at
least ``REPEATS`` periods and ``SHORTEST`` words, and cannot be made longer.  In the grid
of (word, lag) such a stretch is a diagonal of matches: word ``i`` equals word ``i - q``.
Words come one at a time; every open diagonal grows by the word or ends there, and one
that ends long enough gives its run at once.

*Sparse.*  A word's earlier occurrences open diagonals.  Three exact rules keep the work
of a text of n words at about n log n, whatever it repeats:

- Lags from ``s`` to ``2 * s - 1`` (``s`` a power of two) open only at words whose number
  is a multiple of ``s``, as a run with such a period matches through at least ``3 * s``
  words.  So word ``i`` looks no further back than twice its lowest bit.
- Such a lag opens once its last ``2 * s`` words have matched.  Of two lags of one level
  that have, both stretches repeat with a smaller period, and neither is the smallest of a
  run; hence the nearest is enough, and one open diagonal for each level.
- A stretch whose first period is itself a repetition has a smaller period and is left out.

Texts are independent of each other, so this is one pass over the input without a shuffle
and a lost executor only repeats its own splits.

Defined results: a null or empty text has no words and no runs; repeated rows are treated
one by one, ids are handed through whatever their type, null included; columns other than
the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table, slices, small_batches, words

REPEATS, SHORTEST = 4, 6
ID_BYTES = 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def repeats_itself(block: bytes) -> bool:
    """Whether the words of ``block`` are a shorter block some times over."""
    n = len(block) // ID_BYTES
    return any(n % d == 0 and block[: ID_BYTES * d] * (n // d) == block for d in range(1, n // 2 + 1))


class Diagonals:
    """The open diagonals of one text, at most one for each level of lags."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.coded = ids.tolist(), ids.astype("<u4").tobytes()
        self.open: dict[int, tuple[int, int]] = {}  # level -> (lag, first matching word)
        self.runs: list[tuple[int, int, int]] = []

    def same(self, a: int, b: int, count: int) -> bool:
        """Whether the ``count`` words before and at ``a`` and ``b`` are equal."""
        gram = self.coded[ID_BYTES * (a - count + 1) : ID_BYTES * (a + 1)]
        return self.coded.startswith(gram, ID_BYTES * (b - count + 1))

    def grow(self, i: int) -> None:
        """Every open diagonal takes in word ``i`` or ends before it."""
        for level, (lag, first) in list(self.open.items()):
            if i == len(self.ids) or self.ids[i] != self.ids[i - lag]:
                del self.open[level]
                self.close(lag, first, i)

    def close(self, lag: int, first: int, end: int) -> None:
        start, length = first - lag, end - first + lag
        if length >= max(SHORTEST, REPEATS * lag) and not repeats_itself(self.coded[ID_BYTES * start : ID_BYTES * first]):
            self.runs.append((start, length, lag))

    def look_back(self, i: int, earlier: list[int]) -> None:
        """Open the diagonals that ``earlier``, the word's occurrences before ``i``, offer."""
        step, bit = 1, i & -i
        while step <= bit and i - earlier[0] >= step:
            k = bisect_right(earlier, i - step) - 1
            while k >= 0 and (lag := i - earlier[k]) < 2 * step and earlier[k] >= 2 * step - 1:
                if self.same(i, earlier[k], 2 * step):
                    if self.open.get(step, (0, 0))[0] != lag:
                        self.start(step, lag, i)
                    break
                k -= 1
            step *= 2

    def start(self, step: int, lag: int, i: int) -> None:
        """Open ``lag`` from its first match on.  Had it matched ``2 * step`` words at the
        level's last stop too, a nearer lag did as well, and it is no smallest period."""
        first, least = i - 2 * step + 1, max(lag, i - 3 * step + 2)
        while first > least and self.ids[first - 1] == self.ids[first - 1 - lag]:
            first -= 1
        if first > lag and self.ids[first - 1] == self.ids[first - 1 - lag]:
            self.open.pop(step, None)
        else:
            self.open[step] = (lag, first)


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, in order."""
    found = Diagonals(ids)
    places: dict[int, list[int]] = {}
    for i, word in enumerate(found.ids):
        if found.open:
            found.grow(i)
        earlier = places.get(word)
        if earlier is None:
            places[word] = [i]
        else:
            if i - earlier[-1] < 2 * (i & -i):
                found.look_back(i, earlier)
            earlier.append(i)
    found.grow(len(found.ids))
    return sorted(found.runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those in no run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def collapse(text: bytes | None) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """Number of words, runs, and the kept words joined by a space.  ``bytes.split``
    separates at exactly the contract's six white signs."""
    tokens = (text or b"").split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.uint32, len(tokens))
    runs = find_runs(ids) if len(number) < len(tokens) else []
    if runs:
        kept = kept_words(len(tokens), runs)
        return len(tokens), runs, b" ".join(t for t, k in zip(tokens, kept.tolist(), strict=True) if k)
    return len(tokens), runs, b" ".join(tokens)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every whole text."""
    small_batches(docs.sparkSession)
    names = ("start", "length", "period")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = [collapse(t.as_py()) for t in batch.column(1)]
            table = np.array([r for _, runs, _ in out for r in runs], np.int64).reshape(-1, 3)
            ends = pa.array(np.cumsum([0, *(len(runs) for _, runs, _ in out)]), pa.int32())
            structs = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _, _ in out], pa.int64()), pa.ListArray.from_arrays(ends, structs),
                 pa.array([c.decode() for _, _, c in out], pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the contract: where crc32(doc_id) ends in 0, the words from some
    place on repeat a stretch of it.  Rows without an id keep their text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p)))

    text = let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " ")).otherwise(F.lit("")))
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(read_table(spark, sf_dir, "documents")))
    none = F.lit(None).cast(RUNS[6:-1])

    def better(a: Column, b: Column) -> Column:
        """The run of the greater length / period; runs come by start, then period."""
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    best = found.withColumn("best", F.aggregate("runs", none, better))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
