"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages.  Every passage is encoded by the shape of its
text, gated attention weighs the passages, and the weighted mean of their
encodings gives the document's score.  Only document labels are used.

The model is fitted on at most ``MAX_LABELLED`` labelled documents outside the
held-out fold (the rows with the smallest hash of doc_id); their passages are
encoded by Spark tasks and the small network is trained on the driver.  Scoring
is one pass over all whole texts without a shuffle.

Defined results: null and empty texts are one passage without words and get a
score like any other; without labels of both kinds every score is 1 (nothing is
rejected); repeated rows are scored one by one; ids of any type are handed through, a null
one has no fold (``held_out`` is null) and is never learned from; of several rows of one
id the least text is learned from; columns other than the text are never inputs of a
score, and one named ``quality_score`` gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import crc_mod4, learning_rows, read_table, with_column

PASSAGE = 48
MAX_LABELLED = 4000
ACCEPT = 0.7
HIDDEN, GATE = 12, 8
EPOCHS, RATE, DECAY = 250, 0.03, 1e-4

_CLASS = np.zeros((256, 6), np.float64)  # upper, digit, symbol, sentence sign, other ASCII sign, bar
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = (
        _c.isupper(), _c.isdigit(), _c in "#*$%&<>", _c in ".,;:?", not (_c.isalnum() or _c.isspace() or _c in "#*$%&<>.,;:?|"), _c == "|",
    )
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BYTE = (np.random.RandomState(7).randint(1, 2**62, 256) * 2 + 1).astype(np.uint64)


def passages(text: object, size: int = PASSAGE) -> np.ndarray:
    """(passages, features) of a whole text."""
    raw = np.frombuffer((text if isinstance(text, str) else "").encode("utf-8", "surrogatepass"), np.uint8)
    at = np.flatnonzero(~_SPACE[raw])
    if not len(at):
        return np.zeros((1, 14))
    starts = np.concatenate(([0], np.flatnonzero(np.diff(at) > 1) + 1))
    lengths = np.diff(np.append(starts, len(at))).astype(float)
    chars = raw[at]
    per_word = np.add.reduceat(_CLASS[chars], starts, axis=0)
    within = np.arange(len(at)) - np.repeat(starts, lengths.astype(int))
    h = np.add.reduceat(_BYTE[chars] * (within.astype(np.uint64) * np.uint64(2) + np.uint64(1)) ** np.uint64(3), starts)
    n = len(starts)
    same = np.concatenate(([False], h[1:] == h[:-1])).astype(float)
    # Words of windows that the text has held before.
    pair = h * _PRIME + np.concatenate((h[1:], h[-1:]))
    _, first, back = np.unique(pair, return_index=True, return_inverse=True)
    again = (first[back] != np.arange(n)).astype(float)
    new_line = np.concatenate(([0.0], np.add.reduceat((raw == 10).astype(float), at[starts])[:-1] > 0)) if n > 1 else np.zeros(1)
    edges = np.arange(0, n, size)
    count = np.diff(np.append(edges, n)).astype(float)
    signs = np.add.reduceat(per_word, edges, axis=0)
    size_chars = np.add.reduceat(lengths, edges)
    mean = lambda x: np.add.reduceat(x, edges) / count
    owner = np.repeat(np.arange(len(edges)), count.astype(int))
    order = np.lexsort((h, owner))
    fresh = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])))
    distinct = np.bincount(owner[order], fresh, len(edges)) / count
    only_signs = (per_word[:, 2:].sum(axis=1) == lengths).astype(float)
    return np.column_stack((
        signs / size_chars[:, None], np.log1p(size_chars / count), distinct, mean(same), mean(again), mean(new_line), mean(only_signs),
        np.log1p(count), np.log1p(np.maximum.reduceat(lengths, edges)),
    ))


@dataclass
class Model:
    """Gated attention network; ``scale`` holds feature means and spreads."""

    scale: tuple[np.ndarray, np.ndarray]
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, edges: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        v, u = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        s = np.clip((v * u) @ p["a"], -30, 30)
        counts = np.diff(np.append(edges, len(x)))
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, edges), counts))
        att = e / np.repeat(np.add.reduceat(e, edges), counts)
        z = np.add.reduceat(h * att[:, None], edges, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["o"] + p["c"], -30, 30)))
        return {"h": h, "v": v, "u": u, "att": att, "z": z, "y": y, "counts": counts}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        mean, spread = self.scale
        edges = np.cumsum([0, *(len(b) for b in bags[:-1])])
        return self.forward((np.vstack(bags) - mean) / spread, edges)["y"]


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Full-batch Adam on the class-balanced log loss."""
    x = np.vstack(bags)
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / spread
    edges = np.cumsum([0, *(len(b) for b in bags[:-1])])
    rng = np.random.RandomState(1)
    d = x.shape[1]
    draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
    p = {"w": draw(d, HIDDEN), "b": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "a": draw(GATE), "o": draw(HIDDEN), "c": np.zeros(1)}
    model = Model((mean, spread), p)
    weight = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1))
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, epochs + 1):
        f = model.forward(x, edges)
        dy = (f["y"] - labels) * weight
        g = {"o": f["z"].T @ dy, "c": np.array([dy.sum()])}
        dz = np.repeat(dy[:, None] * p["o"], f["counts"], axis=0)
        dot = (dz * f["h"]).sum(axis=1)
        ds = f["att"] * (dot - np.repeat(np.add.reduceat(dot * f["att"], edges), f["counts"]))
        g["a"] = (f["v"] * f["u"]).T @ ds
        dv, du = ds[:, None] * p["a"] * f["u"] * (1 - f["v"] ** 2), ds[:, None] * p["a"] * f["v"] * f["u"] * (1 - f["u"])
        g["v"], g["u"] = f["h"].T @ dv, f["h"].T @ du
        dh = (dz * f["att"][:, None] + dv @ p["v"].T + du @ p["u"].T) * (1 - f["h"] ** 2)
        g["w"], g["b"] = x.T @ dh, dh.sum(axis=0)
        for k in p:
            grad = g[k] + DECAY * p[k]
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.999 * m2[k] + 0.001 * grad**2
            p[k] -= RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, cap: int = MAX_LABELLED) -> Model | None:
    """Model from at most ``cap`` labelled documents; None without both labels."""
    order = F.col("doc_id").cast("string")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):  # numbers come in their own order
        order = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [passages(t) for t in batch["text"]]
            yield pd.DataFrame({"doc": batch["doc"], "y": batch["y"], "bag": [b.ravel() for b in bags]})

    chosen = docs.select("doc_id", "text").join(F.broadcast(learning_rows(labels, "quality", cap)), "doc_id")
    once = chosen.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select(order.alias("doc"), "y", "text")
    rows = once.mapInPandas(encode, "doc string, y int, bag array<double>").toPandas().sort_values("doc", kind="stable")
    y = rows["y"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return None
    return train([np.asarray(b).reshape(-1, 14) for b in rows["bag"]], y)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with the score of each whole text in ``quality_score``."""

    def scores(texts: list) -> np.ndarray:
        out = np.ones(len(texts))
        if model is not None:
            for at in range(0, len(texts), 200):
                out[at : at + 200] = model.score([passages(t) for t in texts[at : at + 200]])
        return out

    return with_column(docs, "quality_score", "double", lambda: scores)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (crc_mod4(F.col("doc_id")) == 2).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted"),
    )
