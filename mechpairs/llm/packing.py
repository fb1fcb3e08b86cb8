"""Packing: best-fit decreasing into windows of fixed length.

Documents are tokenised, an end id is added, overlong ones are first cut into
full windows, and the rest go, longest first, to the tightest open window with
room, found in a segment tree indexed by remaining capacity.  Windows that stay
clearly short at the end of a batch are cut again into lengths that are powers
of two, which need no padding.

Each input partition packs its own batches of at most ``BATCH_PIECES``
remainders, so memory is bounded, nothing is shuffled, and a lost task is simply
run again with the same result.  Sequence ids hold partition and counter.

Defined results: null and empty texts are one end id; repeated rows are packed
again, each on its own; ids of any type are handed through, null included; other columns
are ignored.  A flush may leave one short window for each batch, cut into at most eleven
sequences.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, slices, small_batches

WINDOW = 2048
END_ID = 1
BATCH_PIECES = 20_000
#: Windows filled below this share are cut into powers of two.
SHORT_FILL = 0.97


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Ids of whole texts under a byte-level BPE file of the tokenizers library.

    Vocabulary and added tokens come from that file; the split pattern is ``PATTERN``,
    and a file that splits otherwise is refused.  Plain texts
    are encoded with the same vocabulary by tiktoken, which gives the same ids in
    a third of the time (tests compare both); texts that hold an added token's
    string go through the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path} does not split texts as PATTERN does")
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        signs = byte_signs()
        ranks = {
            bytes(signs[c] for c in token): i
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token not in added
        }
        self.plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = sorted(added)

    def encode(self, text: str) -> np.ndarray:
        if any(a in text for a in self.added):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.plain.encode_ordinary(text)
        ids.append(END_ID)
        return np.array(ids, dtype="<u4")


# Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> dict[str, int]:
    """The byte that each printable sign of a byte-level vocabulary stands for."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class OpenWindows:
    """Segment tree over remaining capacities: leaf c counts the open windows
    with c free places; ``tightest(n)`` is the least c >= n that has one."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.tree = [0] * (2 * self.base)
        self.open: dict[int, list[int]] = {}

    def add(self, free: int, key: int) -> None:
        self.open.setdefault(free, []).append(key)
        self._count(free, 1)

    def take(self, free: int) -> int:
        self._count(free, -1)
        return self.open[free].pop()

    def _count(self, free: int, by: int) -> None:
        node = free + self.base
        while node:
            self.tree[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        node = need + self.base
        if self.tree[node]:
            return need
        while node > 1:
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.base:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.base
            node >>= 1
        return None


def best_fit(lengths: list[int], window: int) -> list[list[int]]:
    """Windows, each a list of piece numbers, by best-fit decreasing."""
    windows: list[list[int]] = []
    tree = OpenWindows(window)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        free = tree.tightest(lengths[k])
        if free is None:
            windows.append([])
            key, free = len(windows) - 1, window
        else:
            key = tree.take(free)
        windows[key].append(k)
        if free > lengths[k]:
            tree.add(free - lengths[k], key)
    return windows


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Packs one partition, batch by batch, into rows of pieces."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next = window, first_id
        self.waiting: list[tuple[object, int, np.ndarray, int]] = []

    def sequence(self, pieces: list[tuple[object, int, np.ndarray, int]]) -> list[tuple]:
        """Rows of the pieces laid one after another in a new sequence."""
        rows, at = [], 0
        for doc, start, ids, total in pieces:
            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1
        return rows

    def add(self, doc: object, ids: np.ndarray) -> list[tuple]:
        """Full windows of a document at once; its rest waits."""
        rows, n, w = [], len(ids), self.window
        for start in range(0, n - n % w, w):
            rows += self.sequence([(doc, start, ids[start : start + w], n)])
        if n % w:
            self.waiting.append((doc, n - n % w, ids[n - n % w :], n))
        return rows

    def flush(self) -> list[tuple]:
        rows = []
        for keys in best_fit([len(p[2]) for p in self.waiting], self.window):
            pieces = [self.waiting[k] for k in keys]
            used = sum(len(p[2]) for p in pieces)
            if used >= SHORT_FILL * self.window:
                rows += self.sequence(pieces)
            else:
                for part in cut(pieces, powers_of_two(used)):
                    rows += self.sequence(part)
        self.waiting = []
        return rows


def cut(pieces: list[tuple], sizes: list[int]) -> list[list[tuple]]:
    """Cut pieces laid in a row into parts of the given sizes."""
    ends = list(np.cumsum(sizes))
    parts: list[list[tuple]] = [[] for _ in sizes]
    at = 0
    for doc, start, ids, total in pieces:
        done = 0
        while done < len(ids):
            k = bisect.bisect_right(ends, at)
            n = min(len(ids) - done, int(ends[k]) - at)
            parts[k].append((doc, start + done, ids[done : done + n], total))
            done, at = done + n, at + n
    return parts


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row for each piece of a document; see the module for the layout."""
    path = tokenizer_path or default_tokenizer_path()
    names = [x.split()[0] for x in PIECES.split(", ")]
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ByteBpe(path)
        packer = Packer(window, TaskContext.get().partitionId() << 36)
        id_type = pa.null()

        def told(rows: list[tuple]) -> pa.RecordBatch:
            ids, *numbers = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(n, pa.int64()) for n in numbers)], ["doc_id", *names])

        for batch in slices(batches):
            rows, id_type = [], batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += packer.add(doc, tokenizer.encode(text or ""))
                if len(packer.waiting) >= BATCH_PIECES:
                    rows += packer.flush()
            if rows:
                yield told(rows)
        if rows := packer.flush():
            yield told(rows)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECES}")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
