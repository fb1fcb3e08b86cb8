"""N-gram Jaccard join: PartEnum signatures.

A document is the set of its word shingles.  Sets whose Jaccard similarity
reaches the threshold differ in at most k elements, where k follows from the
size band that both fall into.  PartEnum splits the shingle domain into n1
first-level partitions, each into n2 second-level ones, and enumerates the
subsets of n2 - k2 of the latter: sets that differ in k elements or less agree
on whole subsets of some partition, so they share that subset's signature.

*Exactness.*  A set in band i signs for band i and, where a partner may be
larger, for band i + 1.  A set of n elements differs from any partner of the band
in k(n) elements at most, and each of them spoils one number of subsets.  So a set
signs, in the order of the partitions, k(n) such numbers and ``spare`` subsets more,
passing over empty ones, which say nothing and would throw strangers together.  Of
two sets that link, the one that stops first has at least ``spare`` of its subsets
in common with the other, and the other has come as far.  A set with too few
subsets that hold something signs again under another split of the domain, and so
do its partners that also ran out; after ``SPLITS`` splits the empty ones are kept.

*Skew.*  Copies become one class first (and are signed once in each task).
Sets are hashed once and kept as 48-bit digests in a table, which the signatures
and the verification read.
Signatures are shuffled once; a window over each drops those that one class has
alone.  Members of a bucket are compared with its most connected member, not
with each other.  Only buckets that then still hold several components go on.  As
linked sets share ``spare`` signatures, classes with fewer open buckets than that
leave (strangers that share a passage mostly do);
in the families that the rest chains, the members outside the largest component are
compared with the others, in blocks inside the tasks, as no other pair can change
a component.  Families come from the rows of the buckets, by least labels and one
contraction, so no bucket is opened to its pairs.  Blocks hold parity bitmaps of the sets (about two bits a shingle):
where two bitmaps differ in more bits than two linked sets differ in shingles, the
pair cannot link; the other pairs are verified on the sets.

Defined results: null texts and texts without words are empty sets, linked with
nothing, each its own component; rows with one doc_id are one node, so all of them
get one component, which joins what each of their texts links with; rows with a
null doc_id link with nothing and have no component (null), as in the SQL; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import counted, durable, read_table, runs, slices, small_batches
from .components import components, widened

SHINGLE = 4
NUM, DEN = 85, 100
N2, K2 = 2, 1
SPLITS = 6
BLOCK = 1024
#: Rounds in which classes with too few shared signatures leave.
THIN = 2
#: Rows of ids (16 to 60 bytes each) up to which a side is broadcast; a shuffle join beyond.
SMALL_ROWS = 1_000_000

U = np.uint64
_RNG = np.random.RandomState(20240607)
_BYTE = _RNG.randint(1, 2**63, 256).astype(U) * U(2) + U(1)
_SEP = np.zeros(256, bool)
_SEP[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd number modulo 2**64, grown as words get longer."""

    def __init__(self):
        self.table = np.ones(1, U)

    def upto(self, n: int) -> np.ndarray:
        if n > len(self.table):
            steps = np.full(max(64, 2 * n), _BASE, U)
            steps[0] = U(1)
            self.table = np.multiply.accumulate(steps)
        return self.table


_POWERS = Powers()


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of every word, A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    at = np.flatnonzero(~_SEP[raw])
    if not len(at):
        return np.empty(0, U)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(at) > 1) + 1))
    lengths = np.diff(np.append(starts, len(at)))
    within = np.arange(len(at)) - np.repeat(starts, lengths)
    sums = np.add.reduceat(_BYTE[raw[at]] * _POWERS.upto(int(lengths.max()))[within], starts)
    return mix(sums + lengths.astype(U))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word k-grams; all words, if fewer, as one."""
    w = word_hashes(text) if isinstance(text, str) else np.empty(0, U)
    if not len(w):
        return w
    width = min(k, len(w))
    n = len(w) - width + 1
    h = w[:n] + U(width)
    for j in range(1, width):
        h *= U(_BASE)
        h += w[j : n + j]
    h = np.sort(mix(h))
    return h[np.append(True, h[1:] != h[:-1])]


class Bands:
    """Size bands and the PartEnum numbers of each."""

    def __init__(self, num: int = NUM, den: int = DEN, n2: int = N2, k2: int = K2):
        self.num, self.den, self.n2, self.k2 = num, den, n2, k2
        self.low = [1]
        while self.low[-1] < 2**40:
            self.low.append(self.low[-1] * den * den // (num * num) + 1)

    def of(self, n: int) -> list[int]:
        """Bands for which a set of n elements signs."""
        i = int(np.searchsorted(self.low, n, "right")) - 1
        return [i, i + 1] if n * self.den // self.num >= self.low[i + 1] else [i]

    def differ(self, n: int, band: int) -> int:
        """Elements in which a set of n and a partner of the band differ at most."""
        largest = self.low[band + 1] - 1
        return (self.den - self.num) * (n + min(n * self.den // self.num, largest)) // (self.den + self.num)

    @cache
    def plan(self, band: int) -> tuple[int, int, int]:
        """(k, n1, spare): most differing elements, partitions, signatures that linked sets share."""
        largest = self.low[band + 1] - 1
        k = self.differ(largest, band)
        spare = 4 + k // 12
        parts = k + spare
        while parts < 2 * largest:  # the largest sets find enough parts that hold something
            empty = parts * math.exp(-largest / parts)
            if parts - empty - 1.5 * math.sqrt(empty) >= k + spare:
                break
            parts += 1 + parts // 50
        return k, -(-parts // self.n2), spare


def partition_sums(h: np.ndarray, n1: int, n2: int, k2: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature and element count of each enumerated subset."""
    m = mix(h ^ U(seed))
    part = (((m >> U(32)) * U(n1 * n2)) >> U(32)).astype(np.int64)  # n1 * n2 parts of equal share
    sums = np.zeros(n1 * n2, U)
    np.add.at(sums, part, m)
    counts = np.bincount(part, minlength=n1 * n2)
    sums, counts = sums.reshape(n1, n2), counts.reshape(n1, n2)
    subsets = list(combinations(range(n2), n2 - k2))
    total = np.stack([sums[:, c].sum(axis=1, dtype=U) for c in map(list, subsets)], axis=1).ravel()
    count = np.stack([counts[:, c].sum(axis=1) for c in map(list, subsets)], axis=1).ravel()
    place = np.arange(len(total)).astype(U)
    return mix(total ^ mix(place + U(seed))), count


def signatures(h: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set, and with each of the first split how many of its kind the
    set shares with any partner (0 for the other splits)."""
    sigs, least = [], []
    each = math.comb(bands.n2 - 1, bands.k2)
    for band in bands.of(len(h)) if len(h) else []:
        _, n1, spare = bands.plan(band)
        spoiled = each * bands.differ(len(h), band)
        if not spoiled:
            continue  # only equal sets qualify, and those are one class
        for split in range(SPLITS):
            sig, count = partition_sums(h, n1, bands.n2, bands.k2, split_seed(band, split))
            sig = (sig & ~U(3)) | U(2 * (band & 1) + (split > 0))
            at = np.flatnonzero(count > 0)[: spoiled + spare]
            need = min(spare, len(at) - spoiled)
            if split == SPLITS - 1 and need < 1:
                at = np.arange(len(sig))
            sigs.append(sig[at])
            least.append(np.full(len(at), max(need, 0) if split == 0 else 0, np.int16))
            if need > 0:
                break
    return (np.concatenate(sigs), np.concatenate(least)) if sigs else (np.empty(0, U), np.empty(0, np.int16))


def split_seed(band: int, split: int) -> int:
    return 0x5851F42D4C957F2D * (SPLITS * band + split + 1) % 2**64


def pack(h: np.ndarray) -> bytes:
    """Low 48 bits of each digest, six bytes for each."""
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


def marked(table: DataFrame, rows: int) -> DataFrame:
    """``table`` of ``rows`` rows, marked for broadcast if they are few enough."""
    return F.broadcast(table) if rows <= SMALL_ROWS else table


def small(table: DataFrame) -> DataFrame:
    """``table``, counted and marked."""
    return marked(table, table.count())


def saved(df: DataFrame) -> DataFrame:
    """``df``, written, counted meanwhile, and marked."""
    return marked(*counted(df))


def class_keys(h: np.ndarray) -> tuple[int, int]:
    """Two digests of a set, as signed longs."""
    a = np.array([h.sum(dtype=U) + U(len(h)), mix(h ^ U(0xD1B54A32D192ED03)).sum(dtype=U)], U)
    first, second = mix(a).view(np.int64).tolist()
    return first, second


def set_table(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, h) of every document: size, two digests and the
    packed set; h is null for copies of what the task has met, and without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches):  # Arrow keeps whole numbers beside nulls
            counts, firsts, seconds, packed = [], [], [], []
            for text, known in zip(batch.column("text").to_pylist(), batch.column("doc_id").is_valid().to_pylist(), strict=True):
                h = shingle_set(text, k)
                keys = class_keys(h)
                new = known and len(h) > 0 and keys not in seen
                if new:
                    seen.add(keys)
                counts.append(len(h))
                firsts.append(keys[0])
                seconds.append(keys[1])
                packed.append(pack(h) if new else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (counts, firsts, seconds)), pa.array(packed, pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "h"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, k1 long, k2 long, h binary")


def with_classes(table: DataFrame) -> DataFrame:
    """``table`` with the class id ``cid`` of each set: its first digest, or a hash of
    both for the few first digests that different sets share."""
    clash = table.groupBy("k1").agg(F.min("k2").alias("lo"), F.max("k2").alias("hi")).where("lo < hi").select("k1", F.lit(True).alias("clash"))
    clash, rows = counted(clash)
    if not rows:
        return table.withColumn("cid", F.col("k1"))
    told = table.join(marked(clash, rows), "k1", "left")
    return told.withColumn("cid", F.when(F.col("clash"), F.xxhash64("k1", "k2")).otherwise(F.col("k1"))).drop("clash")


def signed(sets: DataFrame, bands: Bands) -> DataFrame:
    """(sig, cid, need) of every row of ``sets(cid, h)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [signatures(unpack(h), bands) for h in batch.column("h").to_pylist()]
            sizes = [len(s) for s, _ in made]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([s for s, _ in made]).view(np.int64)), pa.array(np.repeat(batch.column("cid").to_numpy(), sizes)),
                    pa.array(np.concatenate([x for _, x in made])),
                ], names=["sig", "cid", "need"])

    return sets.select("cid", "h").mapInArrow(run, "sig long, cid long, need short")


def bucket_members(sets: DataFrame, bands: Bands) -> DataFrame:
    """(sig, cid, need, m) of every signature that several classes share, m rows in all."""
    bucket = Window.partitionBy("sig")
    before = F.lag("cid").over(bucket.orderBy("cid"))
    return (
        signed(sets, bands).withColumn("twice", F.coalesce(before == F.col("cid"), F.lit(False)))
        .withColumns({"lo": F.min("cid").over(bucket), "hi": F.max("cid").over(bucket), "m": F.count("*").over(bucket)})
        .where("lo < hi and not twice").select("sig", "cid", "need", "m")
    )


def verified(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    num, den = bands.num, bands.den
    n = sets.select("cid", "n")
    close, rows = counted(
        pairs.join(n.select(F.col("cid").alias("a"), F.col("n").alias("na")), "a")
        .join(n.select(F.col("cid").alias("b"), F.col("n").alias("nb")), "b")
        .where(F.lit(den) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb"))
    )
    right = sets.join(saved(close.select(F.col("b").alias("cid")).distinct()), "cid", "left_semi")
    left = sets.select(F.col("cid").alias("a"), F.col("h").alias("ha")).join(marked(close, rows), "a")
    both = left.join(right.select(F.col("cid").alias("b"), F.col("h").alias("hb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ha, hb = (batch.column(c).to_pylist() for c in ("ha", "hb"))
            common = np.array([len(np.intersect1d(unpack(x), unpack(y), assume_unique=True)) for x, y in zip(ha, hb, strict=True)], np.int64)
            union = batch.column("na").to_numpy() + batch.column("nb").to_numpy() - common
            yield batch.select(["a", "b"]).filter(pa.array(den * common >= num * union))

    return both.select("a", "b", "na", "nb", "ha", "hb").mapInArrow(run, "a long, b long")


def class_components(members: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """(node, comp) of all classes that link, from bucket memberships (sig, cid, need, m)."""
    known = durable(members.withColumn("pop", F.sum("m").over(Window.partitionBy("cid"))).drop("m"))
    centre = known.groupBy("sig").agg(F.max(F.struct("pop", "cid")).alias("p"))
    # Candidates of each class: the centres of its buckets, the best one first.
    stars = durable(
        known.join(centre, "sig").where("cid <> p.cid").groupBy("cid").agg(F.max("p").alias("best"))
    )
    first = stars.select(F.least("cid", "best.cid").alias("a"), F.greatest("cid", "best.cid").alias("b")).distinct()
    comp = components(durable(verified(first, sets, bands)))
    # Buckets that hold several components; their members chain to families.
    named = known.select("sig", "cid", "need").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    family, rows = counted(families(thinned(named.withColumn("comp", F.coalesce("comp", "cid")))))
    marks = durable(bitmaps(sets.join(marked(family, rows), "cid", "left_semi")))
    # First the closest member of each other component, then all that is still open.
    for closest in (True, False):
        more, rows = counted(verified(open_pairs(family, comp, marks, closest, bands), sets, bands))
        if rows:
            comp = widened(comp, more)
    return comp


def thinned(rows: DataFrame) -> DataFrame:
    """Rows (sig, cid) that can still show a link between components, of rows (sig,
    cid, need, comp).

    Buckets with one component go; so do classes with fewer open buckets of the
    first split than a partner must share with them (``need``), and that again
    on what is left.  Both sides of a link between components always stay.
    """
    mine = Window.partitionBy("cid")
    first, odd = F.col("sig").bitwiseAND(1) == 0, F.col("sig").bitwiseAND(2) > 0
    for _ in range(THIN):
        open_ = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
        counted = rows.join(open_, "sig", "left_semi").withColumns({
            "x": F.count_if(first & ~odd).over(mine), "y": F.count_if(first & odd).over(mine),
        })
        enough = F.max(F.when(odd, F.col("y")).otherwise(F.col("x")) >= F.col("need")).over(mine)
        rows = durable(counted.withColumn("alive", enough).where("alive").drop("x", "y", "alive"))
    open_ = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    return rows.join(open_, "sig", "left_semi").select("sig", "cid")


def families(rows: DataFrame) -> DataFrame:
    """(cid, family) of classes that shared buckets ``rows(sig, cid)`` chain together.

    Every class takes the least class of its buckets as its label; buckets that
    still hold several labels link those, which are few.
    """
    rows = durable(rows)
    least = rows.groupBy("sig").agg(F.min("cid").alias("lo"))
    told = durable(rows.join(least, "sig").withColumn("label", F.min("lo").over(Window.partitionBy("cid"))).select("sig", "cid", "label"))
    open_ = told.groupBy("sig").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("sig", "a")
    links = told.select("sig", "label").join(open_, "sig").where("label <> a").select("a", F.col("label").alias("b")).distinct()
    comp = components(durable(links)).withColumnRenamed("node", "label")
    one = told.select("cid", "label").distinct()
    return one.join(comp, "label", "left").select("cid", F.coalesce("comp", "label").alias("family"))


def bitmaps(sets: DataFrame) -> DataFrame:
    """(cid, n, bits): parity of the number of shingles in each of 2n slots or more."""

    def bits(n: int, raw: bytes) -> bytes:
        width = max(64, 1 << (2 * n - 1).bit_length())
        slots = (unpack(raw) & U(width - 1)).astype(np.int64)
        return np.packbits(np.bincount(slots, minlength=width) & 1, bitorder="little").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [bits(n, h) for n, h in zip(batch.column("n").to_pylist(), batch.column("h").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("n"), pa.array(made, pa.binary())], names=["cid", "n", "bits"])

    return sets.select("cid", "n", "h").mapInArrow(run, "cid long, n long, bits binary")


def open_pairs(family: DataFrame, comp: DataFrame, marks: DataFrame, closest: bool, bands: Bands, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of a family that may link and are in different components.

    A family is a group of classes of one size band, chained by shared buckets
    (a class is in every band that it signs for).  Where one still
    holds several components, the members outside its largest component are
    compared with all its members, block against block inside the tasks; a task
    holds two blocks of bitmaps.  With ``closest``, a member gives one pair for
    each other component of a block.
    """
    lows = F.array(*(F.lit(x) for x in bands.low))
    own = F.size(F.filter(lows, lambda x: x <= F.col("n"))) - 1
    up = F.floor(F.col("n") * bands.den / bands.num) >= F.get(lows, own + 1)
    sized = marks.select("cid", "n").select(
        "cid", F.explode(F.when(up, F.array(own, own + 1)).otherwise(F.array(own))).alias("band")
    )
    placed = (
        family.join(comp.withColumnRenamed("node", "cid"), "cid", "left").join(sized, "cid")
        .select(F.xxhash64("family", "band").alias("family"), "cid", F.coalesce("comp", "cid").alias("comp"))
    )
    parts = placed.groupBy("family", "comp").agg(F.count("*").alias("n"))
    whole = parts.groupBy("family").agg(
        F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("major"), F.count("*").alias("parts")
    ).where("parts > 1")
    named = placed.join(whole, "family").select(
        "family", "cid", "comp", (F.col("comp") != F.col("major.comp")).alias("minor"),
        F.ceil(F.col("size") / block).cast("int").alias("nr"),
        F.ceil((F.col("size") - F.col("major.n")) / block).cast("int").alias("nl"),
    )
    mine = F.xxhash64("cid")
    left = named.where("minor").withColumn("bi", F.pmod(mine, "nl").cast("int")).withColumn("bj", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)))
    right = named.withColumn("bj", F.pmod(mine, "nr").cast("int")).withColumn("bi", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)))
    cols = ["family", "bi", "bj", "side", "cid", "comp"]
    seats = left.withColumn("side", F.lit(0)).select(cols).unionByName(right.withColumn("side", F.lit(1)).select(cols))
    keys = ["family", "bi", "bj"]
    num, den = bands.num, bands.den

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(batches, keys):
            yield pd.DataFrame(near_pairs(rows, closest, num, den), columns=["a", "b"], dtype="int64")

    ready = marks.join(saved(seats), "cid").repartition(*keys).sortWithinPartitions(*keys, "side", "cid")
    found = ready.mapInPandas(run, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_pairs(rows: pd.DataFrame, closest: bool, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """Pairs across the two sides of a block pair whose bitmaps allow a link."""
    left, right = (rows[rows["side"] == k] for k in (0, 1))
    if not len(left) or not len(right):
        return []
    words = min(map(len, rows["bits"])) // 8

    def folded(raw: bytes) -> np.ndarray:
        out = np.frombuffer(raw, "<u8")
        while len(out) > words:
            out = out[: len(out) // 2] ^ out[len(out) // 2 :]
        return out

    there = np.stack([folded(x) for x in right["bits"]])
    n, cid, comp = (right[c].to_numpy() for c in ("n", "cid", "comp"))
    out: list[tuple[int, int]] = []
    for my_bits, my_n, my_cid, my_comp in zip(left["bits"], left["n"], left["cid"], left["comp"], strict=True):
        apart = np.bitwise_count(there ^ folded(my_bits)).sum(axis=1, dtype=np.int64)
        fits = (den + num) * apart <= (den - num) * (n + my_n)
        fits &= (den * np.minimum(n, my_n) >= num * np.maximum(n, my_n)) & (comp != my_comp)
        at = np.flatnonzero(fits)
        if closest and len(at):
            at = at[np.lexsort((apart[at], comp[at]))]
            at = at[np.append(True, np.diff(comp[at]) != 0)]
        out += [(int(my_cid), int(cid[k])) for k in at]
    return out


def same_ids(comp: DataFrame, rows: DataFrame) -> DataFrame:
    """``comp(node, comp)`` with the classes of one doc_id of ``rows(doc_id, cid)`` joined."""
    named = comp.withColumnRenamed("node", "cid")
    of = durable(rows.join(named, "cid", "left").select("doc_id", "cid", F.coalesce("comp", "cid").alias("comp")).distinct())
    least = of.groupBy("doc_id").agg(F.min("comp").alias("a"))
    more = components(durable(of.join(least, "doc_id").where("comp <> a").select("a", F.col("comp").alias("b")).distinct()))
    known = comp.unionByName(of.select(F.col("cid").alias("node"), "comp")).distinct()
    moved = more.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return durable(known.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))


def join_documents(docs: DataFrame, k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; sets of word ``k``-grams
    link from a Jaccard similarity of ``num / den`` on."""
    small_batches(docs.sparkSession)
    bands = Bands(num, den)
    table = with_classes(durable(set_table(docs, k)))
    keys = table.drop("h")
    filled = keys.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("cid").agg(F.min("doc_id").alias("rep"))

    kept = table.where("h is not null").select("cid", F.col("n_shingles").alias("n"), "doc_id", "h")
    members = durable(bucket_members(kept, bands))
    # One row of each class that shares a signature holds its set.
    holder = kept.groupBy("cid").agg(F.min("doc_id").alias("doc_id")).join(members.select("cid").distinct(), "cid", "left_semi")
    sets = kept.join(saved(holder), ["cid", "doc_id"], "left_semi").select("cid", "n", "h")
    again, repeats = counted(keys.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeats:
        sets = sets.dropDuplicates(["cid"])  # only rows that repeat a doc_id give a class twice
    comp = class_components(members, durable(sets), bands)
    if repeats:
        comp = same_ids(comp, filled.join(again, "doc_id", "left_semi").select("doc_id", "cid"))

    named = comp.join(classes.withColumnRenamed("cid", "node"), "node")
    least = named.groupBy("comp").agg(F.min("rep").alias("least"))
    of_class = named.join(least, "comp").select(F.col("node").alias("cid"), "least")
    ids = classes.join(of_class, "cid", "left").select("cid", F.coalesce("least", "rep").alias("component_id"))
    with_words = filled.join(ids, "cid").select("doc_id", "n_shingles", "component_id")
    alone = keys.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if repeats:  # an empty row goes with the other rows of its doc_id
        whole = with_words.join(again, "doc_id", "left_semi").select("doc_id", F.col("component_id").alias("whole")).distinct()
        alone = alone.join(whole, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("whole", "component_id").alias("component_id"))
    return with_words.unionByName(alone)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(read_table(spark, sf_dir, "documents"), SHINGLE, NUM, DEN)


def oracle() -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {DEN} * count(*) >= {NUM} * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id AS node, doc_id AS reach FROM s UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach)
SELECT s.doc_id, len(s.g) AS n_shingles, (SELECT min(reach) FROM r WHERE r.node = s.doc_id) AS component_id FROM s"""
