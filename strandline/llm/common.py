"""What the operators of this subpackage share: tables, shared scratch tables, word hashing, components.

Conventions that hold for every operator here:

* Input frames may carry any extra columns; only the named ones are read, so clashing names cannot collide.
* A null text counts as an empty text. A null id is kept as a row of its own that links with nothing.
* Intermediate tables are written as Parquet under ``spark.checkpoint.dir`` (shared by all executors), so a lost
  executor costs a re-read and never a re-run of everything before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.sources.shared import Scratch, shared_root  # noqa: F401

U64 = np.uint64
SLICE_BYTES = 1 << 20
#: Texts are hashed in pieces of about this size, which bounds the tables of powers that a worker keeps.
PIECE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Rows of a few numbers each up to which a counted table is broadcast; beyond it both sides of the join are shuffled.
BROADCAST_ROWS = 250_000


def counted(df: DataFrame) -> DataFrame:
    """``df``, a settled table of ids, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


# ---------------------------------------------------------------- words of texts, as hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_STEP = 0x9E3779B97F4A7C15 | 1
_BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and its inverse modulo 2**64, for i < n at least."""
    have = _powers.get(step)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        ups, downs = np.full(size, step, U64), np.full(size, pow(step, -1, 1 << 64), U64)
        ups[0] = downs[0] = 1
        have = _powers[step] = np.multiply.accumulate(ups), np.multiply.accumulate(downs)
    return have


def byte_table(is_word) -> np.ndarray:
    return np.fromiter((bool(is_word(b)) for b in range(256)), bool, 256)


#: Words between ASCII white space: [^\x20\x09-\x0D]+
BLANK_WORDS = byte_table(lambda b: b != 0x20 and not 9 <= b <= 13)
#: Words of letters, digits and non-ASCII, after lower-casing: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
LETTER_WORDS = byte_table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASIS = np.arange(256, dtype=np.uint8)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pa.array(column).cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``most`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Words of texts lo..hi: byte spans relative to ``base``, owning text and 64-bit hash of each word."""

    __slots__ = ("base", "doc", "end", "first", "hash", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, word: np.ndarray, fold: np.ndarray):
        self.base = int(offsets[lo])
        raw = fold[data[self.base : int(offsets[hi])]]
        inside = word[raw]
        cuts = offsets[lo : hi + 1] - self.base
        begins = np.zeros(len(raw) + 1, bool)
        begins[cuts] = True
        if len(raw):
            open_, close = inside.copy(), inside.copy()
            open_[1:] &= ~inside[:-1] | begins[1:-1]
            close[:-1] &= ~inside[1:] | begins[1:-1]
            self.start, self.end = np.flatnonzero(open_), np.flatnonzero(close) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.doc = np.searchsorted(cuts, self.start, "right") - 1 + lo
        self.first = np.searchsorted(self.start, cuts)  # word index at which each text begins, and the end
        self.hash = np.zeros(len(self.start), U64)
        at = 0
        while at < len(self.start):  # pieces end between words, so that powers stay short for huge texts
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + PIECE_BYTES, "right")))
            left = int(self.start[at])
            part = raw[left : int(self.end[to - 1])]
            ups, downs = powers(_STEP, len(part) + 1)
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(_BYTE_CODES[part] * ups[: len(part)], out=sums[1:])
            s, e = self.start[at:to] - left, self.end[at:to] - left
            self.hash[at:to] = mix((sums[e] - sums[s]) * downs[s] + (e - s).astype(U64))
            at = to

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether all n are of one text."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, U64), np.zeros(0, bool)
        return roll(self.hash, n), self.doc[:count] == self.doc[n - 1 :]


_GRAM_STEP = 0xC2B2AE3D27D4EB4F | 1


def roll(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes."""
    ups, downs = powers(_GRAM_STEP, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * ups[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * downs[: len(hashes) - n + 1] + U64(n))


def word_slices(column: pa.Array, word: np.ndarray, fold: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_buffer(column)
    for lo, hi in slices(offsets):
        yield lo, hi, Words(data, offsets, lo, hi, word, fold)


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).astype(U64, copy=False).view(np.int64))


def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An array column from flat values and the n + 1 ends of the rows."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


# ---------------------------------------------------------------- connected components


#: Links that one task unites at a time.
TASK_LINKS = 200_000


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the smallest id that links reach.

    Tasks first unite the links that they happen to hold, a bounded number each, which leaves one link an id and task.
    Then alternating large-star and small-star steps: every step is a grouped minimum (pre-aggregated before its shuffle)
    and a join of two plain scans, so a node with very many links is split by Spark and never gathered in one group.
    """
    e = scratch.settle(edges.where("a <> b").select("a", "b").distinct(), "edges")
    tasks = -(-e.count() // TASK_LINKS) or 1
    links, e = e, scratch.settle(e.coalesce(tasks).mapInArrow(_unite, "u long, v long"), "united")
    scratch.drop(links)
    while tasks > 1 and not _is_stars(e):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        big = scratch.settle(both.join(least, "x").where("y > x and y <> m").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        lower = big.groupBy("u").agg(F.min("v").alias("m"))
        new = scratch.settle(big.join(lower, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), "small-star")
        scratch.drop(e, big)
        e = new
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    found = scratch.settle(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components")
    scratch.drop(e)
    return found


def _unite(batches):
    links = [np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]) for b in batches]
    a, b = np.concatenate(links, axis=1) if links else np.zeros((2, 0), np.int64)
    ids, at = np.unique(np.append(a, b), return_inverse=True)
    v, u = stars(ids, at.ravel()[: len(a)], at.ravel()[len(a) :])
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _is_stars(e: DataFrame) -> bool:
    """Each node points to one smaller node, which points to none."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out > 0 and in > 0)").isEmpty()


def stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), positions in ``ids``, as one link from every linked id to the smallest id of its group."""
    root = np.arange(len(ids))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            if ids[x] < ids[y]:
                root[y] = x
            else:
                root[x] = y
    tops = np.array([find(i) for i in range(len(ids))], np.int64)
    leaf = np.flatnonzero(tops != np.arange(len(ids)))
    return ids[tops[leaf]], ids[leaf]


def crc_of_id(column) -> "F.Column":
    """crc32 of an id as text: the fold rule of the labelled operators."""
    return F.crc32(F.col(column).cast("string").cast("binary")) if isinstance(column, str) else F.crc32(column.cast("string").cast("binary"))
