"""Benchmark decontamination (operator 6): prefix-filtered set join of item windows against documents.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window of its own length). The
window's shingles (runs of three words, or the whole of a window of one or two) are ordered by their number of
occurrences over all documents, rarest first. A text that holds the window holds every shingle of it, so for exact
containment the prefix that must match is the rarest shingle alone. Each place of a document that has a prefix shingle
fixes where the window would begin; the length and position bounds drop places at which it would leave the text, and
what is left is verified word by word over the item-sized window.

The benchmark's distinct windows are a table, cut from the items in tasks; so are their owners. Windows go to the tasks
that read documents as arrays, in parts of about ``part_windows`` by a hash of the window, whatever the items' sizes are:
one part at a time passes through the driver, is broadcast and released, and what the parts find is merged. Ids of items
meet documents by a join, after that, on the few windows found.

Defined results: null and empty texts have no words and no hits; items that are null, without words or without an id
match nothing; repeated items and repeated documents are each judged as they are; ids of items are strings in results.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandline.llm.common import LETTER_WORDS, LOWER, U64, Scratch, free_name, roll, word_slices

WINDOW = 10
SHINGLE = 3


class HashSet:
    """Sorted distinct hashes with a bit filter before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.mask = U64((1 << max(10, int(len(self.keys) * 16).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(self.keys & self.mask).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that are in the set, and where in the set."""
        maybe = np.flatnonzero(self.bits[(hashes & self.mask).astype(np.int64)])
        if not len(maybe) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == hashes[maybe]
        return maybe[hit], at[hit]


@dataclass
class Windows:
    """Distinct windows of one part of the benchmark, by length, with their numbers."""

    words: dict[int, np.ndarray]  # length -> (windows, length) word hashes
    number: dict[int, np.ndarray]

    def shingles(self) -> dict[int, np.ndarray]:
        """length -> (windows, places) shingle hashes."""
        out = {}
        for length, words in self.words.items():
            n = min(SHINGLE, length)
            flat = roll(words.ravel(), n) if words.size >= n else np.zeros(0, U64)
            rows = np.arange(len(words))[:, None] * length + np.arange(length - n + 1)[None, :]
            out[length] = flat[rows] if len(words) else np.zeros((0, 1), U64)
        return out


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id (string) and words (bytes of the word hashes) of each window of each item."""

    def run(batches):
        for batch in batches:
            for lo, hi, w in word_slices(batch.column(1), LETTER_WORDS, LOWER):
                row, out = [], []
                for i in range(lo, hi):
                    h = w.hash[w.first[i - lo] : w.first[i - lo + 1]]
                    size = min(window, len(h))
                    if size:
                        view = np.lib.stride_tricks.sliding_window_view(h, size)
                        view = np.unique(view, axis=0) if len(view) > 1 else view
                        out += [x.tobytes() for x in view]
                        row += [i] * len(view)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(out, pa.binary())], names=["item_id", "words"])

    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), "text")
    return items.mapInArrow(run, "item_id string, words binary")


def window_part(rows: list) -> Windows:
    """Windows from (number, words) rows."""
    by_size: dict[int, list] = {}
    for number, words in rows:
        by_size.setdefault(len(words) // 8, []).append((bytes(words), number))
    words, numbers = {}, {}
    for size, got in by_size.items():
        got.sort()
        words[size] = np.frombuffer(b"".join(w for w, _ in got), U64).reshape(-1, size)
        numbers[size] = np.array([n for _, n in got], np.int64)
    return Windows(words, numbers)


def shingle_counts(docs: DataFrame, vocabulary: dict[int, np.ndarray]) -> dict[int, int]:
    """Occurrences over all documents of the benchmark's shingles; summed in tasks before they meet."""
    sets = {n: HashSet(keys) for n, keys in vocabulary.items()}

    def run(batches):
        totals = {n: np.zeros(len(s.keys), np.int64) for n, s in sets.items()}
        for batch in batches:
            for _, _, w in word_slices(batch.column(0), LETTER_WORDS, LOWER):
                for n, s in sets.items():
                    grams, whole = w.grams(n)
                    _, at = s.find(grams[whole])
                    totals[n] += np.bincount(at, minlength=len(s.keys))
        for n, counts in totals.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(sets[n].keys[some].view(np.int64)), pa.array(counts[some])], names=["shingle", "n"])

    rows = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {int(np.int64(r[0]).view(U64)): r[1] for r in rows.collect()}  # at most the benchmark's shingles


@dataclass
class Prefixes:
    """For shingles of n words: the distinct prefix shingles, and the windows (length, row, place) of each."""

    keys: HashSet
    first: np.ndarray
    length: np.ndarray
    row: np.ndarray
    place: np.ndarray


def prefixes(windows: Windows, counts: dict[int, int]) -> dict[int, Prefixes]:
    got: dict[int, list] = {}
    for length, shingles in windows.shingles().items():
        rarity = np.array([[counts.get(int(x), 0) for x in row] for row in shingles], np.int64).reshape(shingles.shape)
        place = np.lexsort((shingles, rarity), axis=1)[:, 0] if len(shingles) else np.zeros(0, np.int64)
        key = shingles[np.arange(len(shingles)), place]
        got.setdefault(min(SHINGLE, length), []).append((key, np.full(len(key), length), np.arange(len(key)), place))
    out = {}
    for n, parts in got.items():
        key, length, row, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        keys = HashSet(key)
        out[n] = Prefixes(keys, np.append(np.searchsorted(key[order], keys.keys), len(key)), length[order], row[order], place[order])
    return out


def _candidates(w, table: dict[int, Prefixes], limit: int = 1 << 20):
    """(start, length, row) of windows that may begin at word ``start``: bounds checked, not yet verified."""
    for n, p in table.items():
        grams, whole = w.grams(n)
        at, key = p.keys.find(grams)
        keep = whole[at]
        at, key = at[keep], key[keep]
        spread = p.first[key + 1] - p.first[key]
        ends = np.cumsum(spread)
        lo = 0
        while lo < len(at):  # blocks, so that very common prefixes cannot grow the arrays
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
            s = spread[lo:hi]
            entry = np.repeat(p.first[key[lo:hi]], s) + np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            start = np.repeat(at[lo:hi], s) - p.place[entry]
            length, row = p.length[entry], p.row[entry]
            ok = (start >= 0) & (start + length <= len(w.hash))
            start, length, row = start[ok], length[ok], row[ok]
            ok = w.doc[start] == w.doc[start + length - 1]
            yield start[ok], length[ok], row[ok]
            lo = hi


def find_windows(texts: pa.Array, windows: Windows, table: dict[int, Prefixes]) -> pa.Array:
    """struct(n_words, spans, windows) of each text: verified word spans (start, end alternating) and window numbers."""
    n_words, spans, found = [], [], []
    for lo, hi, w in word_slices(texts, LETTER_WORDS, LOWER):
        per_doc: dict[int, tuple[list, set]] = {}
        for start, length, row in _candidates(w, table):
            for size in np.unique(length):
                mine = length == size
                s, r = start[mine], row[mine]
                same = (w.hash[s[:, None] + np.arange(size)] == windows.words[int(size)][r]).all(axis=1)
                for a, k in zip(s[same].tolist(), windows.number[int(size)][r[same]].tolist(), strict=True):
                    places, numbers = per_doc.setdefault(int(w.doc[a]), ([], set()))
                    places.append((a, a + int(size)))
                    numbers.add(k)
        for i in range(lo, hi):
            base = int(w.first[i - lo])
            n_words.append(int(w.first[i - lo + 1]) - base)
            places, numbers = per_doc.get(i, ((), ()))
            spans.append([x - base for pair in _union(places) for x in pair])
            found.append(sorted(numbers))
    return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))], ["n_words", "spans", "windows"])


def _union(places) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_FOUND = "n_words long, spans array<long>, windows array<long>"


def benchmark_windows(benchmark: DataFrame, window: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (number, words), and the owners (item_id, words) of each."""
    owners = scratch.settle(item_windows(benchmark, window), "owners")
    return scratch.settle(owners.select("words").distinct().select(F.monotonically_increasing_id().alias("number"), "words"), "windows"), owners


def find_contamination(docs: DataFrame, windows: DataFrame, scratch: Scratch, *, part_windows: int = 100_000, column: str = "found") -> DataFrame:
    """``docs`` with a struct column: n_words, spans (word positions, start and end alternating), window numbers."""
    parts = windows.count() // part_windows + 1
    part_of = F.pmod(F.xxhash64("words"), F.lit(parts))
    for k in range(parts):
        part = window_part(windows.where(part_of == k).select("number", "words").collect())  # about part_windows rows
        vocabulary: dict[int, list] = {}
        for length, shingles in part.shingles().items():
            vocabulary.setdefault(min(SHINGLE, length), []).append(shingles.ravel())
        counts = shingle_counts(docs, {n: np.concatenate(x) for n, x in vocabulary.items()}) if vocabulary else {}
        model = docs.sparkSession.sparkContext.broadcast((part, prefixes(part, counts)))  # the same bound
        new = _finder(model)(F.col("text"))
        docs = docs.withColumn(column, new if k == 0 else _merge()(F.col(column), new))
        if parts > 1:
            docs = scratch.settle(docs, f"part{k}")
            model.destroy()
    return docs


def _finder(model):
    @arrow_udf(_FOUND)
    def found(texts: pa.Array) -> pa.Array:
        return find_windows(texts, *model.value)

    return found


def _merge():
    @arrow_udf(_FOUND)
    def merged(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            pairs = [(s[i], s[i + 1]) for s in (x["spans"], y["spans"]) for i in range(0, len(s), 2)]
            rows.append({"n_words": x["n_words"], "spans": [v for p in _union(pairs) for v in p], "windows": sorted({*x["windows"], *y["windows"]})})
        return pa.array(rows, a.type)

    return merged


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, part_windows: int = 100_000) -> DataFrame:
    """The rows of ``docs`` without any hit, with the columns that they came with."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    windows, _ = benchmark_windows(benchmark, window, scratch)
    found = free_name(docs, "_found")
    return find_contamination(docs, windows, scratch, part_windows=part_windows, column=found).where(F.size(F.col(found)["spans"]) == 0).drop(found)


def contamination_report(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, part_windows: int = 100_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    windows, owners = benchmark_windows(benchmark, window, scratch)
    found = find_contamination(docs.select("doc_id", "text"), windows, scratch, part_windows=part_windows)
    found = scratch.settle(found.select("doc_id", "found.*", F.monotonically_increasing_id().alias("_row")), "found")
    hits = found.where(F.size("windows") > 0).select("_row", F.explode("windows").alias("number"))
    items = hits.join(windows, "number").join(owners, "words").select("_row", "item_id").distinct().groupBy("_row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: x - a)  # alternating ends minus starts
    got = F.coalesce("items", F.array().cast("array<string>"))
    out = found.join(items, "_row", "left").select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(got).cast("long").alias("n_items"), F.sha2(F.array_join(got, ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated")
    )
    out = scratch.settle(out, "result")
    scratch.keep(out)
    return out


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM bw), dw AS (
  SELECT doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM d, sizes WHERE len(w) >= size)
), m AS (SELECT dw.doc_id, dw.k, dw.size, bw.item_id FROM dw JOIN bw USING (size, win)),
h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + size - 1)) AS p FROM m) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       coalesce(i.items_sha256, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
