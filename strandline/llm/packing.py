"""Best-fit packing (operator 4): tokenise, cut, and pack by swap-based local search.

A document is its ids by the public byte-level BPE followed by id 0. Documents over ``capacity`` are cut from the back
into full pieces, so that only the first piece may be shorter; a full piece is a sequence of its own. Short pieces are
numbered and dealt by a hash of their number into packing groups of bounded size, whose number grows with the corpus, so
that no group is hot, however often rows repeat. Each group is first placed loosely, in order of arrival, and then packed
by local search: exchanges of one piece for one, two for one and one for two, and moves, between underfull bins, each of
which raises the summed squared fill, until bins empty and nothing improves. What a group cannot fill (its few underfull
bins) goes to a second, pooled round, in the same way.

Defined results: a null or empty text is the single id 0; repeated rows of one id are packed as rows of their own; a
null id is packed too. Tokens are never dropped. The string of the vocabulary's one special token is that token in texts,
as the tokenizer has it.
"""

from __future__ import annotations

import base64
import zlib
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import _BYTE_CODES, _STEP, PIECE_BYTES, SLICE_BYTES, Scratch, U64, byte_table, mix, powers, text_buffer

CAPACITY = 2048
END_ID = 0
#: The vocabulary's special token and its id. Fixed values.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

# ------------------------------------------------------------------ token ids

#: Bytes with which white space beyond ASCII may begin: no cut is made before a blank that one of them follows.
_WIDE_BLANKS = byte_table(lambda b: b in (0xC2, 0xE1, 0xE2, 0xE3))
_BLANKS = byte_table(lambda b: b == 32 or 9 <= b <= 13)


class Encoder:
    """Ids of the public byte-level BPE, with a bounded memory of segments met before.

    A segment begins at a blank that a non-blank follows: the tokenizer's own splitting always begins a piece there, so
    ids of a text are the ids of its segments in turn. Segments not met before are encoded by the library; known ones are
    found by a hash and compared by their bytes.
    """

    def __init__(self, vocabulary: str, keep: int = 400_000):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.keep = keep
        self.blank_first = np.zeros(len(ranks), bool)
        self.blank_first[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, U64)  # sorted hashes of known segments
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.from_, self.width = np.zeros(0, np.int64), np.zeros(0, np.int64)  # and their bytes
        self.bytes = np.zeros(0, np.uint8)

    def encode(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts lo..hi, one after the other, and the hi - lo + 1 ends."""
        base = int(offsets[lo])
        raw = data[base : int(offsets[hi])]
        cuts = (offsets[lo : hi + 1] - base).astype(np.int64)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(hi - lo + 1, np.int64)
        if SPECIAL.encode() in raw.tobytes():
            return self._encode_apart(raw, cuts)
        return self._encode_raw(raw, cuts)

    def _encode_apart(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts with special tokens: each stretch between them is a text of its own."""
        view, out, ends = raw.tobytes(), [], [0]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            size = 0
            for k, part in enumerate(view[a:b].split(SPECIAL.encode())):
                if k:
                    out.append(np.array([SPECIAL_ID], np.uint32))
                own = np.frombuffer(part, np.uint8)
                if len(own):
                    out.append(self._encode_raw(own, np.array([0, len(own)]))[0])
                size += bool(k) + (len(out[-1]) if len(own) else 0)
            ends.append(ends[-1] + size)
        return np.concatenate(out), np.array(ends)

    def _encode_raw(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = np.zeros(len(raw) + 1, bool)
        begin[:-2] |= (raw[:-1] == 32) & ~_BLANKS[raw[1:]] & ~_WIDE_BLANKS[raw[1:]]
        begin[cuts[cuts > 0] - 1] = False  # the next text does not follow the last blank of this one
        begin[cuts] = True
        begin[-1] = False
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(raw))
        keys = np.zeros(len(start), U64)
        at = 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE_BYTES, "right")))
            left = int(start[at])
            part = raw[left : int(end[to - 1])]
            ups, downs = powers(_STEP, len(part) + 1)
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(_BYTE_CODES[part] * ups[: len(part)], out=sums[1:])
            s, e = start[at:to] - left, end[at:to] - left
            keys[at:to] = mix((sums[e] - sums[s]) * downs[s] + (e - s).astype(U64))
            at = to
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        found = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            near = np.minimum(found, len(self.keys) - 1)
            known = self.keys[near] == distinct
        if not known.all():
            if len(self.keys) + (~known).sum() > self.keep:
                self._forget()
                known[:] = False
            flat, sizes = self._encode_new(raw, start[first[~known]], end[first[~known]])
            place = np.searchsorted(self.keys, distinct[~known])
            self.at = np.insert(self.at, place, len(self.ids) + np.cumsum(sizes) - sizes)
            self.size = np.insert(self.size, place, sizes)
            self.keys = np.insert(self.keys, place, distinct[~known])
            self.ids = np.concatenate([self.ids, flat])
            a, width = start[first[~known]], (end - start)[first[~known]]
            self.from_ = np.insert(self.from_, place, len(self.bytes) + np.cumsum(width) - width)
            self.width = np.insert(self.width, place, width)
            self.bytes = np.concatenate([self.bytes, raw[np.repeat(a - (np.cumsum(width) - width), width) + np.arange(width.sum())]])
        slot = np.searchsorted(self.keys, distinct)[which.ravel()]
        width = end - start
        if not ((self.width[slot] == width).all() and (self.bytes[np.repeat(self.from_[slot] - start, width) + np.arange(len(raw))] == raw).all()):
            view = raw.tobytes()  # two segments of one hash: encode the texts as they are
            alone = [np.array(self.bpe.encode_ordinary(view[a:b].decode()), np.uint32) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            return np.concatenate(alone), np.cumsum([0, *map(len, alone)])
        sizes = self.size[slot]
        ends = np.cumsum(sizes)
        total = int(ends[-1])
        ids = self.ids[np.repeat(self.at[slot] - (ends - sizes), sizes) + np.arange(total)]
        before = np.concatenate([[0], ends])
        return ids, before[np.searchsorted(start, cuts)]

    def _encode_new(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments, one after the other, and how many each has.

        Segments whose only blank is their first byte are encoded as one text, in which exactly their first ids begin
        with a blank; others one by one.
        """
        blanks = np.concatenate([[0], np.cumsum(raw == 32)])
        plain = (raw[start] == 32) & (blanks[end] - blanks[start] == 1)
        sizes = np.zeros(len(start), np.int64)
        width = (end - start)[plain]
        joined = raw[np.repeat(start[plain] - (np.cumsum(width) - width), width) + np.arange(width.sum())].tobytes().decode()
        together = self.bpe.encode_to_numpy(joined, allowed_special=set(), disallowed_special=()) if joined else np.zeros(0, np.uint32)
        heads = np.flatnonzero(self.blank_first[together])
        sizes[plain] = np.diff(np.append(heads, len(together)))
        view = raw.tobytes()
        alone = [np.array(self.bpe.encode_ordinary(view[a:b].decode()), np.uint32) for a, b in zip(start[~plain].tolist(), end[~plain].tolist(), strict=True)]
        sizes[~plain] = [len(x) for x in alone]
        flat = np.zeros(int(sizes.sum()), np.uint32)
        inside = np.repeat(plain, sizes)
        flat[inside] = together
        flat[~inside] = np.concatenate(alone) if alone else np.zeros(0, np.uint32)
        return flat, sizes


_encoders: dict[str, Encoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(vocabulary: str | None) -> Encoder:
    path = vocabulary or default_vocabulary()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def document_pieces(texts: pa.Array, capacity: int = CAPACITY, vocabulary: str | None = None):
    """(row, piece, start, length, crc32) arrays of the pieces of each text."""
    data, offsets = text_buffer(texts)
    enc, out, n = _encoder(vocabulary), [], len(offsets) - 1
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1))
        ids, ends = enc.encode(data, offsets, lo, hi)
        ids = ids.astype("<u4", copy=False)
        for i in range(lo, hi):
            own = np.append(ids[ends[i - lo] : ends[i - lo + 1]], np.uint32(END_ID)).astype("<u4", copy=False)
            count = -(-len(own) // capacity)
            a = 0
            for k in range(count):
                b = len(own) - capacity * (count - 1 - k)
                out.append((i, k, a, b - a, zlib.crc32(own[a:b].tobytes())))
                a = b
        lo = hi
    return out


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a number of its own of every piece of every document."""

    def run(batches):
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = document_pieces(batch.column(1), capacity, vocabulary)
            cols = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[:, 0])), pa.array(cols[:, 1].astype(np.int32)), *(pa.array(cols[:, j]) for j in (2, 3, 4)), pa.array(number + np.arange(len(cols)))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "_row"],
            )
            number += len(cols)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, _row long")


# ------------------------------------------------------------------ packing of one group


def arrival_order(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The loose placement: pieces in order, a new bin whenever the next one does not fit."""
    bins: list[list[int]] = []
    room = 0
    for i, size in enumerate(lengths.tolist()):
        if size > room:
            bins.append([])
            room = capacity
        bins[-1].append(i)
        room -= size
    return bins


class LocalSearch:
    """Exchanges and moves between underfull bins.

    The fullest underfull bin takes what fills it best from the pool of the pieces of all other underfull bins; what it
    gives back goes to the bin it took from. As every giver is no fuller than the taker, each step raises the sum of
    squared fills, so the search ends. A bin that is full, or that no step improves, is set aside; when all are, the
    underfull ones are searched again, until a whole round changes nothing.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.size, self.capacity, self.steps = lengths.tolist(), capacity, 0
        self.bins = [set(b) for b in bins]
        self.fill = [sum(self.size[i] for i in b) for b in bins]
        self.of = [0] * len(self.size)
        for k, b in enumerate(bins):
            for i in b:
                self.of[i] = k

    def run(self) -> list[list[int]]:
        before = -1
        while before != self.steps:
            before = self.steps
            self._round()
        return [sorted(b) for b in self.bins if b]

    def _round(self) -> None:
        under = [b for b in range(len(self.bins)) if 0 < self.fill[b] < self.capacity]
        self.open = set(under)
        self.count = np.zeros(self.capacity + 1, np.int64)
        self.pool: dict[int, list[int]] = {}
        for b in sorted(under, key=lambda b: -self.fill[b]):  # pieces of the emptiest bins come out first
            self._offer(self.bins[b])
        heap = [(-self.fill[b], b) for b in under]
        heapify(heap)
        while heap:
            fill, b = heappop(heap)
            if b not in self.open or -fill != self.fill[b] or not self.bins[b]:
                continue
            self.open.discard(b)
            for i in self.bins[b]:
                self.count[self.size[i]] -= 1
            two = True
            while self.fill[b] < self.capacity:
                step = self._step(b, two)
                if step is None:
                    break
                changed = self._apply(b, *step)
                if changed is None:  # no rise: from here on without taking two pieces
                    if not two:
                        break
                    two = False
                    continue
                for d in changed:
                    heappush(heap, (-self.fill[d], d))

    def _offer(self, items) -> None:
        for i in items:
            self.count[self.size[i]] += 1
            self.pool.setdefault(self.size[i], []).append(i)

    def _take(self, size: int) -> int:
        """A piece of that size from an open bin."""
        stack = self.pool[size]
        while self.of[stack[-1]] not in self.open:  # set aside since it was offered
            stack.pop()
        return stack.pop()

    def _step(self, b: int, two: bool) -> tuple[list[int], list[int]] | None:
        """Sizes to take (one, or ``two``) and pieces to give back, for the largest gain that fits into bin ``b``."""
        room = self.capacity - self.fill[b]
        sizes = np.where(self.count > 0, np.arange(self.capacity + 1), 0)
        most = np.maximum.accumulate(sizes)  # the largest size in the pool up to each
        own = {self.size[i]: i for i in self.bins[b]}  # one piece of each size is enough
        best, gain = None, 0
        for give in ([], *([i] for i in own.values()), *map(list, combinations(own.values(), 2))):
            freed = sum(self.size[i] for i in give)
            x = int(most[min(room + freed, self.capacity)])
            if x - freed > gain:
                best, gain = ([x], give), x - freed
                if gain == room:
                    return best
        if not two:
            return best
        have = np.flatnonzero(sizes)
        for give in ([], *([i] for i in own.values())):
            limit = room + sum(self.size[i] for i in give)
            x = have[have < limit]
            if not len(x):
                continue
            y = most[limit - x]
            y = np.where((y == x) & (self.count[x] < 2), most[x - 1], y)
            total = np.where(y > 0, x + y, 0)
            k = int(total.argmax())
            got = int(total[k]) - (limit - room)
            if got > gain:
                best, gain = ([int(x[k]), int(y[k])], give), got
                if gain == room:
                    break
        return best

    def _apply(self, b: int, take: list[int], give: list[int]) -> set[int] | None:
        """Carries a step out; returns the bins that it changed besides ``b``, or None where it would not raise the squares."""
        taken = []
        for size in take:
            taken.append(self._take(size))
            self.fill[self.of[taken[-1]]] -= size
            taken[-1] = (taken[-1], self.of[taken[-1]])
            self.of[taken[-1][0]] = -1
        givers = sorted({d for _, d in taken}, key=lambda d: self.fill[d])
        back = sum(self.size[i] for i in give)
        gain, home = sum(take) - back, givers[0]  # what goes back goes to the emptiest giver
        before = {d: self.fill[d] + sum(self.size[i] for i, of in taken if of == d) for d in givers}
        after = {d: self.fill[d] + (back if d == home else 0) for d in givers}
        rise = (self.fill[b] + gain) ** 2 - self.fill[b] ** 2 + sum(after[d] ** 2 - before[d] ** 2 for d in givers)
        if after[home] > self.capacity or rise <= 0:
            for i, d in taken:
                self.of[i], self.fill[d] = d, before[d]
                self.pool[self.size[i]].append(i)
            return None
        for i, d in taken:
            self.count[self.size[i]] -= 1
            self.bins[d].discard(i)
            self.bins[b].add(i)
            self.of[i] = b
        for i in give:
            self.bins[b].discard(i)
            self.bins[home].add(i)
            self.of[i] = home
        self._offer(give)
        self.fill[home] += back
        self.fill[b] += gain
        self.steps += 1
        return {d for d in givers if self.bins[d]}


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return LocalSearch(bins, lengths, capacity).run()


def pack_group(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece."""
    bins = local_search(arrival_order(lengths, capacity), lengths, capacity)
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(bins):
        at = 0
        for i in items:
            bin_of[i], offset[i] = b, at
            at += int(lengths[i])
    return bin_of, offset


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, _row long, group long, bin long, offset long"


def _pack_frame(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_row", kind="stable", ignore_index=True)
        pdf["bin"], pdf["offset"] = pack_group(pdf["length"].to_numpy(), capacity)
        return pdf[["doc_id", "piece", "start", "length", "ids_crc32", "_row", "group", "bin", "offset"]]

    return run


def pack(docs: DataFrame, *, capacity: int = CAPACITY, vocabulary: str | None = None, group_rows: int = 12_000) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; sequences hold at most ``capacity`` tokens.

    ``group_rows`` is the mean number of short pieces packed together; groups are dealt by hash, so none is hot. Bins
    under 99.5 % of every group are pooled and packed once more, in groups of the same size.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.settle(cut_pieces(docs, capacity, vocabulary), "pieces")
    full = pieces.where(F.col("length") == capacity)
    short = pieces.where(F.col("length") < capacity)
    first = _round(short, short.count(), capacity, group_rows, scratch, "first")
    filled = first.groupBy("group", "bin").agg(F.sum("length").alias("_fill"))
    judged = scratch.settle(first.join(filled, ["group", "bin"]), "judged")
    done = judged.where(F.col("_fill") >= 0.995 * capacity)
    again = judged.where(F.col("_fill") < 0.995 * capacity).drop("group", "bin", "offset", "_fill")
    second = _round(again, again.count(), capacity, group_rows, scratch, "second")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    # sequence ids: three ranges that cannot meet
    numbered_id = F.col("group") * (1 << 24) + F.col("bin")
    parts = [
        done.withColumn("sequence_id", numbered_id * 4).select(columns),
        second.withColumn("sequence_id", numbered_id * 4 + 1).select(columns),
        full.withColumn("sequence_id", F.col("_row") * 4 + 2).withColumn("offset", F.lit(0).cast("long")).select(columns),
    ]
    out = scratch.settle(parts[0].unionByName(parts[1]).unionByName(parts[2]), "packed")
    scratch.keep(out)
    return out


def _round(rows: DataFrame, count: int, capacity: int, group_rows: int, scratch: Scratch, name: str) -> DataFrame:
    groups = max(1, round(count / group_rows))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("_row", F.lit(name)), F.lit(groups)))
    packed = dealt.select("doc_id", "piece", "start", "length", "ids_crc32", "_row", "group").groupBy("group").applyInPandas(_pack_frame(capacity), _PACKED)
    return scratch.settle(packed, name)
