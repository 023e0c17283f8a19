"""Conversation prefix trie (operator 12): succinct level-order tries per prefix shard, and heavy upper levels apart.

A node is a distinct sequence of first turns. Spark sorts all turns once by range; tasks carry 128-bit rolling digests
of the sequences, and what a task's range needs from those before it (one count and digest for each conversation cut by
a range's end) is added afterwards, so that a conversation may span any number of tasks. Nodes are grouped counts of
digests, pre-aggregated, however many conversations share them.

Nodes with more than ``shard`` turns below are *heavy*: the upper levels. What hangs below a heavy node is light and forms
whole subtrees, which are dealt to tasks and packed into shards of bounded size. numpy lays each shard out level by level
as a LOUDS bitvector (a 1 for each child, then a 0) with label arrays beside it; ``unfold_shards`` finds parents by rank
over the bits and rolls counts up in reverse level order with ``np.add.at``. Heavy levels are merged separately by pointer
doubling: round k adds the sums of nodes 2**k levels below, so that a chain of any depth takes a logarithm of rounds.

Digests of conversations that end at a node are hashed over sorted ranges: ranges are first joined into stretches of text
by the tasks that hold them, so that the one stream that SHA-256 needs reads stretches and not rows.

Defined results: a null role or text is empty; null turns come first, repeated turns are ordered by role and text; rows
that repeat are turns each; rows without conv_id belong to no conversation. A conversation left without turns is a member
of the root alone. Without any conversation there is no root and no row. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import _GRAM_STEP, _STEP, U64, Scratch, counted, longs, mix, powers
from strandline.llm.repair import CRC_TABLE, crc32_sql

#: Conversations of a block take their first turns from its first: these and the remainder of the crc are fixed values.
BLOCK, MOST_TAKEN = 20, 3
WORD = r"[^\x20\x09-\x0D]+"
_STEPS = (_STEP, _GRAM_STEP)

# ------------------------------------------------------------------ LOUDS


class Louds:
    """A forest in level order: bits of a super root and its nodes, and the parent of each node (-1 for tops)."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        ones = np.flatnonzero(bits)
        self.parent = ones - np.arange(len(ones)) - 1  # zeros before the i-th one, less the super root's own

    @classmethod
    def of_parents(cls, parent: np.ndarray) -> Louds:
        """Out of the parents of nodes that stand in level order."""
        children = np.bincount(parent + 1, minlength=len(parent) + 1)
        bits = np.ones(2 * len(parent) + 1, bool)
        bits[np.cumsum(children) + np.arange(len(parent) + 1)] = False
        return cls(bits)

    def children(self) -> np.ndarray:
        """How many children each node has."""
        return np.diff(np.flatnonzero(~self.bits))[: len(self.parent)] - 1

    def child_range(self, node: int) -> tuple[int, int]:
        """The nodes first..last (exclusive) below ``node``; -1 asks for the tops."""
        zeros = np.flatnonzero(~self.bits)
        start = 0 if node < 0 else int(zeros[node]) + 1
        first = start - (node + 1)
        return first, first + int(zeros[node + 1]) - start

    def levels(self) -> list[tuple[int, int]]:
        """First and last (exclusive) node of each level."""
        out, lo = [], 0
        hi = int(np.searchsorted(self.parent, 0))
        while lo < hi:
            out.append((lo, hi))
            lo, hi = hi, int(np.searchsorted(self.parent, hi))
        return out

    def roll_up(self, *values: np.ndarray) -> list[np.ndarray]:
        """Sums over the subtree of each node, by adding levels to the one above, from the last on."""
        sums = [v.astype(np.int64) for v in values]
        for lo, hi in reversed(self.levels()[1:]):
            for s in sums:
                np.add.at(s, self.parent[lo:hi], s[lo:hi])
        return sums


def level_order(depth: np.ndarray, key: np.ndarray, above: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, parents in that order) of a forest whose tops have parents that are not among the keys."""
    n = len(key)
    by_key = np.argsort(key, kind="stable")
    at = np.minimum(np.searchsorted(key[by_key], above), n - 1)
    parent = np.where(key[by_key][at] == above, by_key[at], -1)
    order, rank = np.zeros(n, np.int64), np.full(n + 1, -1, np.int64)  # the last stands for no parent
    # tops may stand at different depths: levels count from them
    level, by_depth, lo = np.zeros(n, np.int64), np.argsort(depth, kind="stable"), 0
    for hi in np.flatnonzero(np.append(np.diff(depth[by_depth]) > 0, True)).tolist():
        nodes = by_depth[lo : hi + 1]
        level[nodes] = np.where(parent[nodes] < 0, 0, level[parent[nodes]] + 1)
        lo = hi + 1
    ends, by_level, lo = np.cumsum(np.bincount(level)), np.argsort(level, kind="stable"), 0
    for hi in ends.tolist():
        nodes = by_level[lo:hi]
        nodes = nodes[np.lexsort((label[nodes], rank[parent[nodes]]))]
        order[lo:hi], rank[nodes] = nodes, np.arange(lo, hi)
        lo = hi
    return order, rank[parent[order]]


# ------------------------------------------------------------------ turns and digests

_SCAN = "part int, edge boolean, conv_id long, i long, h1 long, h2 long, g1 long, g2 long, words long"
_SCAN_ARROW = pa.schema([("part", pa.int32()), ("edge", pa.bool_()), *((c, pa.int64()) for c in ("conv_id", "i", "h1", "h2", "g1", "g2", "words"))])


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.ascontiguousarray(batch.column(name).to_numpy(zero_copy_only=False)).view(U64)


def _power(step: int, n: np.ndarray) -> np.ndarray:
    """step ** n modulo 2**64, for n of any size and sign."""
    out, low = np.ones(len(n), U64), U64(1)
    size, inverse = np.abs(n).astype(U64), pow(step, -1, 1 << 64)
    base = np.where(n < 0, U64(inverse), U64(step))
    while size.any():
        out = np.where(size & low, out * base, out)
        base, size = base * base, size >> low
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number turns and roll digests in sorted rows; a task starts from nothing, which ``number_turns`` mends.

    The last row of the first and of the last conversation of the task are marked: what later tasks start from.
    """
    from pyspark import TaskContext

    part, held, first = TaskContext.get().partitionId(), None, True
    conv, i, h = None, 0, [U64(0), U64(0)]
    for batch in batches:
        ids, n = batch.column("conv_id").to_numpy(), batch.num_rows
        if not n:
            continue
        begin = np.append(True, ids[1:] != ids[:-1])
        begin[0] = conv is None or ids[0] != conv
        run = np.maximum.accumulate(np.where(begin, np.arange(n), -1))  # where the conversation of a row begins, -1: before
        at = np.where(run < 0, i + np.arange(n) + 1, np.arange(n) - run + 1)
        sums = []
        for k, step in enumerate(_STEPS):
            value = mix(_unsigned(batch, f"l{k + 1}") | U64(1)) * _power(step, at)
            total = np.append(U64(0), np.cumsum(value, dtype=U64))
            start = np.where(run < 0, U64(0), total[np.maximum(run, 0)])
            sums += [total[1:] - start + np.where(run < 0, h[k], U64(0)), total[:-1] - start + np.where(run < 0, h[k], U64(0))]
        out = {"conv_id": ids, "i": at, "h1": sums[0], "h2": sums[2], "g1": sums[1], "g2": sums[3], "words": batch.column("words").to_numpy()}
        if held is not None:  # now it is known what follows the last row of the batch before
            held["edge"][-1] = first and bool(begin[0])
            first = first and not begin[0]
            yield _scanned(part, held)
        cuts = np.flatnonzero(begin[1:])
        edge = np.zeros(n, bool)
        if first and len(cuts):
            edge[cuts[0]], first = True, False
        held = {**out, "edge": edge}
        conv, i, h = ids[-1], int(at[-1]), [sums[0][-1], sums[2][-1]]
    if held is not None:
        held["edge"][-1] = True
        yield _scanned(part, held)


def _scanned(part: int, rows: dict) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(rows["i"]), part, np.int32)), pa.array(rows["edge"])]
    columns += [pa.array(rows[c]) if c in ("conv_id", "i", "words") else longs(rows[c]) for c in ("conv_id", "i", "h1", "h2", "g1", "g2", "words")]
    return pa.RecordBatch.from_arrays(columns, schema=_SCAN_ARROW)


def number_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, i (from 1), digests h of the first i turns and g of those before, and the words of turn i."""
    role, text, space = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.monotonically_increasing_id()
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    twice = scratch.settle(rows.groupBy("conv_id", "turn").count().where("count > 1").select(F.col("conv_id").alias("c"), F.col("turn").alias("t")), "repeated-turns")
    on = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
    digest = [F.xxhash64(F.lit(1), "role", "text").alias("l1"), F.xxhash64(F.lit(2), "text", "role").alias("l2")]
    # only turns of one number need their texts to be put in order
    tie = F.when(F.col("c").isNotNull(), F.struct("role", "text")).alias("tie")
    lean = scratch.settle(rows.join(counted(twice), on, "left").select("conv_id", "turn", tie, *digest, F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), space.alias("nth")), "turns")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("tie"), F.col("nth")]
    sorted_ = lean.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "l1", "l2", "words")
    scanned = scratch.settle(sorted_.mapInArrow(_scan, _SCAN), "scanned")
    carried: dict[int, tuple[int, int, tuple[int, int]]] = {}  # of each range the conversation that it goes on with
    conv, i, h = None, 0, (0, 0)
    for r in scanned.where("edge").select("conv_id", "part", "i", "h1", "h2").orderBy("part", "conv_id").collect():  # at most two rows a task
        if r.conv_id != conv:
            conv, i, h = r.conv_id, 0, (0, 0)
        elif i:
            carried[r.part] = conv, i, h
        h = tuple((a + (b % (1 << 64)) * pow(step, i, 1 << 64)) % (1 << 64) for a, b, step in zip(h, (r.h1, r.h2), _STEPS, strict=True))
        i += r.i

    def carry(batches):
        for batch in batches:
            part, ids = batch.column("part").to_numpy(), batch.column("conv_id").to_numpy()
            at = batch.column("i").to_numpy().copy()
            values = {c: _unsigned(batch, c).copy() for c in ("h1", "h2", "g1", "g2")}
            for p in np.unique(part).tolist():
                conv, n, h = carried.get(p, (None, 0, (0, 0)))
                rows = np.flatnonzero((part == p) & (ids == conv)) if n else np.zeros(0, np.int64)
                at[rows] += n
                for k, step in enumerate(_STEPS):
                    for name in (f"h{k + 1}", f"g{k + 1}"):
                        values[name][rows] = values[name][rows] * U64(pow(step, n, 1 << 64)) + U64(h[k])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at), *map(longs, values.values()), batch.column("words")], names=["conv_id", "i", "h1", "h2", "g1", "g2", "words"])

    return scratch.settle(scanned.mapInArrow(carry, "conv_id long, i long, h1 long, h2 long, g1 long, g2 long, words long"), "numbered")


_PATH = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, words long, below long"


def rebuilt_paths(numbered: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each conversation and depth of its rebuilt turns: node k, parent p, words of the turn, turns below."""
    heads = [F.max(F.when(F.col("i") == d, F.col(c))).alias(f"{c}_{d}") for d in range(1, MOST_TAKEN + 1) for c in ("h1", "h2", "words")]
    per = scratch.settle(numbered.groupBy("conv_id").agg(F.max("i").alias("n"), *heads), "heads")
    names = [f"{c}_{d}" for d in range(1, MOST_TAKEN + 1) for c in ("h1", "h2", "words")]
    base = per.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("bn"), *[F.col(c).alias(f"b_{c}") for c in names])
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_TAKEN + 1)).alias("h")
    plan = per.select("conv_id", "n", taken, (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"), *[F.col(c).alias(f"o_{c}") for c in names])
    plan = scratch.settle(plan.join(base, "base", "left").drop("base"), "plan")
    own = numbered.join(plan.select("conv_id", "n", "h", "bn", *[f"o_{c}" for c in names if c[0] == "h"], *[f"b_{c}" for c in names if c[0] == "h"]), "conv_id").where("i > h")
    return scratch.settle(own.mapInArrow(_own_rows, _PATH).unionByName(plan.mapInArrow(_taken_rows, _PATH)), "paths")


def _picked(batch: pa.RecordBatch, prefix: str, k: np.ndarray) -> list[np.ndarray]:
    """The two digests after k turns (0: none) out of the columns of the first few."""
    out = []
    for name in ("h1", "h2"):
        value = np.zeros(batch.num_rows, U64)
        for d in range(1, MOST_TAKEN + 1):
            column = batch.column(f"{prefix}_{name}_{d}").fill_null(0).to_numpy().view(U64)
            value = np.where(k == d, column, value)
        out.append(value)
    return out


def _taken(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, turns taken from the block's first conversation, turns of the rebuilt conversation)."""
    h = batch.column("h").to_numpy()
    k = np.minimum(h, batch.column("bn").fill_null(0).to_numpy())
    return h, k, k + np.maximum(batch.column("n").to_numpy() - h, 0)


def _path_batch(conv, depth, key, above, words, length) -> pa.RecordBatch:
    columns = [pa.array(conv), pa.array(depth), *map(longs, key), *map(longs, above), pa.array(words), pa.array(length - depth)]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PATH.split(", ")])


def _own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of its own, behind those taken: a digest of the tail moves to its new place by a power of the step."""
    for batch in batches:
        h, k, length = _taken(batch)
        begin, tail, key, above = _picked(batch, "b", k), _picked(batch, "o", h), [], []
        for j, step in enumerate(_STEPS):
            move = _power(step, k - h)
            key.append(begin[j] + move * (_unsigned(batch, f"h{j + 1}") - tail[j]))
            above.append(begin[j] + move * (_unsigned(batch, f"g{j + 1}") - tail[j]))
        yield _path_batch(batch.column("conv_id").to_numpy(), batch.column("i").to_numpy() - h + k, key, above, batch.column("words").to_numpy(), length)


def _taken_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The root's row of each conversation, and those of the turns that it takes over."""
    for batch in batches:
        _, k, length = _taken(batch)
        conv = batch.column("conv_id").to_numpy()
        for d in range(MOST_TAKEN + 1):
            rows = np.flatnonzero(k >= d)
            at = np.full(len(k), d)
            key, above = _picked(batch, "b", at), _picked(batch, "b", at - 1)
            words = batch.column(f"b_words_{d}").fill_null(0).to_numpy() if d else np.zeros(len(k), np.int64)
            yield _path_batch(conv[rows], at[rows], [x[rows] for x in key], [x[rows] for x in above], words[rows], length[rows])


# ------------------------------------------------------------------ nodes and the conversations that end at them

_NONE_SHA = hashlib.sha256(b"").hexdigest()
STRETCH_BYTES = 1 << 16


def ending_digests(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """depth, k1, k2, ends_sha256 of the nodes at which conversations end."""
    names, schema = ["depth", "k1", "k2"], "depth long, k1 long, k2 long, first long, ids string"

    def runs(batches, value):
        """(node, first value, list of values) of neighbouring rows of one node, in pieces of bounded size."""
        node, held, size = None, [], 0
        for batch in batches:
            for *at, v in zip(*[batch.column(c).to_pylist() for c in (*names, value)], strict=True):
                if held and (at != node or size >= STRETCH_BYTES):
                    yield node, held
                    held, size = [], 0
                node = at
                held.append(v)
                size += len(str(v)) + 1
        if held:
            yield node, held

    def join(batches):
        rows = []
        for node, held in runs(batches, "conv_id"):
            rows.append({**dict(zip(names, node, strict=True)), "first": held[0], "ids": ",".join(map(str, held))})
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def digest(batches):
        rows, last, sha = [], None, None
        for node, held in runs(batches, "ids"):
            if node != last:
                if last is not None:
                    rows.append({**dict(zip(names, last, strict=True)), "ends_sha256": sha.hexdigest()})
                last, sha = node, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(",".join(held).encode())
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema=made)
                rows = []
        if last is not None:
            rows.append({**dict(zip(names, last, strict=True)), "ends_sha256": sha.hexdigest()})
        yield pa.RecordBatch.from_pylist(rows, schema=made)

    keys = [(c, pa.int64()) for c in names]
    arrow, made = pa.schema([*keys, ("first", pa.int64()), ("ids", pa.string())]), pa.schema([*keys, ("ends_sha256", pa.string())])
    order = [*names, "conv_id"]
    stretches = scratch.settle(paths.where("below = 0").select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, schema), "stretches")
    return stretches.repartition(*names).sortWithinPartitions(*names, "first").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def trie_nodes(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each node: key, parent key, smallest member, members, tokens that sharing its turn saves, turns below."""
    keys = ["depth", "k1", "k2"]
    nodes = paths.groupBy(*keys).agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.sum("below").alias("below"))
    nodes = nodes.join(ending_digests(paths, scratch), keys, "left").withColumn("saved", (F.col("n_convs") - 1) * F.col("words")).drop("words")
    return scratch.settle(nodes.fillna({"ends_sha256": _NONE_SHA}), "nodes")


# ------------------------------------------------------------------ shards

_SHARD = "louds binary, k1 array<long>, k2 array<long>, depth array<long>, conv_id array<long>, n_convs array<long>, saved array<long>, p1 array<long>, p2 array<long>, ends array<string>"
_ARRAYS = ["k1", "k2", "depth", "conv_id", "n_convs", "saved", "p1", "p2"]


def light_shards(nodes: DataFrame, paths: DataFrame, heavy: DataFrame, shard: int) -> DataFrame:
    """Light nodes as LOUDS shards: bits, and arrays in level order. Whole subtrees of heavy nodes share a shard.

    A light node belongs to the first light node on the path of its smallest member. At most ``shard`` turns hang below
    such a node, which bounds a subtree, and a task closes a shard as soon as it holds that many nodes.
    """
    keys = ["depth", "k1", "k2"]
    upper = counted(heavy.select(*keys))
    tops = paths.select("conv_id", *keys).join(upper, keys, "left_anti").groupBy("conv_id").agg(F.min_by("k1", "depth").alias("s1"), F.min_by("k2", "depth").alias("s2"))
    light = nodes.join(upper, keys, "left_anti").join(tops, "conv_id")

    def build(batches):
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            s1, s2 = batch.column("s1").to_numpy(), batch.column("s2").to_numpy()
            if not len(s1):
                continue
            same = last is not None and (s1[0], s2[0]) == last
            new = np.flatnonzero(np.append(not same, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])))
            lo = 0
            for cut in new.tolist():  # a shard may end where a subtree begins
                if size + cut - lo >= shard:
                    held.append(batch.slice(lo, cut - lo))
                    yield _shard_of(held)
                    held, size, lo = [], 0, cut
            held.append(batch.slice(lo))
            size += batch.num_rows - lo
            last = s1[-1], s2[-1]
        if size:
            yield _shard_of(held)

    return light.repartition("s1", "s2").sortWithinPartitions("s1", "s2").mapInArrow(build, _SHARD)


def _shard_of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches)
    column = {c: t.column(c).to_numpy() for c in _ARRAYS}
    pair = lambda a, b, d: np.rec.fromarrays([column[d[0]] + d[1], column[a], column[b]])
    key, above = pair("k1", "k2", ("depth", 0)), pair("p1", "p2", ("depth", -1))
    _, at = np.unique(np.concatenate([key, above]), return_inverse=True)
    at = at.ravel()
    order, parent = level_order(column["depth"], at[: len(key)], at[len(key) :], column["k1"])
    bits = Louds.of_parents(parent).bits
    arrays = [pa.array([np.packbits(bits).tobytes()]), *[pa.array([column[c][order]]) for c in _ARRAYS], pa.array([t.column("ends_sha256").take(pa.array(order)).to_pylist()])]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _SHARD.split(", ")])


_NODE = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"


def unfold_shards(shards: DataFrame) -> DataFrame:
    """Nodes out of LOUDS shards, with children, leaves and saved tokens of their subtrees; ``top`` hangs below a heavy one."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["k1"])
                trie = Louds(np.unpackbits(np.frombuffer(row["louds"], np.uint8), count=2 * n + 1).astype(bool))
                children, parent = trie.children(), trie.parent
                leaves, saved = trie.roll_up(children == 0, np.array(row["saved"], np.int64))
                conv = np.array(row["conv_id"], np.int64)
                above = pa.array(np.where(parent >= 0, conv[np.maximum(parent, 0)], 0), mask=parent < 0)
                columns = [*[pa.array(row[c], pa.int64()) for c in ("depth", "k1", "k2", "p1", "p2", "conv_id")], above, pa.array(row["n_convs"], pa.int64()), *map(pa.array, (children, leaves, saved)), pa.array(row["ends"], pa.string()), pa.array(parent < 0)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _NODE.split(", ")])

    return shards.mapInArrow(run, _NODE)


# ------------------------------------------------------------------ upper levels


def merge_upper(heavy: DataFrame, light: DataFrame, scratch: Scratch) -> DataFrame:
    """Heavy nodes with children and subtree sums, by pointer doubling over their own levels."""
    key, up = ["depth", "k1", "k2"], [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    tops = light.where("top and depth > 0").select(*up, F.lit(1).alias("child"), "n_leaves", "saved_tokens")
    inner = heavy.where("depth > 0").select(*up, F.lit(1).alias("child"), F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens"))
    below = tops.unionByName(inner).groupBy(*key).agg(F.sum("child").alias("n_children"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    base = heavy.join(below, key, "left").fillna(0, ["n_children", "l", "s"]).withColumn("s", F.col("s") + F.col("saved"))
    base = scratch.settle(base.withColumns({"a1": F.col("p1"), "a2": F.col("p2")}), "upper")
    depth, reach, now = base.agg(F.max("depth")).first()[0] or 0, 1, base
    while reach <= depth:  # a1, a2: the node ``reach`` levels above; sums: over nodes less than ``reach`` levels below
        far = now.where(F.col("depth") >= reach)
        gain = far.select((F.col("depth") - reach).alias("depth"), F.col("a1").alias("k1"), F.col("a2").alias("k2"), "l", "s").groupBy(*key).agg(F.sum("l").alias("dl"), F.sum("s").alias("ds"))
        step = now.select((F.col("depth") + reach).alias("depth"), F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")).where(F.col("depth") >= 2 * reach)
        moved = now.join(gain, key, "left").join(step, ["depth", "a1", "a2"], "left")
        new = moved.select(*[c for c in base.columns if c not in ("l", "s", "a1", "a2")], (F.col("l") + F.coalesce("dl", F.lit(0))).alias("l"), (F.col("s") + F.coalesce("ds", F.lit(0))).alias("s"), F.coalesce("b1", F.lit(0)).alias("a1"), F.coalesce("b2", F.lit(0)).alias("a2"))
        now, reach = scratch.settle(new, "upper"), 2 * reach
    parent = heavy.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = now.join(parent, ["depth", "p1", "p2"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("l").alias("n_leaves"), F.col("s").alias("saved_tokens"), "ends_sha256")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_tries(conversations: DataFrame, scratch: Scratch, shard: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(LOUDS shards of the light subtrees, heavy nodes of the upper levels), both written."""
    paths = rebuilt_paths(number_turns(conversations, scratch), scratch)
    nodes = trie_nodes(paths, scratch)
    heavy = scratch.settle(nodes.where(F.col("below") > shard), "heavy")
    return scratch.settle(light_shards(nodes, paths, heavy, shard), "shards"), heavy


def trie_report(conversations: DataFrame, *, shard: int = 1 << 16) -> DataFrame:
    """Every node of the trie of the rebuilt conversations, with its counts and rollups."""
    scratch = Scratch(conversations.sparkSession, "tries")
    shards, heavy = prefix_tries(conversations, scratch, shard)
    light = scratch.settle(unfold_shards(shards), "light")
    above = heavy.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("heavy_conv"))
    known = light.join(counted(scratch.settle(above, "above")), ["depth", "p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "heavy_conv"))
    result = scratch.settle(known.select(*RESULT).unionByName(merge_upper(heavy, light, scratch).select(*RESULT)), "nodes")
    scratch.keep(result)
    return result


ORACLE = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
r AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d FROM (
    SELECT c.conv_id, t.role, t.text, 0 AS own, t.i FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.i <= c.h
    UNION ALL SELECT c.conv_id, t.role, t.text, 1, t.i FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h)
), p AS (
  SELECT conv_id, d, list(sha256(role || chr(0) || text)) OVER (PARTITION BY conv_id ORDER BY d) AS k, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words FROM r
  UNION ALL SELECT conv_id, 0, [], 0 FROM c
), e AS (SELECT conv_id, max(d) AS n FROM p GROUP BY 1),
m AS (SELECT p.*, min(p.conv_id) OVER (PARTITION BY k) AS top, d = n AS ends FROM p JOIN e USING (conv_id)),
n AS (
  SELECT top AS conv_id, d AS depth, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY top, d
), u AS (SELECT n.conv_id, n.depth, m.top AS parent_conv_id FROM n LEFT JOIN m ON m.conv_id = n.conv_id AND m.d = n.depth - 1),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
s AS (
  SELECT m.top AS conv_id, m.d AS depth, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens
  FROM n LEFT JOIN k ON k.conv_id = n.conv_id AND k.depth = n.depth JOIN m ON m.conv_id = n.conv_id AND m.d <= n.depth GROUP BY ALL
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN u USING (conv_id, depth) JOIN s USING (conv_id, depth) LEFT JOIN k USING (conv_id, depth)
"""
