"""MinHash near-dedup (operator 2): a chosen-path set similarity join.

A document's set is its distinct 2-word shingles as 64-bit hashes. Documents with equal sets form one class (found by a
128-bit digest of the set), and only class representatives are joined. ``trees`` independent trees branch them from the
root: a node names one position of the minwise signature, every other node a second one, and a document goes to the
children of its tokens at those positions. Level by level, nodes are judged by their counted size:

* A node of at most ``node_rows`` documents ends: all its pairs are compared, by size (a pair over the threshold has sizes
  within it) and by the sketch (128 signature positions, 2 bits each) that each row carries.
* A larger node compares its documents with up to ``LEADERS`` of them (every ``lead_every`` levels); what this finds is
  confirmed and united. A node of one component ends: a group of near copies, however large, needs no more than leaders.
* In other larger nodes only the strays, the documents outside the main component, can still link components. Where they
  are few (``few_strays``) they are compared with all documents of the node, in blocks of bounded size; else the node
  branches. What is left at ``last_depth`` is compared in blocks, too: no node is cut off.

Similar pairs never leave a node one by one. A node gives each document its most similar smaller partner, a forest of one
pair a document that settles nearly all groups once confirmed; the matrix of its other pairs stays with the node. When
all levels are done, nodes with similar pairs of different components are opened: the full sets of those documents
come to the node once, all its pairs are confirmed there, and only links that unite leave it. Full sets are computed from
whole texts, and every link is confirmed on them.

A pair of similarity s meets in a child with probability 1 - (1 - s)(1 - s / 2) at least, so for s = 0.8 its expected
number of common children is 1.2: the chance q to share a node of depth d falls from 0.88 to 0.81, 0.76, 0.73 and never
under 0.625. Trees choose from the same 128 positions, so a pair that agrees at few of them is missed by all: with the
number of agreeing positions binomial (128, 0.8), ten trees miss a pair at the threshold with probability 4e-6 at depth 3,
7e-5 at depth 6, 2e-4 at depth 8 and 5e-4 at depth 12, the last. The sketch loses another 3e-5.

Defined results: null and empty texts have the empty set, 0 shingles, and link with nothing (component is the own id);
one word is one shingle; repeated rows share id and component; a null id has a null component and is kept. Rows that
repeat an id with different texts are one document: the text of the smallest digest is compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import BLANK_WORDS, LOWER, U64, Scratch, components, counted, longs, mix, stars, word_slices

POSITIONS = 128
LEADERS = 8
_U32 = np.uint32
_MULTIPLY = (mix(np.arange(1, POSITIONS + 1, dtype=U64)) >> U64(32)).astype(_U32) | _U32(1)
_ADD = (mix(np.arange(1001, POSITIONS + 1001, dtype=U64)) >> U64(32)).astype(_U32)
#: Groups that are confirmed together hold about this many shingles (one document may hold more).
GROUP_SHINGLES = 1 << 21
#: Nodes of a level that a row of a block knows; a pair that shares only later ones may be marked twice.
KNOWN = 32


# ------------------------------------------------------------------ sets and signatures


def gram_slices(texts: pa.Array, n: int):
    """(owner, hash) arrays of the n-word shingles of slices of texts, owners ascending, with repeats.

    A text of fewer words, but not none, has the hash of its whole sequence.
    """
    for lo, _, w in word_slices(texts, BLANK_WORDS, LOWER):
        grams, whole = w.grams(n)
        owner, hashes = w.doc[: len(grams)][whole], grams[whole]
        count = np.diff(w.first)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            own = []
            for i in short.tolist():
                h = U64(count[i])
                for x in w.hash[w.first[i] : w.first[i + 1]]:
                    h = mix(np.array([h * U64(31) + x], U64))[0]
                own.append(h)
            owner, hashes = np.append(owner, short + lo), np.append(hashes, np.array(own, U64))
            order = np.argsort(owner, kind="stable")
            owner, hashes = owner[order], hashes[order]
        if len(owner):
            yield owner, hashes


def distinct_sets(texts: pa.Array, n: int):
    """(rows, starts, hashes) of slices of texts: the sorted distinct hashes of each row that has words."""
    for owner, hashes in gram_slices(texts, n):
        hashes = hashes.copy()
        cuts = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner)).tolist()
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            hashes[i:j].sort()
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        owner, hashes = owner[new], hashes[new]
        rows, starts = np.unique(owner, return_index=True)
        yield rows, starts, hashes


def digests(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.add.reduceat(mix(h), starts) for h in (hashes ^ U64(0x5851F42D4C957F2D), hashes + U64(0x14057B7EF767814F)))


def signature_tokens(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(rows, POSITIONS) minwise tokens, folded to 16 bits."""
    low = (hashes >> U64(32)).astype(_U32)
    out = np.zeros((len(starts), POSITIONS), np.uint16)
    for p in range(POSITIONS):
        least = np.minimum.reduceat(low * _MULTIPLY[p] + _ADD[p], starts)
        out[:, p] = (least * _U32(0x9E3779B1)) >> _U32(16)
    return out


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (two longs) and minwise tokens of every row."""

    def run(batches):
        for batch in batches:
            count = batch.num_rows
            size, d1, d2 = np.zeros(count, np.int64), np.zeros(count, U64), np.zeros(count, U64)
            sigs: list[bytes | None] = [None] * count
            for rows, starts, hashes in distinct_sets(batch.column(1), n):
                size[rows] = np.diff(np.append(starts, len(hashes)))
                d1[rows], d2[rows] = digests(hashes, starts)
                for i, s in zip(rows.tolist(), signature_tokens(hashes, starts), strict=True):
                    sigs[i] = s.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), longs(d1), longs(d2), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


# ------------------------------------------------------------------ trees


def roots(trees: int) -> np.ndarray:
    return mix(np.arange(1, trees + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def children(key: np.ndarray, sig: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) of nodes ``key`` that hold the documents ``sig[row]``: one child, or two where the node branches twice."""
    first = mix(key + U64(0x632BE59BD9B4E019))
    second = (first + U64(1) + mix(key + U64(0x8CB92BA72F3D8DD7)) % U64(POSITIONS - 1)) % U64(POSITIONS)
    first %= U64(POSITIONS)
    twice = mix(key + U64(0x1D8E4E27C47D124F)) >> U64(63) == 1
    row, key, position = np.append(row, row[twice]), np.append(key, key[twice]), np.append(first, second[twice])
    token = sig[row, position.astype(np.int64)].astype(U64)
    return row, mix(key ^ ((token << U64(8)) | position) ^ U64(0xA0761D6478BD642F))


_LANE = U64(0x5555555555555555)


def sketches(sig: np.ndarray) -> np.ndarray:
    """(documents, 4) words: two bits of each position."""
    two = (sig & np.uint16(3)).astype(U64).reshape(len(sig), 4, 32)
    return (two << (U64(2) * np.arange(32, dtype=U64))).sum(axis=2, dtype=U64)


def matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal positions of sketches; shapes broadcast over the last axis of 4 words."""
    x = a ^ b
    return POSITIONS - np.bitwise_count((x | (x >> U64(1))) & _LANE).sum(axis=-1, dtype=np.int64)


def least_matches(threshold: float, deviations: float = 4.0) -> int:
    """Equal sketch positions that a pair over the threshold reaches but for ``deviations`` standard deviations."""
    p = threshold + (1 - threshold) / 4
    return int(np.floor(POSITIONS * p - deviations * np.sqrt(POSITIONS * p * (1 - p))))


class Rule:
    """What a pair must reach: over / under on full sets, and what of it sizes and sketches can tell."""

    def __init__(self, shingle: int, over: int, under: int):
        self.shingle, self.over, self.under, self.least = shingle, over, under, least_matches(over / under)

    def close(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.minimum(x, y) * self.under >= np.maximum(x, y) * self.over

    def holds(self, both, x, y):
        return (both > 0) & (both * self.under >= (x + y - both) * self.over)


_SKETCH = ["s0", "s1", "s2", "s3"]
_ROW = "key long, doc_id long, n_shingles long, s0 long, s1 long, s2 long, s3 long"
_COLUMNS = ["key", "doc_id", "n_shingles", *_SKETCH]


def _u64(column) -> np.ndarray:
    return np.asarray(column).astype(np.int64, copy=False).view(U64)


def _matrix(table) -> np.ndarray:
    return np.stack([_u64(table.column(s)) for s in _SKETCH], axis=1)


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS) if len(column) else np.zeros((0, POSITIONS), np.uint16)


def _rows(ids, sizes, sk, row, key) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([longs(key), pa.array(ids[row]), pa.array(sizes[row]), *(longs(sk[row, k]) for k in range(4))], names=_COLUMNS)


def first_rows(reps: DataFrame, trees: int) -> DataFrame:
    """One row for each representative and node of depth 1; with ``trees`` 0 the root of one tree instead."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sig = _tokens(part.column(2))
                ids, sizes = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                row, key = np.repeat(np.arange(len(sig)), max(trees, 1)), np.tile(roots(max(trees, 1)), len(sig))
                if trees:
                    row, key = children(key, sig, row)
                yield _rows(ids, sizes, sketches(sig), row, key)

    return reps.select("doc_id", "n_shingles", "sig").mapInArrow(run, _ROW)


def next_rows(nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """The children of node rows (key, doc_id); tokens come to each document once, whatever the number of its nodes."""

    def run(batches):
        for batch in batches:
            sig = _tokens(batch.column(2))
            ids, sizes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            keys = batch.column(3)
            row = np.repeat(np.arange(len(sig)), np.diff(keys.offsets.to_numpy()))
            row, key = children(_u64(keys.flatten()), sig, row)
            yield _rows(ids, sizes, sketches(sig), row, key)

    own = nodes.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))  # at most trees * 1.5 ** depth keys
    return own.join(reps, "doc_id").select("doc_id", "n_shingles", "sig", "keys").mapInArrow(run, _ROW)


# ------------------------------------------------------------------ comparison by sketch

_FOUND = "a long, b long, m int, ids array<long>, similar binary"


def _found(a, b, m, groups) -> pa.RecordBatch:
    """Pairs (a < b) with their matches, then groups (ids, upper matrix of similar pairs), as rows of one table."""
    n, g = len(a), len(groups)
    none = np.zeros(g, np.int64)
    mask = np.append(np.zeros(n, bool), np.ones(g, bool))
    long = lambda x, t: pa.array(np.append(x, none), t, mask=mask)
    ids = pa.array([None] * n + [x for x, _ in groups], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([long(a, pa.int64()), long(b, pa.int64()), long(m, pa.int32()), ids, pa.array([None] * n + [x for _, x in groups], pa.binary())], names=["a", "b", "m", "ids", "similar"])


def bounded_groups(ids: np.ndarray, sizes: np.ndarray, similar: np.ndarray):
    """The documents with similar pairs (``similar`` is upper), as one group or, where their sets are large, as several."""
    used = np.flatnonzero(similar.any(axis=0) | similar.any(axis=1))
    ids, sizes, similar = ids[used], sizes[used], similar[np.ix_(used, used)]
    chunk = (np.cumsum(sizes) - sizes) // (GROUP_SHINGLES // 2)
    parts = [np.flatnonzero(chunk == c) for c in np.unique(chunk)]
    if len(parts) <= 2:
        yield ids, np.packbits(similar).tobytes()
        return
    for x, left in enumerate(parts):
        for right in parts[x:]:
            at = left if right is left else np.concatenate([left, right])
            own = similar[np.ix_(at, at)].copy()
            if right is not left:  # pairs inside a part have a group of their own
                own[: len(left), : len(left)] = own[len(left) :, len(left) :] = False
            if own.any():
                yield ids[at], np.packbits(own).tobytes()


def sorted_runs(batches, key: str = "key"):
    """Tables of whole runs of equal keys from batches that are sorted by key."""
    kept: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1]))  # keys ascend: where the last run begins
        if kept and k[0] != kept[0].column(key)[0].as_py():
            yield pa.Table.from_batches(kept).combine_chunks()
            kept = []
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks()
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def compare_nodes(rule: Rule, cells: int = 1 << 18):
    """All pairs of each small node, nodes of equal size at once."""

    def run(batches):
        for table in sorted_runs(batches):
            key, ids, sizes = (np.asarray(table.column(c)) for c in _COLUMNS[:3])
            sk = _matrix(table)
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            width = np.diff(np.append(starts, len(key)))
            out, groups = [], []
            for k in np.unique(width[width > 1]).tolist():
                of_k = starts[width == k]
                for lo in range(0, len(of_k), max(1, cells // (k * k))):
                    at = of_k[lo : lo + max(1, cells // (k * k)), None] + np.arange(k)
                    i, n, s = ids[at], sizes[at], sk[at]
                    m = matches(s[:, :, None], s[:, None, :])
                    similar = (m >= rule.least) & rule.close(n[:, :, None], n[:, None, :]) & np.triu(np.ones((k, k), bool), 1)
                    m = np.where(similar, m, -1)
                    best, most = m.argmax(axis=1), m.max(axis=1)
                    node, b = np.nonzero(most >= 0)
                    out.append((i[node, best[node, b]], i[node, b], most[node, b]))
                    for x in np.flatnonzero(similar.sum(axis=(1, 2)) > (most >= 0).sum(axis=1)).tolist():
                        groups += bounded_groups(i[x], n[x], similar[x])
            if out:
                yield _found(*(np.concatenate(x) for x in zip(*out, strict=True)), groups)

    return run


def compare_leaders(rule: Rule):
    """For each row of a large node its most similar leader, as a pair."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).combine_chunks()
            ids, sizes, sk = np.asarray(table.column("doc_id")), np.asarray(table.column("n_shingles")), _matrix(table)
            leaders = batch.column(batch.schema.get_field_index("leaders"))
            row = np.repeat(np.arange(len(ids)), np.diff(leaders.offsets.to_numpy()))
            lead = pa.Table.from_batches([pa.RecordBatch.from_struct_array(leaders.flatten())])
            other = np.asarray(lead.column("doc_id"))
            m = matches(sk[row], _matrix(lead))
            ok = (m >= rule.least) & rule.close(sizes[row], np.asarray(lead.column("n_shingles"))) & (other != ids[row])
            row, other, m = row[ok], other[ok], m[ok]
            order = np.lexsort((-m, row))
            row, other, m = row[order], other[order], m[order]
            first = np.unique(row, return_index=True)[1]
            a, b = other[first], ids[row[first]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(m[first].astype(np.int32))], names=["a", "b", "m"])

    return run


def compare_blocks(rule: Rule):
    """Groups of similar pairs of different components, of a block of strays and a block of rows.

    A pair is marked once: in the first of the nodes that its documents share, and of two strays by the smaller id.
    """

    def run(key, table):
        ids, comp, stray, sizes, out = (np.asarray(table.column(c)) for c in ("doc_id", "component", "stray", "n_shingles", "out"))
        sk, node = _matrix(table), key[0].as_py()
        earlier = [np.array([k for k in x if k < node], np.int64) for x in table.column("nodes").to_pylist()]
        owner, before = np.repeat(np.arange(len(ids)), [len(x) for x in earlier]), np.concatenate(earlier)
        left, right = np.flatnonzero(stray == 1), np.flatnonzero(stray == 0)
        both = np.append(left, right)
        # a stray may be among the rows, too: each document once
        both = both[np.sort(np.unique(ids[both], return_index=True)[1])]
        place = {int(d): k for k, d in enumerate(ids[both])}
        similar = np.zeros((len(both), len(both)), bool)
        for i in left:
            met = np.zeros(len(ids), bool)
            met[owner[np.isin(before, earlier[i])]] = True
            hit = right[(comp[right] != comp[i]) & ~met[right] & ((out[right] == 0) | (ids[right] > ids[i]))]
            hit = hit[(matches(sk[i], sk[hit]) >= rule.least) & rule.close(sizes[i], sizes[hit])]
            for j in hit:
                x, y = sorted((place[int(ids[i])], place[int(ids[j])]))
                similar[x, y] = True
        groups = list(bounded_groups(ids[both], sizes[both], similar)) if similar.any() else []
        return pa.Table.from_batches([_found([], [], [], groups)])

    return run


# ------------------------------------------------------------------ confirmation on full sets


def full_sets(source: "Source", ids: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """id, hashes (sorted) of the given ids, from whole texts."""

    def run(batches):
        for batch in batches:
            given = _u64(batch.column(2))
            for rows, starts, hashes in distinct_sets(batch.column(1), n):
                same = (digests(hashes, starts)[0] == given[rows]).tolist()  # of several texts of one id the chosen one
                ends = np.append(starts[1:], len(hashes))
                took = [(r, hashes[a:b]) for r, a, b, s in zip(rows.tolist(), starts.tolist(), ends.tolist(), same, strict=True) if s]
                if took:
                    lengths = np.cumsum([0, *(len(h) for _, h in took)])
                    lists = pa.LargeListArray.from_arrays(pa.array(lengths, pa.int64()), longs(np.concatenate([h for _, h in took]))).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r for r, _ in took])), lists], names=["id", "hashes"])

    wanted = scratch.settle(ids.select(F.col("id").alias("doc_id")).distinct().join(source.chosen, "doc_id"), "wanted")
    texts = source.docs.join(counted(wanted), "doc_id").select("doc_id", "text", "d1")
    sets = texts.mapInArrow(run, "id long, hashes array<long>")
    out = scratch.settle(sets.dropDuplicates(["id"]) if source.repeats else sets, "sets")
    scratch.drop(wanted)
    return out


def _list_parts(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    return _u64(column.flatten()), ends - ends[0]


def common_items(p: np.ndarray, q: np.ndarray) -> int:
    """Items that two sorted sets share."""
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    return int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0


def star_members(pairs: DataFrame, most: int = 256) -> DataFrame:
    """Pairs (a, b) as groups of a document and at most about ``most`` of its partners: gid, pos, id."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / most).alias("_parts"))
    dealt = pairs.join(sizes, "a").withColumn("gid", F.xxhash64("a", F.pmod(F.xxhash64("b"), "_parts")))
    return dealt.select("gid", F.lit(0).alias("pos"), F.col("a").alias("id")).distinct().unionByName(dealt.select("gid", F.lit(1).alias("pos"), F.col("b").alias("id")))


def group_links(ids: np.ndarray, values: np.ndarray, ends: np.ndarray, similar: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Links among the documents of a group that unite them, of the pairs marked in ``similar``; all pairs are confirmed."""
    size = np.diff(ends)
    x, y = np.nonzero(similar & rule.close(size[:, None], size[None, :]))
    if len(x) <= 2 * len(ids):
        keep = np.array([bool(rule.holds(common_items(values[ends[i] : ends[i + 1]], values[ends[j] : ends[j + 1]]), size[i], size[j])) for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)
    else:  # intersections of all pairs as a product of the incidence matrix, in slices of columns
        _, column, count = np.unique(values, return_inverse=True, return_counts=True)
        shared = count > 1
        number = np.cumsum(shared) - 1
        row = np.repeat(np.arange(len(ids)), size)
        use = shared[column]
        row, column = row[use], number[column[use]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros((len(ids), len(ids)), np.float32)
        for lo in range(0, int(shared.sum()), 4096):
            a, b = np.searchsorted(column, [lo, lo + 4096])
            part = np.zeros((len(ids), 4096), np.float32)
            part[row[a:b], column[a:b] - lo] = 1
            both += part @ part.T
        keep = rule.holds(both[x, y].astype(np.int64), size[x], size[y])
    return stars(ids, x[keep], y[keep])


def _confirm_groups(rule: Rule):
    def run(batches):
        for table in sorted_runs(batches, "gid"):
            gid = np.asarray(table.column("gid"))
            values, ends = _list_parts(table.column("hashes"))
            ids, bits = np.asarray(table.column("id").fill_null(0)), table.column("similar")
            start = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
            out = []
            for lo, hi in zip(start.tolist(), np.append(start[1:], len(gid)).tolist(), strict=True):
                packed = bits[lo].as_py()
                lo += packed is not None  # the matrix has a row of its own, before the documents
                n = hi - lo
                if packed is None:
                    similar = np.zeros((n, n), bool)
                    similar[:1, 1:] = True
                else:
                    similar = np.unpackbits(np.frombuffer(packed, np.uint8), count=n * n).reshape(n, n).astype(bool)
                out.append(group_links(ids[lo:hi], values[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo], similar, rule))
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirm(members: DataFrame, matrices: DataFrame | None, source: "Source", rule: Rule, scratch: Scratch, name: str) -> DataFrame:
    """Links that unite documents of groups (gid, pos, id), of the pairs that ``matrices`` (gid, similar) mark.

    Without a matrix a group is a star around its first document. Each set comes to a group once, from whole texts.
    """
    members = scratch.settle(members, f"members-{name}")
    sets = full_sets(source, members.select("id"), scratch, rule.shingle)
    rows = sets.join(counted(members), "id").select("gid", "pos", "id", F.lit(None).cast("binary").alias("similar"), "hashes")
    if matrices is not None:
        rows = rows.unionByName(matrices.select("gid", F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("id"), "similar", F.lit(None).cast("array<long>").alias("hashes")))
    rows = rows.repartition("gid").sortWithinPartitions("gid", "pos")
    links = scratch.settle(rows.mapInArrow(_confirm_groups(rule), "a long, b long").distinct(), f"links-{name}")
    scratch.drop(members, sets)
    return links


# ------------------------------------------------------------------ components


class Labels:
    """The component of every linked document; new links unite components."""

    def __init__(self, spark, scratch: Scratch):
        self.scratch, self.spark = scratch, spark
        self.frame = spark.createDataFrame([], "id long, component long")

    def ends(self, pairs: DataFrame) -> DataFrame:
        """Pairs with the components ca, cb of both ends (an end without links is its own component)."""
        la, lb = (self.frame.toDF(x, f"c{x}") for x in "ab")
        return pairs.join(la, "a", "left").join(lb, "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})

    def unite(self, links: DataFrame) -> None:
        if links.isEmpty():
            return
        roots_ = components(self.spark, self.ends(links).select(F.col("ca").alias("a"), F.col("cb").alias("b")), self.scratch)
        moved = self.frame.join(roots_.toDF("component", "root"), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        new = roots_.join(self.frame.select("id"), "id", "left_anti")
        before, self.frame = self.frame, self.scratch.settle(moved.unionByName(new), "labels")
        self.scratch.release(roots_, before)


def _best(pairs: DataFrame, *keys: str) -> DataFrame:
    """Of the pairs of equal keys the most similar one."""
    best = pairs.groupBy(*keys).agg(F.max(F.struct("m", (-F.col("a")).alias("_a"), "b")).alias("_x"))
    return best.select((-F.col("_x._a")).alias("a"), F.col("_x.b").alias("b"))


def open_groups(groups: DataFrame, labels: Labels, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Members (gid, pos, id) and matrices (gid, similar) of the groups with similar pairs of different components.

    Groups are cut to the documents of such pairs.
    """
    named = scratch.settle(groups.select(F.xxhash64("ids", "similar").alias("gid"), "ids", "similar").dropDuplicates(["gid"]), "groups")
    members = named.select("gid", F.posexplode("ids").alias("pos", "id")).join(labels.frame, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = members.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.array_sort(F.collect_list(F.struct("pos", "component"))).alias("of")).where("lo < hi")

    def run(batches):
        for batch in batches:
            gids, pos, ids_, bits = [], [], [], []
            for gid, ids, similar, of in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                n, c = len(ids), np.array([x["component"] for x in of], np.int64)
                pairs = np.unpackbits(np.frombuffer(similar, np.uint8), count=n * n).reshape(n, n).astype(bool) & (c[:, None] != c[None, :])
                used = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
                if len(used):
                    gids += [gid] * (len(used) + 1)
                    pos += range(-1, len(used))
                    ids_ += [None, *np.array(ids, np.int64)[used].tolist()]
                    bits += [np.packbits(pairs[np.ix_(used, used)]).tobytes(), *[None] * len(used)]
            yield pa.RecordBatch.from_arrays([pa.array(gids, pa.int64()), pa.array(pos, pa.int32()), pa.array(ids_, pa.int64()), pa.array(bits, pa.binary())], names=["gid", "pos", "id", "similar"])

    rows = scratch.settle(named.join(mixed.select("gid", "of"), "gid").select("gid", "ids", "similar", "of").mapInArrow(run, "gid long, pos int, id long, similar binary"), "open")
    return rows.where("pos >= 0").select("gid", "pos", "id"), rows.where("pos < 0").select("gid", "similar")


# ------------------------------------------------------------------ large nodes


def with_leaders(big: DataFrame) -> DataFrame:
    """Rows of large nodes with the smallest of each of LEADERS parts of their node, dealt by hash."""
    one = big.groupBy("key", F.pmod(F.xxhash64("doc_id"), F.lit(LEADERS)).alias("_part")).agg(F.min(F.struct("doc_id", "n_shingles", *_SKETCH)).alias("_l"))
    return big.join(one.groupBy("key").agg(F.collect_list("_l").alias("leaders")), "key")


def mixed_nodes(big: DataFrame, labels: Labels, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of large nodes with their components; for each node of several: its main component, rows n and strays."""
    labelled = big.join(labels.frame.toDF("doc_id", "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    labelled = scratch.settle(labelled.select(*_COLUMNS, "component"), f"labelled-{name}")
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("c"))  # pre-aggregated before it is shuffled
    nodes = parts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("n"))
    return labelled, scratch.settle(nodes.where("top.c < n").select("key", F.col("top.component").alias("main"), "n", (F.col("n") - F.col("top.c")).alias("strays")), f"mixed-{name}")


def block_groups(labelled: DataFrame, nodes: DataFrame, rule: Rule, block: int = 512) -> DataFrame:
    """Groups of similar pairs of different components of the nodes, exhaustively.

    Only pairs with a stray can link different components. Rows and strays are dealt into blocks by a hash, and a block
    of strays meets a block of rows in one bounded group. Trees put the same documents together many times, so each row
    knows the first ``KNOWN`` of its nodes, and leaves a pair to the first one that it shares.
    """
    open_ = nodes.select("key", "main", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("strays") / block).cast("int").alias("stray_blocks"))
    known = F.slice(F.array_sort(F.collect_list("key").over(Window.partitionBy("doc_id"))), 1, KNOWN)
    rows = labelled.join(open_, "key").withColumns({"h": F.xxhash64("doc_id"), "out": (F.col("component") != F.col("main")).cast("int"), "nodes": known})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["key", "x", "y", "doc_id", "n_shingles", "component", "out", "nodes", *_SKETCH]
    own = rows.withColumns({"y": F.pmod("h", "blocks").cast("int"), "x": every("stray_blocks")}).select(*kept, F.lit(0).alias("stray"))
    strays = rows.where("out = 1").withColumns({"x": F.pmod("h", "stray_blocks").cast("int"), "y": every("blocks")}).select(*kept, F.lit(1).alias("stray"))
    return own.unionByName(strays).groupBy("key", "x", "y").applyInArrow(compare_blocks(rule), _FOUND)


# ------------------------------------------------------------------ the operator


class Source:
    """The texts that are compared: doc_id, text, and the digest of the chosen text of each id."""

    def __init__(self, docs: DataFrame, chosen: DataFrame, repeats: bool):
        self.docs, self.chosen, self.repeats = docs, chosen, repeats


def near_duplicates(docs: DataFrame, *, shingle: int = 2, over: int = 80, under: int = 100, trees: int = 10, node_rows: int = 512, few_strays: int = 2048, last_depth: int = 12, lead_every: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    spark, rule = docs.sparkSession, Rule(shingle, over, under)
    scratch = scratch or Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sigs = scratch.settle(signatures(docs, shingle), "signatures")
    chosen = sigs.where("n_shingles > 0 and doc_id is not null")
    repeats = not chosen.groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeats:
        chosen = scratch.settle(chosen.groupBy("doc_id").agg(F.min(F.struct("d1", "d2", "n_shingles", "sig")).alias("_x")).select("doc_id", "_x.*"), "chosen")
    keys = ["d1", "d2", "n_shingles"]
    classes = scratch.settle(chosen.groupBy(*keys).agg(F.min("doc_id").alias("rep")), "classes")
    members = scratch.settle(chosen.select("doc_id", *keys).join(classes, keys).select("doc_id", "rep", "d1"), "members")
    reps = scratch.settle(chosen.select("doc_id", "n_shingles", "sig").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi"), "reps")
    source = Source(docs, members.select("doc_id", "d1"), repeats)
    labels = Labels(spark, scratch)

    def settle_forest(pairs: DataFrame, name: str) -> None:
        """Confirms one pair of each document between different components, and unites."""
        best = scratch.settle(_best(labels.ends(pairs).where("ca <> cb"), "b"), f"forest-{name}")
        links = confirm(star_members(best), None, source, rule, scratch, name)
        labels.unite(links)
        scratch.release(best, links)

    found, depth = [], 0  # what each level compared
    rows = first_rows(reps, 0 if reps.count() <= node_rows else trees)
    while True:
        depth += 1
        large = scratch.settle(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > node_rows).select("key"), f"large{depth}")
        nodes = rows.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key", "doc_id")
        found.append(scratch.settle(nodes.mapInArrow(compare_nodes(rule), _FOUND), f"nodes{depth}"))
        single = found[-1].where("a is not null").select("a", "b", "m")
        if large.isEmpty():
            settle_forest(single, str(depth))
            break
        big, led = rows.join(large, "key", "left_semi"), None
        if depth % lead_every == 1 or lead_every == 1:
            big = scratch.settle(big, f"big{depth}")
            led = scratch.settle(with_leaders(big).mapInArrow(compare_leaders(rule), "a long, b long, m int"), f"led{depth}")
            settle_forest(single.unionByName(led), str(depth))
        labelled, mixed = mixed_nodes(big, labels, scratch, str(depth))
        far = mixed.where(F.col("strays") > few_strays) if depth < last_depth else mixed.limit(0)
        near = mixed if depth == last_depth else mixed.where(F.col("strays") <= few_strays)
        if not near.isEmpty():
            found.append(scratch.settle(block_groups(labelled, near, rule), f"blocks{depth}"))
        if far.isEmpty():
            break
        before, rows = rows, scratch.settle(next_rows(labelled.join(far.select("key"), "key", "left_semi").select("key", "doc_id"), reps), f"rows{depth + 1}")
        scratch.release(before, large, big, led, labelled, mixed)  # a finished level leaves what its nodes found

    # whatever is left between different components
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    if depth > 1:
        settle_forest(every.where("a is not null").select("a", "b", "m"), "all")
    rest = scratch.settle(labels.ends(every.where("a is not null")).where("ca <> cb").select("a", "b").distinct(), "rest")
    inside, matrices = open_groups(every.where("ids is not null"), labels, scratch)
    labels.unite(confirm(star_members(rest).unionByName(inside), matrices, source, rule, scratch, "rest"))

    ids = members.join(labels.frame.toDF("rep", "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles").join(ids, "doc_id", "left")
    out = scratch.settle(out.withColumn("component_id", F.coalesce("component_id", "doc_id")), "result")  # without a set: the own id
    scratch.keep(out)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest id of its component.

    Texts are not shuffled for it where the ids to drop are few enough to be broadcast, by their count.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    gone = scratch.settle(near_duplicates(docs.select("doc_id", "text"), scratch=scratch, **options).where("not kept").select("doc_id").distinct(), "gone")
    scratch.keep(gone)
    return docs.join(counted(gone), "doc_id", "left_anti").select(docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS k FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sn AS (SELECT s.g, s.doc_id, n.n FROM s JOIN n USING (doc_id)),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS k
  FROM sn x JOIN sn y ON x.g = y.g AND x.doc_id < y.doc_id AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 80
  GROUP BY 1, 2
), l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
