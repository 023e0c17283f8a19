"""Embedding near-dedup (operator 1): sorted projection passes.

Vectors of equal label are compared by cosine. Equal vectors of a label form one class, represented by its smallest id.
Each pass hashes every representative with ``bits`` random hyperplanes, concatenates the signs to a key and sorts a label's
vectors by it, over range partitions of bounded size. In that order every vector is compared with the ``neighbours`` that
follow it, also across partition bounds. Verified pairs of all passes are united to components.

A pass carries a vector as one byte a component, with the exact length of what rounding took off. Those lengths bound what
a cosine of rounded vectors can be off by: pairs certainly over the threshold are links at once, thinned to stars; pairs
that the bound leaves open are settled, once each, on the full vectors in double precision. Nothing is lost to rounding.

Components hold all links, so the number of links of each vector is then counted exactly inside its component: small
components as one group, larger ones in pairs of blocks of bounded size. Only counts leave a group, never pairs.

A pair of cosine 0.93 (angle 21.6 degrees) agrees on the first d signs of one pass with probability 0.88 ** d, and is
compared if at most ``neighbours`` vectors agree with it on them. The depth d is estimated for every label and width: from
its counted size n and the angles of a sample of at most ``sample`` of its vectors, as the least d at which n times the
mean chance of agreeing on d signs is at most ``neighbours``, for the most crowded sampled vector (vectors over the
threshold are left out: groups of near copies link through any of their pairs). For directions without a trend d is about
log2(n / neighbours); for vectors in a narrow cone it is larger. The label gets as many passes as lose a pair with
probability under ``miss``, and ``passes`` at least: with 256 neighbours and ``miss`` 1e-5 without a trend 15 for n = 6e3,
47 for n = 1e6 and 75 for n = 1e7. Depths over ``bits`` count as ``bits``, where keys end: a label so packed that it needs
more loses more.

Defined results: a vector that is null, empty, zero, or has null or non-finite components, and one with a null label,
links with nothing and is its own component; a null id likewise, with a null component; vectors of different lengths do
not link; repeated rows of one id count as one vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import U64, Scratch, components, longs, stars

THRESHOLD = 0.93


def usable(vector) -> "F.Column":
    """Not null, not empty, not zero, and all components finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def depth_needed(x: np.ndarray, count: int, neighbours: int, threshold: float, bits: int) -> int:
    """Signs that leave at most ``neighbours`` of ``count`` vectors, of which the rows of ``x`` are a sample, together."""
    cos = x @ x.T
    agree = 1 - np.arccos(np.clip(cos, -1, 1)) / np.pi  # on one random hyperplane
    agree[cos >= threshold] = 0
    share, depth = (agree > 0).astype(float), 0
    while depth < bits and count * share.mean(axis=1).max() > neighbours:
        share *= agree
        depth += 1
    return depth


def passes_needed(depth: int, threshold: float, miss: float) -> int:
    """Passes that all lose a pair at the threshold, which must agree on ``depth`` signs, with probability under ``miss``."""
    together = (1 - np.arccos(threshold) / np.pi) ** depth
    return 1 if together >= 1 else int(np.ceil(np.log(miss) / np.log1p(-together)))


def needs(reps: DataFrame, *, threshold: float, passes: int, bits: int, neighbours: int, miss: float, sample: int) -> DataFrame:
    """label, width, count, passes of every label and width, from its size and a bounded sample by hash."""
    keys = ["label", "width"]
    rows = reps.select("label", F.size("vector").alias("width"), "rep", "vector")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("count"))
    # the sample has the smallest hashes: rows beyond twice its share of the hashes are left out before anything is sorted
    share = F.xxhash64("rep") / F.lit(2.0**64) + 0.5
    near = rows.join(sizes, keys).where(share <= 2.0 * sample / F.col("count"))
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("rep"), "rep")
    some = near.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= sample).select(*keys, "count", "vector")

    def run(key, table):
        count = table.column("count")[0].as_py()
        depth = depth_needed(unit(matrix(table.column("vector"))), count, neighbours, threshold, bits) if count > neighbours else 0
        return pa.table({"label": [key[0].as_py()], "width": pa.array([key[1].as_py()], pa.int32()), "count": [count], "passes": pa.array([max(passes, passes_needed(depth, threshold, miss))], pa.int32())})

    return some.groupBy(*keys).applyInArrow(run, "label long, width int, count long, passes int")


PART = 24  # passes whose keys are made at once


def hyperplanes(width: int, part: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, width, part] if part else [seed, width]).standard_normal((width, PART * bits))


def sort_keys(x: np.ndarray, part: int, bits: int, seed: int) -> np.ndarray:
    """(vectors, PART) keys: the first hyperplane is the highest bit, so that order is lexicographic."""
    signs = (x @ hyperplanes(x.shape[1], part, bits, seed)).reshape(len(x), PART, bits) > 0
    return (signs.astype(U64) << np.arange(bits - 1, -1, -1, dtype=U64)).sum(axis=2, dtype=U64)


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte a component, the step of each row, and the length of what rounding took off."""
    step = np.abs(x).max(axis=1, keepdims=True) / 127
    q = np.rint(x / step).astype(np.int8)
    return q, step[:, 0].astype(np.float32), np.nextafter(np.sqrt(((x - q * step.astype(np.float32).astype(float)) ** 2).sum(axis=1)).astype(np.float32), np.float32(1))


_ORDER = ["pass", "label", "width", "key", "rep"]
_KEYED = "pass int, label long, width int, key long, rep long, step float, off float, body binary"


def keyed(reps: DataFrame, bits: int, seed: int) -> DataFrame:
    """One row for each representative and pass of its label; ``reps`` have ``width`` and ``passes``."""

    def run(batches):
        for batch in batches:
            kinds = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4)], axis=1)
            for width, passes in np.unique(kinds, axis=0).tolist():
                rows = batch.filter(pa.array((kinds == (width, passes)).all(axis=1)))
                for lo in range(0, rows.num_rows, 1000):
                    part = rows.slice(lo, 1000)
                    x = unit(matrix(part.column(2)))
                    n = len(x)
                    q, step, off = rounded(x)
                    ends = np.arange(n + 1, dtype=np.int32) * width
                    body = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(q.tobytes())])
                    for p in range(passes):
                        if p % PART == 0:
                            keys = sort_keys(x, p // PART, bits, seed)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, p, np.int32)), part.column(1), pa.array(np.full(n, width, np.int32)), longs(keys[:, p % PART]), part.column(0), pa.array(step), pa.array(off), body], names=[*_ORDER, "step", "off", "body"]
                        )

    return reps.select("rep", "label", "vector", "width", "passes").mapInArrow(run, _KEYED)


def window_links(table: pa.Table, threshold: float, neighbours: int, first: int = 0) -> tuple[list, list]:
    """(sure, open) pairs of positions of sorted rows at most ``neighbours`` apart, the later one from row ``first`` on."""
    group = [np.asarray(table.column(c)) for c in ("pass", "label", "width")]
    step, off = (np.asarray(table.column(c), float) for c in ("step", "off"))
    body = table.column("body")
    change = np.flatnonzero(np.any([g[1:] != g[:-1] for g in group], axis=0)) + 1 if table.num_rows > 1 else np.zeros(0, np.int64)
    sure, open_ = [], []
    for lo, hi in zip(np.append(0, change).tolist(), np.append(change, table.num_rows).tolist(), strict=True):
        if hi - lo < 2:
            continue
        x = np.frombuffer(b"".join(body.slice(lo, hi - lo).to_pylist()), np.int8).reshape(hi - lo, -1).astype(np.float32)
        s, e = step[lo:hi], off[lo:hi]
        for i in range(0, hi - lo, neighbours):
            part, near = slice(i, i + neighbours), slice(i, i + 2 * neighbours)
            cos = (x[part] @ x[near].T).astype(float) * s[part, None] * s[None, near]
            slack = e[part, None] + e[None, near] + e[part, None] * e[None, near] + 1e-5  # and what float sums can be off by
            gap = np.arange(cos.shape[1])[None, :] - np.arange(cos.shape[0])[:, None]
            ok = (cos + slack >= threshold) & (gap > 0) & (gap <= neighbours)
            if first:
                ok &= np.arange(lo + i, lo + i + cos.shape[1])[None, :] >= first
            a, b = np.nonzero(ok)
            certain = (cos - slack)[a, b] >= threshold
            for to, pick in ((sure, certain), (open_, ~certain)):
                to.append(np.stack([a[pick], b[pick]]) + lo + i)
    none = np.zeros((2, 0), np.int64)
    return tuple(np.concatenate([none, *x], axis=1) for x in (sure, open_))


def _emit(table: pa.Table, sure: np.ndarray, open_: np.ndarray) -> pa.RecordBatch:
    """Sure links as stars; open pairs of different stars as they are."""
    rep = np.asarray(table.column("rep"))
    ids, at = np.unique(rep, return_inverse=True)
    at = at.ravel()
    top, leaf = stars(ids, at[sure[0]], at[sure[1]])
    root = ids.copy()
    root[np.searchsorted(ids, leaf)] = top
    x, y = at[open_[0]], at[open_[1]]
    apart = root[x] != root[y]
    a, b = ids[x[apart]], ids[y[apart]]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(np.append(top, pairs[0])), pa.array(np.append(leaf, pairs[1])), pa.array(np.append(np.ones(len(top), bool), np.zeros(pairs.shape[1], bool)))], names=["a", "b", "sure"])


_PAIRS = "a long, b long, sure boolean, edge int, at int, row binary"


def _sweep(threshold: float, neighbours: int, rows: int = 8192):
    """Compares the sorted rows of a partition; its first and last ``neighbours`` rows also go out, for its bounds."""

    def packed(table: pa.Table) -> list[bytes]:
        out = []
        for k in range(table.num_rows):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table.slice(k, 1))
            out.append(sink.getvalue().to_pybytes())
        return out

    def edge_rows(table: pa.Table, edge: int, at: list[int]) -> pa.RecordBatch:
        n = table.num_rows
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array([edge] * n, pa.int32()), pa.array(at, pa.int32()), pa.array(packed(table), pa.binary())], names=["a", "b", "sure", "edge", "at", "row"])

    def links(table: pa.Table, first: int) -> pa.RecordBatch:
        out = _emit(table, *window_links(table, threshold, neighbours, first))
        n = out.num_rows
        return pa.RecordBatch.from_arrays([*out.columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["a", "b", "sure", "edge", "at", "row"])

    def run(batches):
        part, kept, waiting, begun = TaskContext.get().partitionId(), None, [], False

        def work():
            nonlocal kept, waiting, begun
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting = []
            first = 0
            if kept is not None:
                first, table = kept.num_rows, pa.concat_tables([kept, table]).combine_chunks()
            elif not begun:
                begun = True
                head = table.slice(0, neighbours)
                yield edge_rows(head, part, list(range(neighbours, neighbours + head.num_rows)))
            yield links(table, first)
            kept = table.slice(max(0, table.num_rows - neighbours)).combine_chunks()

        size = 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.num_rows
            if size >= rows:
                yield from work()
                size = 0
        if waiting:
            yield from work()
        if kept is not None:  # its last rows meet the first ones of the partition after it
            yield edge_rows(kept, part + 1, list(range(neighbours - kept.num_rows, neighbours)))

    return run


def _bounds(threshold: float, neighbours: int):
    """Compares the last rows of a partition with the first ones of the next."""

    def run(table):
        table = table.sort_by("at")
        at = np.asarray(table.column("at"))
        rows = pa.concat_tables([pa.ipc.open_stream(r.as_py()).read_all() for r in table.column("row")]).combine_chunks()
        first = int((at < neighbours).sum())
        out = _emit(rows, *window_links(rows, threshold, neighbours, first)) if 0 < first < len(at) else _emit(rows, np.zeros((2, 0), int), np.zeros((2, 0), int))
        return pa.Table.from_batches([out])

    return run


def _exact(threshold: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                width = np.diff(batch.column(2).offsets.to_numpy())
                keep = np.zeros(batch.num_rows, bool)
                for w in np.unique(width):
                    rows = np.flatnonzero(width == w)
                    x, y = (unit(matrix(batch.column(k).take(pa.array(rows)))) for k in (2, 3))
                    keep[rows] = (x * y).sum(axis=1) >= threshold
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def pass_links(reps: DataFrame, scratch: Scratch, *, threshold: float, passes: int, bits: int, neighbours: int, partition_rows: int, seed: int, miss: float, sample: int) -> DataFrame:
    """Links found by the passes, thinned to stars where they are found."""
    spark = reps.sparkSession
    need = scratch.settle(needs(reps, threshold=threshold, passes=passes, bits=bits, neighbours=neighbours, miss=miss, sample=sample), "needs")
    made = need.agg(F.coalesce(F.sum(F.col("count") * F.col("passes")), F.lit(0))).first()[0]
    partitions = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), made // 20_000), made // partition_rows)
    dealt = reps.withColumn("width", F.size("vector")).join(need.select("label", "width", "passes"), ["label", "width"])
    rows = keyed(dealt, bits, seed).repartitionByRange(partitions, *_ORDER).sortWithinPartitions(*_ORDER)
    swept = scratch.settle(rows.mapInArrow(_sweep(threshold, neighbours), _PAIRS), "swept")
    found = swept.where("a is not null").select("a", "b", "sure")
    bounds = swept.where("edge is not null").groupBy("edge").applyInArrow(_bounds(threshold, neighbours), "a long, b long, sure boolean")
    found = scratch.settle(found.unionByName(bounds).groupBy("a", "b").agg(F.max("sure").alias("sure")), "found")
    open_ = found.where("not sure").select("a", "b")
    vectors = reps.select("rep", "vector")
    both = open_.join(vectors.toDF("a", "x"), "a").join(vectors.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return scratch.settle(found.where("sure").select("a", "b").unionByName(both.mapInArrow(_exact(threshold), "a long, b long")), "links")


def _count_links(threshold: float):
    """Links of each vector of block lo to those of block hi (and back); copies count each."""

    def run(key, table):
        lo, hi = key[1].as_py(), key[2].as_py()
        own, ids, copies = (table.column(c).to_numpy() for c in ("own", "rep", "copies"))
        x = unit(matrix(table.column("vector")))
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        out_id, out_n = [], []
        forward, back = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        for i in range(0, len(left), 512):
            linked = x[left[i : i + 512]] @ x[right].T >= threshold
            if lo == hi:
                linked[np.arange(len(linked)), np.arange(i, i + len(linked))] = False
            forward[i : i + 512] = linked @ copies[right]
            back += copies[left[i : i + 512]] @ linked
        out_id.append(ids[left])
        out_n.append(forward)
        if lo != hi:
            out_id.append(ids[right])
            out_n.append(back)
        return pa.table({"rep": pa.array(np.concatenate(out_id), pa.int64()), "n": pa.array(np.concatenate(out_n), pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, passes: int = 8, bits: int = 32, neighbours: int = 256, block: int = 2048, partition_rows: int = 400_000, seed: int = 7, miss: float = 1e-5, sample: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "projections")
    # as narrow as the input has them: all sums are made in double precision
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("vector"))
    good = source.where(usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # equal vectors are found by a digest of their components (0.0 and -0.0 are equal)
    digest = F.sha2(F.to_json(F.transform("vector", lambda x: x + F.lit(0.0).cast(kind[6:-1]))).cast("binary"), 256)
    good = scratch.settle(good.withColumn("digest", digest).dropDuplicates(["vec_id", "label", "digest"]), "good")
    classes = scratch.settle(good.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")
    members = scratch.settle(good.select("vec_id", "label", "digest").join(classes, ["label", "digest"]).select("vec_id", "rep", "copies"), "members")
    reps = good.join(classes.select(F.col("rep").alias("vec_id"), "label", "digest", "copies"), ["vec_id", "label", "digest"])
    reps = scratch.settle(reps.select(F.col("vec_id").alias("rep"), "label", "vector", "copies"), "reps")

    links = pass_links(reps, scratch, threshold=threshold, passes=passes, bits=bits, neighbours=neighbours, partition_rows=partition_rows, seed=seed, miss=miss, sample=sample)
    labels = components(spark, links, scratch)

    # exact counts inside components; a component of many vectors is dealt in blocks and counted by pairs of blocks
    size = scratch.settle(labels.groupBy("component").agg(F.count("*").alias("_n")).select("component", F.ceil(F.col("_n") / block).cast("int").alias("blocks")), "sizes")
    placed = scratch.settle(labels.join(size, "component").withColumnRenamed("id", "rep"), "placed")
    rows = reps.join(placed, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "rep", "copies", "vector")
    counts = rows.groupBy("component", "lo", "hi").applyInArrow(_count_links(threshold), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    counts = scratch.settle(counts.join(placed.select("rep", "component"), "rep"), "counts")

    linked = members.join(counts, "rep", "left")
    linked = linked.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    bare = source.join(good.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = scratch.settle(linked.unionByName(bare), "result")
    scratch.keep(out)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.vec_id WHERE r.c < e.b),
m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, m.c = d.vec_id AS kept
FROM embeddings d JOIN m USING (vec_id) LEFT JOIN n ON n.a = d.vec_id
"""
