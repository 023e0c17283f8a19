"""Block bootstrap by replicate weights: no row is copied for a replicate, and no stratum is gathered.

A block of neighbouring rows is drawn into a replicate as often as a hash of (seed, stratum, replicate, block) says, by a
Poisson law of mean 1, so any task knows the weights of the rows that it holds, for all replicates at once. A resampled
median is an order statistic of weighted distinct values: those are sorted by ranges and cut into chunks, chunks sum
their weights for every replicate, running sums name the chunk that holds the middle ranks, and only there are values
looked up. Weighted fits take the same weights in ``logistic``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.metrics import direction_signs, med
from strandline.sources.shared import Scratch

PRIME = 2_147_483_647
CHUNK_ROWS = 4096
#: Steps of the distribution function of a Poisson law of mean 1, scaled to hashes below PRIME.
STEPS = [int(PRIME * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(9)]


def draw(seed: int, stratum: np.ndarray, replicate: np.ndarray, block: np.ndarray) -> np.ndarray:
    """How often a block is drawn; small integer arithmetic, so that SQL can state the same."""
    x = (stratum * 48_271 + replicate * 69_621 + (block % PRIME) * 16_807 + seed * 39_373) % PRIME
    for _ in range(3):
        x = (x * x + 48_271 * x + replicate + 12_345) % PRIME
    return np.searchsorted(np.array(STEPS), x, "right")


def draw_sql(seed: int, stratum: str, replicate: str, block: str) -> str:
    x = f"(({stratum} * 48271 + {replicate} * 69621 + ({block} % {PRIME}) * 16807 + {seed * 39_373}) % {PRIME})"
    for _ in range(3):
        x = f"list_transform([{x}], lambda x: (x * x + 48271 * x + {replicate} + 12345) % {PRIME})[1]"
    return f"len(list_filter({STEPS}, lambda s: s <= {x}))"


_KEYS = ["dataset", "stage", "feature_name"]
_ROWS = "dataset string, stage int, feature_name string, chunk long, value double, block long, n long"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the number of their chunk, which rises in the order of the rows."""
    from pyspark import TaskContext

    chunk, size, last = TaskContext.get().partitionId() << 32, 0, None
    for batch in batches:
        out = []
        for key in zip(*[batch.column(c).to_pylist() for c in _KEYS], strict=True):
            if key != last or size >= CHUNK_ROWS:
                chunk, size, last = chunk + 1, 0, key
            size += 1
            out.append(chunk)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in _KEYS] + [pa.array(out, pa.int64())] + [batch.column(c) for c in ("value", "block", "n")], names=[c.split()[0] for c in _ROWS.split(", ")])


def replicate_medians(rows: DataFrame, replicates: int, seed: int, scratch: Scratch) -> DataFrame:
    """dataset, stage, feature_name, replicate, median of (dataset, stage, feature_name, value, block) in each replicate."""
    counted = rows.where("value IS NOT NULL").groupBy(*_KEYS, "value", "block").agg(F.count("*").alias("n"))
    order = [*_KEYS, "value", "block"]
    chunks = scratch.settle(counted.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chunked, _ROWS), "chunks")

    def sums(batches):
        every = np.arange(replicates)
        for pdf in batches:
            for key, g in pdf.groupby([*_KEYS, "chunk"], sort=False):
                w = draw(seed, np.full((len(g), 1), key[1]), every[None, :], g["block"].to_numpy()[:, None])
                yield pd.DataFrame({**dict(zip([*_KEYS, "chunk"], key, strict=True)), "replicate": every, "w": (w * g["n"].to_numpy()[:, None]).sum(0)})

    keys = [*_KEYS, "replicate"]
    totals = chunks.mapInPandas(sums, "dataset string, stage int, feature_name string, chunk long, replicate long, w long").groupBy(*keys, "chunk").agg(F.sum("w").alias("w"))
    before, whole = Window.partitionBy(*keys).orderBy("chunk"), Window.partitionBy(*keys)
    summed = totals.select(*keys, "chunk", "w", (F.sum("w").over(before) - F.col("w")).alias("before"), F.sum("w").over(whole).alias("all"))
    middles = F.array(F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1)
    hits = summed.withColumn("rank", F.explode(middles)).where("before < rank AND rank <= before + w").select(*keys, "chunk", (F.col("rank") - F.col("before")).alias("rank"))

    def pick(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.astype({"dataset": object, "feature_name": object})  # a group without hits has no types of its own
        left = left.sort_values(["value", "block"])
        w = draw(seed, left["stage"].to_numpy(np.int64)[:, None], right["replicate"].to_numpy()[None, :], left["block"].to_numpy()[:, None])
        upto = np.cumsum(w * left["n"].to_numpy()[:, None], axis=0)
        at = (upto < right["rank"].to_numpy()[None, :]).sum(0)
        return right[keys].assign(value=left["value"].to_numpy()[at])

    group = [*_KEYS, "chunk"]
    found = chunks.groupBy(*group).cogroup(scratch.settle(hits, "hits").groupBy(*group)).applyInPandas(pick, "dataset string, stage int, feature_name string, replicate long, value double")
    return found.groupBy(*keys).agg(F.avg("value").alias("median"))


def with_blocks(df: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``block``: runs of ``block`` windows, counted from the first one of each key."""
    first = df.groupBy(*keys).agg(F.min("window_index").alias("_first"))
    return df.join(first, keys).withColumn("block", F.floor((F.col("window_index") - F.col("_first")) / block)).drop("_first")


def direction_stability(long: DataFrame, value: Column, replicates: int = 500, block: int = 20, seed: int = 5, least: float = 0.05, few: int = 5) -> DataFrame:
    """Share of replicates in which the shift from stage 1 to stage 5 has the sign of the whole data's shift.

    ``long``: dataset, stage, window_index, feature_name and what ``value`` reads. Features whose shift is below ``least``,
    or with fewer than ``few`` rows in a stage, get 0.
    """
    scratch = Scratch(long.sparkSession, "bootstrap")
    rows = long.where("stage IN (1, 5)").select("dataset", F.col("stage").cast("int").alias("stage"), "window_index", "feature_name", value.cast("double").alias("value"))
    medians = replicate_medians(with_blocks(rows, ["dataset", "stage"], block), replicates, seed, scratch)
    at = lambda k: F.max(F.when(F.col("stage") == k, F.col("median")))
    shift = medians.groupBy("dataset", "feature_name", "replicate").agg((at(5) - at(1)).alias("shift"))
    signs = direction_signs(rows.withColumn("z_value", F.col("value")), least).select("dataset", "feature_name", "direction_sign")
    n = rows.where("value IS NOT NULL").groupBy("dataset", "feature_name").agg(F.count(F.when(F.col("stage") == 1, 1)).alias("_n1"), F.count(F.when(F.col("stage") == 5, 1)).alias("_n5"))
    same = F.sum((F.signum("shift") == F.col("direction_sign")).cast("long")) / F.lit(float(replicates))
    share = shift.join(signs, ["dataset", "feature_name"]).groupBy("dataset", "feature_name", "direction_sign").agg(same.alias("same"))
    active = (F.col("direction_sign") != 0) & (F.col("_n1") >= few) & (F.col("_n5") >= few)
    return scratch.last(share.join(n, ["dataset", "feature_name"]).select("dataset", "feature_name", "direction_sign", F.when(active, F.coalesce("same", F.lit(0.0))).otherwise(0.0).alias("stability")))


def weight_summary(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Of the weights of a feature over replicates: median, 5 % and 95 % points, share of one sign, share in use."""
    w = F.col("weight")
    share = lambda c: F.avg(c.cast("double"))
    return weights.groupBy(*keys).agg(med("weight").alias("median_weight"), med("weight", 0.05).alias("weight_p05"), med("weight", 0.95).alias("weight_p95"), F.greatest(share(w > 0), share(w < 0)).alias("sign_stability"), share(F.abs(w) > 1e-10).alias("selection_frequency"))
