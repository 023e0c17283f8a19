"""Causal row frames over window tables: medians, spreads, trends, runs and episodes.

Every function returns a maker for ``streams.framed``: it gets the ordered window of a chunk and looks back a bounded
number of rows, so frames of long streams run in parallel chunks.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.functions import arrays as A
from strandline.operators.prefix import running_totals
from strandline.operators.streams import framed, running_sum, with_halo
from strandline.sources.shared import Scratch


def back(w, k: int, to: int = 0):
    return w.rowsBetween(-(k - 1), to)


def rolling_median(column: str, k: int):
    return lambda w: F.percentile(F.col(column), F.lit(0.5)).over(back(w, k))


def rolling_mean(column: str, k: int):
    return lambda w: F.avg(column).over(back(w, k))


def rolling_mad(column: str, k: int, least: int = 3, fallback: bool = True, eps: float = 1e-9):
    """Scaled MAD of the frame; 0 under ``least`` values; a zero MAD falls back to the population deviation or to eps."""

    def make(w):
        def spread(values):
            low = A.deviation(values) if fallback else F.lit(eps)
            return F.when(F.size(values) < least, 0.0).otherwise(A.let(A.mad(values), lambda m: F.when(m < eps, low).otherwise(m)))

        return A.let(F.collect_list(column).over(back(w, k)), spread)  # collect_list leaves nulls out

    return make


def trend(column: str, h: int):
    """(median of the last h - median of the h before) / h; null until 2 h rows exist."""

    def make(w):
        now = F.percentile(F.col(column), F.lit(0.5)).over(back(w, h))
        before = F.percentile(F.col(column), F.lit(0.5)).over(w.rowsBetween(-(2 * h - 1), -h))
        full = F.count(F.lit(1)).over(w.rowsBetween(-(2 * h - 1), 0)) == 2 * h
        return F.when(full, (now - before) / h)

    return make


def half_rate(column: str, length: int):
    """(median of the last half - median of the first half) / half of the last ``length`` rows; 0 until full."""
    half = length // 2

    def make(w):
        return F.coalesce(trend(column, half)(w), F.lit(0.0))

    return make


def half_difference(column: str, length: int):
    """Median of the last half minus that of the half before, 0 until full: one component of a velocity."""
    return lambda w: half_rate(column, length)(w) * (length // 2)


def rolling_volatility(columns: list[str], k: int):
    """How much the distances of the last rows from their median point vary: the MAD of those radii, unscaled."""

    def make(w):
        points = F.collect_list(F.array(*columns)).over(back(w, k))

        def radii(p):
            part = lambda i: lambda x: F.get(x, i)
            centre = [A.median(F.transform(p, part(i))) for i in range(len(columns))]
            return A.let(F.array(*centre), lambda c: F.transform(p, lambda x: F.sqrt(sum((F.get(x, i) - F.get(c, i)) ** 2 for i in range(len(columns))))))

        return A.let(points, lambda p: A.mad(radii(p), 1.0))

    return make


def _sliding(x: np.ndarray, k: int, of, rows: int = 1024) -> np.ndarray:
    """``of`` the (rows, columns, k) frames of ``k`` rows of ``x`` that are full, some at a time."""
    frames = sliding_window_view(x, k, axis=0)
    return np.concatenate([of(frames[lo : lo + rows]) for lo in range(0, len(frames), rows)])


def _middle(frames: np.ndarray) -> np.ndarray:
    """Medians of the last axis as ``arrays.median`` has them: missing values are last, and one that is touched is the result."""
    k = frames.shape[-1]
    low = (k - 1) // 2
    high = min(low + 1, k - 1)
    part = np.partition(frames, (low, high), axis=-1)
    return part[..., low] + (part[..., high] - part[..., low]) * (0.0 if k % 2 else 0.5)


def _volatility(frames: np.ndarray) -> np.ndarray:
    away = frames - _middle(frames)[..., None]
    radii = np.sqrt((away * away).sum(axis=1))
    return _middle(np.abs(radii - _middle(radii)[:, None]))


def _moves(x: np.ndarray, lengths: tuple[int, ...], k: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    present = not np.isnan(x).any()
    moves = {}
    for length in lengths:
        half, moves[length] = length // 2, np.zeros_like(x)
        if len(x) >= 2 * half:
            mid = _sliding(x, half, (lambda f: np.median(f, axis=-1)) if present else (lambda f: np.nanmedian(f, axis=-1)))
            moves[length][2 * half - 1 :] = np.nan_to_num((mid[half:] - mid[:-half]) / half, nan=0.0) * half
    short = [_volatility(x[None, :t].swapaxes(1, 2)) for t in range(1, min(k, len(x) + 1))]
    return moves, np.concatenate([*short, *([_sliding(x, k, _volatility)] if len(x) >= k else [])])


def vector_moves(df: DataFrame, keys: list[str], position: str, columns: list[str], lengths: tuple[int, ...], k: int, rows: int = 8192) -> DataFrame:
    """``df`` with ``v<length>``, the half differences of ``columns`` as a vector, and ``vol``, their volatility over ``k`` rows.

    Values are those of ``half_difference`` and ``rolling_volatility``. All frames of a chunk are sorted side by side as one
    array, which costs a small part of what a window function for each row, length and column does.
    """
    added = ", ".join([*(f"v{n} array<double>" for n in lengths), "vol double"])
    schema = StructType([*df.schema.fields, *StructType.fromDDL(added).fields])
    kept, halo = df.columns, max(*lengths, k) - 1

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(position)
        x = np.stack([table.column(c).to_numpy().astype(float) for c in columns], axis=1)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # frames without values
            moves, vol = _moves(x, lengths, k)
        own = ~np.asarray(table.column("_halo").to_numpy(), bool)
        out = table.filter(pa.array(own)).select(kept)
        for n in lengths:
            out = out.append_column(f"v{n}", pa.ListArray.from_arrays(pa.array(np.arange(own.sum() + 1) * len(columns), pa.int32()), pa.array(moves[n][own].ravel())))
        return out.append_column("vol", pa.array(vol[own], from_pandas=True))

    return with_halo(df, position, halo, rows).groupBy(*keys, "_chunk").applyInArrow(run, schema)


def jump(column: str, k: int):
    return lambda w: A.positive(F.col(column) - F.percentile(F.col(column), F.lit(0.5)).over(back(w, k)))


def difference(column: str, n: int):
    return lambda w: F.coalesce(F.col(column) - F.lag(column, n).over(w), F.lit(0.0))


def slope(column: str, position: str, k: int):
    return lambda w: F.regr_slope(F.col(column), F.col(position).cast("double")).over(back(w, k))


def frame_list(column: str, k: int):
    return lambda w: F.collect_list(column).over(back(w, k))


def history(columns: list[str], k: int = 20):
    """[1, mean, deviation, last - first] of each column over k rows; null until k rows without nulls."""

    def make(w):
        f = back(w, k)
        full = F.lit(True)
        parts = [F.lit(1.0)]
        for c in columns:
            full = full & (F.count(c).over(f) == k)
            parts += [F.avg(c).over(f), F.stddev_pop(c).over(f), F.col(c) - F.first(c).over(f)]
        return F.when(full, F.array(*parts))

    return make


def padded_sequence(columns: list[str], k: int = 20):
    """The last k rows of the segment as arrays, padded on the left with the first row."""

    def make(w):
        got = F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(back(w, k))
        return F.concat(F.array_repeat(F.element_at(got, 1), k - F.size(got)), got)

    return make


def trajectory(columns: list[str], short: int = 20, long: int = 100):
    """[e, (e - median of the short past) / 2, (e - median of the long past) / 4]; the past excludes the row."""

    def make(w):
        def past(c, n):
            return F.col(c) - F.coalesce(F.percentile(F.col(c), F.lit(0.5)).over(w.rowsBetween(-n, -1)), F.col(c))

        return F.array(*[F.col(c) for c in columns], *[0.5 * past(c, short) for c in columns], *[0.25 * past(c, long) for c in columns])

    return make


def slow_risk(risks: Column, up: float = 0.15, down: float = 0.02, start: float = 0.0) -> Column:
    """Asymmetric smoothing of an ordered array: rises with ``up``, falls with ``down``."""
    return F.aggregate(risks, F.lit(float(start)), lambda s, x: s + F.when(x > s, F.lit(up)).otherwise(F.lit(down)) * (x - s))


# ------------------------------------------------------------------ unbounded runs


def runs(df: DataFrame, flag: str, position: str = "_at", keys=("dataset",), name: str = "run") -> DataFrame:
    """``name``: length so far of the run of true flags that a row is in (0 where false).

    Gaps and islands: a running count of false rows, which is summed chunk by chunk, names the island.
    """
    keys = list(keys)
    marked = df.withColumn("_gap", (~F.coalesce(F.col(flag), F.lit(False))).cast("long"))
    island = running_sum(marked, keys, position, "_gap", "_island")
    starts = island.groupBy(*keys, "_island").agg(F.min(F.when(F.col("_gap") == 0, F.col(position))).alias("_from"))
    out = island.join(starts, [*keys, "_island"])
    return out.withColumn(name, F.when(F.col("_gap") == 1, 0).otherwise(F.col(position) - F.col("_from") + 1).cast("long")).drop("_gap", "_island", "_from")


def episodes(df: DataFrame, flag: str, position: str = "_at", keys=("dataset",)) -> DataFrame:
    """Number of rising edges of each stream; a true first row counts."""
    edged = framed(df.withColumn("_f", F.coalesce(F.col(flag), F.lit(False)).cast("int")), list(keys), position, {"_b": lambda w: F.coalesce(F.lag("_f").over(w), F.lit(0))}, 1)
    return edged.groupBy(*keys).agg(F.sum(((F.col("_f") == 1) & (F.col("_b") == 0)).cast("long")).alias("episodes"))


def pct_rank(df: DataFrame, column: str, keys=("dataset",), name: str = "pct") -> DataFrame:
    """Average percentile rank times 100: ranks come from a count of distinct values, not from sorting rows."""
    keys = list(keys)
    scratch = Scratch(df.sparkSession, "ranks")
    values = df.groupBy(*keys, column).agg(F.count("*").alias("_c"))
    summed = running_totals(values, keys, [F.col(column)], {"_r": F.col("_c")}, scratch, totals=True)
    ranked = summed.select(*keys, column, (F.col("_r") - (F.col("_c") - 1) / 2).alias("_r"), "_r_all")
    return scratch.last(df.join(ranked, [*keys, column]).withColumn(name, 100 * F.col("_r") / F.col("_r_all")).drop("_r", "_r_all"))
