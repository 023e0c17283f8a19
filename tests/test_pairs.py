"""Counted pair sampling against the enumeration of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import joins as J
from strandline.sources.shared import Scratch

BINS = [(500, 2000), (2000, 5000), (5000, None)]


def draw(k, stratum, seed):
    x = ((k % J.DRAW_PRIME) * 48_271 + stratum * 69_621 + seed * 39_373) % J.DRAW_PRIME
    for _ in range(3):
        x = (x * x + x * 48_271 + 12_345) % J.DRAW_PRIME
    return x


def frame(spark, n, guards):
    return spark.range(n).select(F.lit("s").alias("dataset"), F.col("id").alias("window_index"), guards.alias("guard"))


@pytest.mark.parametrize(("n", "stride", "most"), [(150, 100.0, 40), (150, 100.0, 10**6), (700, 5.0, 300), (3, 100.0, 5)])
def test_pairs_are_those_of_the_enumeration(spark, n, stride, most):
    guards = F.when((F.col("id") % 17 == 0) | F.col("id").between(60, 70), 1).otherwise(0)
    df, scratch = frame(spark, n, guards), Scratch(spark, "test")
    got = sorted((r["bin"], r["earlier"], r["later"], r["gap"]) for r in J.sampled_pairs(df, BINS, most, scratch, stride, seed=3).collect())
    scratch.keep()
    free = [k for k in range(n) if k % 17 and not 60 <= k <= 70]
    want = []
    for b, (low, high) in enumerate(BINS):
        every = [(i, j) for i in free for j in free if j > i and low <= (j - i) * stride < (high or np.inf)]
        t, m = len(every), min(len(every), most)
        for k in range(m):
            lo, hi = k * t // m, (k + 1) * t // m
            i, j = every[lo + int(draw(k, b, 3) / float(J.DRAW_PRIME) * (hi - lo))]
            want.append((b, i, j, (j - i) * stride))
    assert got == sorted(want) and len({g[:3] for g in got}) == len(got)


def test_pairs_of_a_long_stream(spark):
    """Half a million windows have some 10 ** 11 pairs: they are numbered, and 5,000 of each bin are drawn."""
    df, scratch = frame(spark, 500_000, (F.col("id") % 100 < 20).cast("int")), Scratch(spark, "test")
    got = J.sampled_pairs(df, BINS, 5_000, scratch, 5.0).toPandas()
    scratch.keep()
    assert got.groupby("bin").size().tolist() == [5_000] * 3 and not got.duplicated(["bin", "earlier", "later"]).any()
    assert (got["earlier"] % 100 >= 20).all() and (got["later"] % 100 >= 20).all()
    for b, (low, high) in enumerate(BINS):
        gap = got.loc[got["bin"] == b, "gap"]
        assert gap.min() >= low and gap.max() < (high or np.inf)
        assert np.abs(np.quantile(got.loc[got["bin"] == b, "earlier"], 0.5) / 500_000 - (0.5 if high else 1 - np.sqrt(0.5))) < 0.03
