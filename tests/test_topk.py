"""Spaced selections and peaks against plain greedy passes, on long streams, plateaus, ties and gaps."""

import bisect

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import topk as K
from strandline.sources.shared import Scratch


def wave(spark, n, step=0.25, name="a"):
    """A slow wave with noise in steps, so that equal scores and plateaus occur; some scores are missing."""
    i = F.col("id")
    noise = (F.pmod(F.xxhash64("id", F.lit(name)), F.lit(1000)) / 1000.0) * 4
    x = F.floor((10 * F.sin(i / 5000.0) + 3 * F.sin(i / 37.0) + noise) / step) * step
    rows = spark.range(n).select(F.lit(name).alias("dataset"), i.alias("window_index"), (i * 5 + 10.5).alias("center_cycle"), x.alias("x"))
    return rows.withColumn("x", F.when(F.pmod(F.xxhash64("window_index"), F.lit(97)) > 0, F.col("x")))


def arrays(df):
    pdf = df.orderBy("window_index").toPandas()
    return pdf["window_index"].to_numpy(), pdf["x"].to_numpy(float)


def greedy(positions, scores, ties, spacing, k=None):
    taken, out = [], []
    for i in np.lexsort((ties, -scores)).tolist():
        at = bisect.bisect_left(taken, positions[i])
        if (at == 0 or positions[i] - taken[at - 1] >= spacing) and (at == len(taken) or taken[at] - positions[i] >= spacing):
            taken.insert(at, positions[i])
            out.append(i)
            if len(out) == k:
                break
    return out


@pytest.mark.parametrize("n", [1, 50, 1_000_000])
def test_spaced_top_of_one_stream(spark, n):
    df = wave(spark, n)
    w, x = arrays(df)
    w, x = w[~np.isnan(x)], x[~np.isnan(x)]
    want = w[greedy(w * 5 + 10.5, x, w, 500.0, 20)].tolist()
    got = K.spaced_top(df, "x", 20, 500.0).orderBy("pick").toPandas()
    assert got["window_index"].tolist() == want and got["relaxed"].sum() == 0
    assert got["pick"].tolist() == list(range(1, len(want) + 1))


def test_spaced_top_relaxes(spark):
    df = wave(spark, 300).unionByName(wave(spark, 4, name="short"))
    got = K.spaced_top(df, "x", 8, 600.0, least=5).orderBy("dataset", "pick").toPandas()
    for name, n in (("a", 300), ("short", 4)):
        w, x = arrays(df.where(F.col("dataset") == name))
        w, x = w[~np.isnan(x)], x[~np.isnan(x)]
        picks = greedy(w * 5 + 10.5, x, w, 600.0, 8)
        rest = [i for i in np.lexsort((w, -x)).tolist() if i not in picks]
        assert len(picks) < min(5, len(w))
        own = got[got["dataset"] == name]
        assert own["window_index"].tolist() == w[(picks + rest)[:8]].tolist() and own["relaxed"].all()
    none = K.spaced_top(df, "x", 2, 600.0, least=1).toPandas()
    assert none.groupby("dataset").size().to_dict() == {"a": 2, "short": 1} and not none["relaxed"].any()


def test_spaced_top_keeps_the_spacing_of_a_rising_stream(spark):
    """Eighty rows a hundred cycles apart, each higher than the one before: picks are five rows apart from the last on."""
    rows = spark.range(80).select(F.lit("s").alias("dataset"), F.col("id").alias("window_index"), (F.col("id") * 100.0).alias("center_cycle"), F.col("id").cast("double").alias("x"))
    assert K.spaced_top(rows, "x", 20, 500.0).orderBy("pick").toPandas()["window_index"].tolist() == list(range(79, -1, -5))


def test_spaced_takers_of_chains(spark):
    """Rising scores over many chunks decide one another from the last on; constants by their ties; others in between."""
    i = F.col("id")
    score = F.when(i < 30_000, i.cast("double")).when(i < 60_000, F.lit(5.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(50)).cast("double"))
    rows = spark.range(100_000).select(F.lit("s").alias("dataset"), i.cast("double").alias("at"), score.alias("score"), (-i).alias("tie"))
    scratch = Scratch(spark, "test")
    got = sorted(r["at"] for r in K.spaced_takers(rows, 70.0, scratch).collect())
    pdf = rows.orderBy("at").toPandas()
    assert got == sorted(pdf["at"].to_numpy()[greedy(pdf["at"].to_numpy(), pdf["score"].to_numpy(), pdf["tie"].to_numpy(), 70.0)].tolist())
    scratch.keep()


def brute_peaks(w, x, height, distance, prominence):
    w, x = w[~np.isnan(x)], x[~np.isnan(x)]
    n, tops, i = len(x), [], 1
    while i < n - 1:
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < n and x[j + 1] < x[i]:
            tops.append((i + j) // 2)
        i = j + 1
    tops = np.array([p for p in tops if x[p] >= height], int)
    keep = sorted(tops[greedy(tops, x[tops], -tops, distance)].tolist())
    low = {}
    for side in (1, -1):
        stack: list[tuple[float, float]] = []  # falling heights, with the least value since the one before
        wanted = set(keep)
        for p in range(n) if side == 1 else range(n - 1, -1, -1):
            least = x[p]
            while stack and stack[-1][0] <= x[p]:
                least = min(least, stack.pop()[1])
            if p in wanted:
                low[p] = max(low.get(p, -np.inf), least)
            stack.append((x[p], least))
    return [(int(w[p]), float(x[p]), float(x[p] - low[p])) for p in keep if x[p] - low[p] >= prominence]


@pytest.mark.parametrize(("n", "distance"), [(40, 3), (5_000, 1), (300_000, 200)])
def test_prominent_peaks(spark, n, distance):
    df = wave(spark, n)
    got = [tuple(r) for r in K.prominent_peaks(df, "x", 1.0, distance, 1.5).orderBy("window_index").select("window_index", "height", "prominence").collect()]
    assert got == brute_peaks(*arrays(df), 1.0, distance, 1.5) and (n < 100 or len(got) > 3)


def test_peaks_of_nothing_and_of_plateaus(spark):
    rows = spark.range(30_000).select(F.lit("s").alias("dataset"), F.col("id").alias("window_index"), F.when(F.col("id").between(100, 29_000), 2.0).otherwise(F.lit(1.0)).alias("x"))
    assert [tuple(r)[1:] for r in K.prominent_peaks(rows, "x", 0.0, 1, 0.5).collect()] == [((100 + 29_000) // 2, 2.0, 1.0)]
    assert K.prominent_peaks(rows.where("window_index < 200"), "x", 0.0, 1, 0.5).collect() == []
    assert K.prominent_peaks(rows.limit(0), "x", 0.0, 1, 0.5).collect() == []
