"""Joins that Spark has no operator for: nearest, interval, as-of, temporal pairs, neighbourhoods.

Boundary and segment tables are packed to one row a stream and joined by key: Spark's own size check decides how. Stream
against stream joins go by position buckets, so no cross product arises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.streams import framed, running_sum, with_halo
from strandline.sources.shared import Scratch


def nearest_boundary(events: DataFrame, boundaries: DataFrame, tolerance: float = 500) -> DataFrame:
    """For each event the boundary of its stream with the smallest distance (ties: the earlier one) and whether it matches."""
    best = boundaries.groupBy("dataset").agg(F.sort_array(F.collect_list("boundary_cycle")).alias("_bs"))  # boundaries of one stream: a handful
    ranked = F.transform("_bs", lambda b: F.struct(F.abs(F.col("center_cycle") - b).alias("d"), b.alias("b")))
    got = events.join(best, "dataset", "left").withColumn("_m", F.array_min(ranked))
    return got.select(*events.columns, F.col("_m.b").alias("boundary_cycle"), F.col("_m.d").alias("distance"), F.coalesce(F.col("_m.d") <= tolerance, F.lit(False)).alias("matched"))


def interval_map(points: DataFrame, segments: DataFrame, value: str = "center_cycle") -> DataFrame:
    """Piecewise-linear map by the first segment (dataset, seg, lo, hi, out_lo, out_hi) that holds the value.

    Values before all segments use the first one, values in gaps or after the end the last one; both extrapolate.
    """
    packed = segments.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct("seg", "lo", "hi", "out_lo", "out_hi"))).alias("_s"))
    x = F.col(value)
    inside = F.filter("_s", lambda s: (x >= s["lo"]) & (x <= s["hi"]))
    pick = F.when(F.size(inside) > 0, F.element_at(inside, 1)).when(x < F.element_at("_s", 1)["lo"], F.element_at("_s", 1)).otherwise(F.element_at("_s", -1))
    mapped = points.join(packed, "dataset").withColumn("_p", pick)
    out = F.col("_p.out_lo") + (x - F.col("_p.lo")) * (F.col("_p.out_hi") - F.col("_p.out_lo")) / (F.col("_p.hi") - F.col("_p.lo"))
    return mapped.withColumn("seg", F.col("_p.seg")).withColumn("mapped", out).drop("_s", "_p")


def forward_asof(df: DataFrame, horizon: float, value: str, stride: float = 5.0, slack: int = 4) -> DataFrame:
    """``due_index`` and ``due_value``: of the first row of the stream with center_cycle >= own + horizon.

    Windows lie ``stride`` cycles apart or more, so the row is within a bounded number of rows ahead: rows are dealt in
    chunks of descending position with that halo, and a frame of that many rows is searched for the first one due. A frame
    without an end would be run through anew for each row of a chunk.
    """
    ahead = int(horizon / stride) + slack
    last = df.groupBy("dataset").agg(F.max("window_index").alias("_last"))
    turned = df.join(last, "dataset").withColumn("_at", F.col("_last") - F.col("window_index") + 1)
    dealt = with_halo(turned, "_at", ahead)
    w = Window.partitionBy("dataset", "_chunk").orderBy("center_cycle").rowsBetween(0, ahead)
    near = F.collect_list(F.struct("center_cycle", "window_index", value)).over(w)
    due = F.get(F.filter("_near", lambda x: x["center_cycle"] >= F.col("center_cycle") + horizon), 0)
    return dealt.withColumn("_near", near).where(~F.col("_halo")).withColumn("_due", due).select(*df.columns, F.col("_due.window_index").alias("due_index"), F.col(f"_due.{value}").alias("due_value"))


#: Hashes of draws: small integer arithmetic, so that SQL can state the same.
DRAW_PRIME = 2_147_483_647


def draw_hash(k: Column, stratum: Column, seed: int) -> Column:
    """A number below DRAW_PRIME for draw ``k`` of a stratum."""
    x = (F.pmod(k, F.lit(DRAW_PRIME)) * 48_271 + stratum * 69_621 + seed * 39_373) % DRAW_PRIME
    for _ in range(3):
        x = (x * x + x * 48_271 + 12_345) % DRAW_PRIME
    return x


def draw_hash_sql(k: str, stratum: str, seed: int) -> str:
    x = f"(({k} % {DRAW_PRIME}) * 48271 + {stratum} * 69621 + {seed * 39_373}) % {DRAW_PRIME}"
    for _ in range(3):
        x = f"list_transform([{x}], lambda x: (x * x + x * 48271 + 12345) % {DRAW_PRIME})[1]"
    return x


def sampled_pairs(df: DataFrame, bins: list[tuple[float, float | None]], most: int, scratch: Scratch, stride: float = 5.0, seed: int = 11) -> DataFrame:
    """dataset, bin, earlier, later, gap: pairs of unguarded windows whose gap in cycles lies in a bin, ``most`` for each bin.

    ``df``: dataset, window_index, guard; windows lie ``stride`` cycles apart and none is missing. Pairs are counted and
    drawn, never enumerated: running counts of unguarded windows give each row its number of partners in a bin, running
    sums of these number all pairs of a bin, and draw k of m takes one number out of the k-th m-th of them by a hash. A
    number leads back to its row through buckets as wide as the draws are apart, of which a row covers few. A bin of no more
    than ``most`` pairs gives all of them.
    """
    rows = df.select("dataset", "window_index", F.col("guard").cast("int").alias("guard")).withColumn("_at", F.col("window_index") + 1).withColumn("free", (1 - F.col("guard")).cast("long"))
    ranked = scratch.settle(running_sum(rows, ["dataset"], "_at", "free", "rank"), "ranks")  # unguarded windows up to each
    ends = ranked.groupBy("dataset").agg(F.max("window_index").alias("last"), F.max("rank").alias("all"))
    limits = F.array(*[F.struct(F.lit(i).cast("long").alias("bin"), F.lit(int(-(-low // stride))).alias("lo"), F.lit(None if high is None else int(-(-high // stride))).cast("int").alias("hi")) for i, (low, high) in enumerate(bins)])
    asked = ranked.where("free = 1").join(ends, "dataset").select("dataset", "window_index", "rank", "last", "all", F.explode(limits).alias("_b")).select("*", "_b.*").drop("_b")
    before = lambda n: ranked.select("dataset", F.col("window_index").alias(f"at_{n}"), F.col("rank").alias(f"to_{n}"))
    at = lambda c: F.least(F.col("window_index") + F.col(c) - 1, F.col("last"))
    asked = asked.withColumns({"at_lo": at("lo"), "at_hi": F.coalesce(at("hi"), "last")}).join(before("lo"), ["dataset", "at_lo"]).join(before("hi"), ["dataset", "at_hi"])
    counted = asked.withColumn("first", F.greatest("to_lo", "rank") + 1).withColumn("n", F.greatest(F.col("to_hi") - F.col("first") + 1, F.lit(0)))
    counted = running_sum(counted.select("dataset", "bin", "window_index", "first", "n", (F.col("window_index") + 1).alias("_at")), ["dataset", "bin"], "_at", "n", "upto")
    counted = scratch.settle(counted.where("n > 0").select("dataset", "bin", "window_index", "first", (F.col("upto") - F.col("n")).alias("from"), "upto"), "counted")
    totals = counted.groupBy("dataset", "bin").agg(F.max("upto").alias("t")).withColumn("m", F.least("t", F.lit(most).cast("long"))).withColumn("width", F.floor(F.col("t") / F.col("m")))
    draws = totals.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    low, high = (F.floor((F.col("k") + i) * F.col("t") / F.col("m")) for i in (0, 1))
    draws = draws.withColumn("number", low + F.floor(draw_hash(F.col("k"), F.col("bin"), seed) / F.lit(float(DRAW_PRIME)) * (high - low)))
    drawn = draws.select("dataset", "bin", "number", F.floor(F.col("number") / F.col("width")).alias("_bucket"))
    spans = counted.join(totals.select("dataset", "bin", "width"), ["dataset", "bin"]).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("from") / F.col("width")), F.floor((F.col("upto") - 1) / F.col("width")))))
    hit = drawn.join(spans, ["dataset", "bin", "_bucket"]).where("number >= from AND number < upto").select("dataset", "bin", F.col("window_index").alias("earlier"), (F.col("first") + F.col("number") - F.col("from")).alias("rank"))
    later = ranked.where("free = 1").select("dataset", "rank", F.col("window_index").alias("later"))
    return hit.join(later, ["dataset", "rank"]).select("dataset", "bin", "earlier", "later", ((F.col("later") - F.col("earlier")) * stride).alias("gap"))


def fixed_gap_pairs(df: DataFrame, gap_rows: int, score: str) -> DataFrame:
    """Concordance of each row with the row ``gap_rows`` later: 1 up, 0 down, 0.5 tied."""
    later = df.select("dataset", (F.col("window_index") - gap_rows).alias("window_index"), F.col(score).alias("_later"))
    both = df.join(later, ["dataset", "window_index"])
    return both.withColumn("concordant", F.when(F.col("_later") > F.col(score), 1.0).when(F.col("_later") == F.col(score), 0.5).otherwise(0.0)).drop("_later")


def neighbourhood(df: DataFrame, peaks: DataFrame, width: int = 2) -> DataFrame:
    """Rows within ``width`` windows of a peak: peaks are spread over their neighbours and semi-joined by key."""
    near = peaks.select("dataset", F.explode(F.sequence(F.col("window_index") - width, F.col("window_index") + width)).alias("window_index")).distinct()
    return df.join(near, ["dataset", "window_index"], "left_semi")


def interval_fractions(df: DataFrame, spans: DataFrame, stages: int = 5, bucket: int = 64) -> DataFrame:
    """Stage shares of the windows inside each span (span_id, dataset, start_window, end_window), by position buckets."""
    cut = F.floor(F.col("window_index") / bucket)
    dealt = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_window") / bucket), F.floor(F.col("end_window") / bucket))))
    both = dealt.join(df.select("dataset", "window_index", "stage", cut.alias("_b")), ["dataset", "_b"]).where("window_index between start_window and end_window")
    share = [F.avg((F.col("stage") == k).cast("double")).alias(f"stage{k}") for k in range(1, stages + 1)]
    return both.groupBy("span_id", "dataset").agg(F.count("*").alias("n"), *share)


def max_difference(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Prefix check: the largest absolute difference of each column over shared keys, and the number of them."""
    both = a.select(*keys, *columns).join(b.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns]), keys)
    return both.agg(F.count("*").alias("n"), *[F.max(F.abs(F.col(c) - F.col(f"_{c}"))).alias(c) for c in columns])


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def lag_flag(df: DataFrame, column: str, name: str) -> DataFrame:
    return framed(df, ["dataset"], "_at", {name: lambda w: F.lag(column).over(w)}, 1)
