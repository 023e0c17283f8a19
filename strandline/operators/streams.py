"""Ordered streams: numbering, chunking with halos, count windows, guards, splits and baselines.

A stream is a ``dataset`` whose rows have a total order. Nothing here sorts a whole stream in one task: rows are numbered
inside order-preserving buckets and shifted by the counts of earlier buckets, and frames of bounded length run inside
chunks that carry the rows before them as a halo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("stage", "stage_label", "Stage1to5")


def number_rows(df: DataFrame, keys: list[str], bucket: Column, order: list[str], name: str = "cycle", total: str | None = None) -> DataFrame:
    """``name``: 1-based row number of each stream by (bucket, order); ``bucket`` must not run against the order.

    Buckets are numbered in parallel; only their counts, one row a bucket, meet in a window over the stream.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_bucket")
    before = counts.select(*keys, "_bucket", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    out = rows.join(before, [*keys, "_bucket"]).withColumn(name, (F.col("_before") + inside).cast("long"))
    return (out.withColumnRenamed("_total", total) if total else out.drop("_total")).drop("_bucket", "_before")


def with_halo(df: DataFrame, position: str, halo: int, rows: int = 8192) -> DataFrame:
    """Rows dealt to chunks of ``rows`` positions, each with the ``halo`` positions before it (``_halo`` true)."""
    at = F.col(position)
    own = F.floor((at - 1) / rows).cast("long")
    copies = F.when((at - 1) % rows >= rows - halo, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_chunk", F.explode(copies)).withColumn("_halo", F.col("_chunk") != own)


def framed(df: DataFrame, keys: list[str], position: str, columns: dict, halo: int, rows: int = 8192) -> DataFrame:
    """``df`` with window columns; ``columns`` maps names to functions of the ordered window of a chunk.

    Every function may look back at most ``halo`` rows. Chunks of one stream run in parallel.
    """
    dealt = with_halo(df, position, halo, rows)
    w = Window.partitionBy(*keys, "_chunk").orderBy(position)
    return dealt.withColumns({name: make(w) for name, make in columns.items()}).where(~F.col("_halo")).drop("_chunk", "_halo")


def running_sum(df: DataFrame, keys: list[str], position: str, value: str, name: str, rows: int = 8192) -> DataFrame:
    """Inclusive running sum over a whole stream: inside chunks, plus the sums of earlier chunks."""
    chunked = df.withColumn("_chunk", F.floor((F.col(position) - 1) / rows).cast("long"))
    sums = chunked.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_chunk", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(Window.unboundedPreceding, 0))
    return chunked.join(before, [*keys, "_chunk"]).withColumn(name, F.col("_before") + inside).drop("_chunk", "_before")


def equal_stages(cycle: Column, n: Column, stages: int = 5) -> Column:
    return F.least(F.lit(stages), 1 + F.floor(stages * (cycle - 1) / n)).cast("int")


def count_windows(df: DataFrame, values: dict[str, Column], k: int = 20, stride: int = 5) -> DataFrame:
    """Windows of ``k`` cycles every ``stride`` cycles (incomplete ones are dropped), with ids and the last stage.

    Each row goes to the windows that hold it, so that partial aggregation works and no stream is sorted.
    """
    zero = F.col("cycle") - 1
    first, last = F.greatest(F.lit(0), F.ceil((zero - (k - 1)) / stride)), F.floor(zero / stride)
    spread = df.withColumn("window_index", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    got = spread.groupBy("dataset", "window_index").agg(F.count("*").alias("_n"), F.max_by("stage", "cycle").alias("stage"), *(v.alias(n) for n, v in values.items()))
    start = F.col("window_index") * stride + 1
    return got.where(F.col("_n") == k).select(
        "dataset", "window_index", start.alias("start_cycle"), (start + k - 1).alias("end_cycle"), (start + (k - 1) / 2.0).alias("center_cycle"), "stage", (start + k - 1 <= 500).cast("int").alias("baseline_window"), *values
    )


# ------------------------------------------------------------------ guards


def guard_overlap(start: Column, end: Column, interval: float = 500, guard: float = 100) -> Column:
    """The window overlaps [b, b + guard] for a stop b = interval * j, j >= 0."""
    return (start <= F.floor(end / interval) * interval + guard).cast("int")


def guard_prior(center: Column, interval: float = 500, guard: float = 100, clamp: bool = False) -> Column:
    """The centre lies at most ``guard`` after the stop before it; ``clamp`` lets stops begin at one interval."""
    stop = F.floor(center / interval) * interval
    near = (center - stop >= 0) & (center - stop <= guard)
    return (near & (stop >= interval) if clamp else near).cast("int")


def guard_nearest(start: Column, center: Column, end: Column, interval: float = 500, guard: float = 50) -> tuple[Column, Column, Column]:
    """(nearest stop, crosses a stop, guarded); the nearest stop is rounded half to even and at least one interval."""
    nearest = F.greatest(F.lit(float(interval)), F.rint(center / interval) * interval)
    crosses = (start < nearest) & (end > nearest)
    return nearest, crosses.cast("int"), (crosses | (F.abs(center - nearest) <= guard)).cast("int")


def guard_restart(df: DataFrame, interval: float = 500, guard: float = 50) -> DataFrame:
    """period, restart (period changes) and guard around the preceding stop only."""
    period = F.floor((F.col("center_cycle") - 1) / interval)
    lagged = framed(df.withColumn("period", period).withColumn("_at", F.col("window_index") + 1), ["dataset"], "_at", {"_before": lambda w: F.lag("period").over(w)}, 1)
    near = F.abs(F.col("center_cycle") - interval * F.col("period")) <= guard
    return lagged.withColumn("restart", F.coalesce(F.col("period") != F.col("_before"), F.lit(False)).cast("int")).withColumn("guarded", near.cast("int")).drop("_before", "_at")


# ------------------------------------------------------------------ baselines and splits


def baseline_mask(df: DataFrame, limit: float = 500, least: int = 20, fallback: int = 100, mode: str = "reset") -> DataFrame:
    """``in_baseline``: end_cycle <= limit; with fewer than ``least`` such rows the first ``fallback`` rows.

    mode: "reset" uses the first rows instead, "or" adds them, "raise" leaves the mask as it is.
    """
    counts = df.groupBy("dataset").agg(F.sum((F.col("end_cycle") <= limit).cast("long")).alias("_few"))
    inside, first = F.col("end_cycle") <= limit, F.col("window_index") < fallback
    short = F.col("_few") < least
    mask = {"reset": F.when(short, first).otherwise(inside), "or": inside | (short & first), "raise": inside}[mode]
    return df.join(counts, "dataset").withColumn("in_baseline", mask.cast("int")).drop("_few")


def stage_split(df: DataFrame, share: float = 0.7, gap: int = 20, least: int = 20) -> DataFrame:
    """Per stage: the first ``share`` of rows trains, rows after the cut and an embargo of ``gap`` validate.

    Stages under ``least`` rows take no part. ``part``: train, validation or none.
    """
    df = number_rows(df, ["dataset", "stage"], F.floor(F.col("window_index") / 8192), ["window_index"], "_rn", "_size")
    rn, size = F.col("_rn") - 1, F.col("_size")
    cut = F.floor(size * share)
    part = F.when(size < least, "none").when(rn < cut - gap, "train").when(rn >= cut + gap, "validation").otherwise("none")
    return df.withColumn("part", part).drop("_rn", "_size")


def chrono_split(df: DataFrame, share: float = 0.7, gap: int = 20) -> DataFrame:
    """Chronological split with an embargo after the cut; windows are numbered already, so no sort is needed."""
    n = df.groupBy("dataset").agg(F.count("*").alias("_n"))
    cut = F.floor(F.col("_n") * share)
    part = F.when(F.col("window_index") < cut, "train").when(F.col("window_index") >= cut + gap, "validation").otherwise("embargo")
    return df.join(n, "dataset").withColumn("part", part).drop("_n")


def forbid_columns(df: DataFrame, names=LABELS) -> DataFrame:
    """Label-leak guard at model boundaries."""
    found = [c for c in df.columns if c in names]
    if found:
        raise ValueError(f"label columns are not allowed here: {', '.join(found)}")
    return df


def drop_labels(df: DataFrame, names=LABELS) -> DataFrame:
    return df.drop(*names)


def assert_unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"rows repeat the key {', '.join(keys)}")
    return df


def support_filter(long: DataFrame) -> DataFrame:
    """Feature eligibility by finite share, distinct values, range and IQR (one grouped pass over long rows)."""
    v = F.col("value")
    stats = long.groupBy("dataset", "feature_name").agg(
        F.avg(v.isNotNull().cast("double")).alias("finite_share"), F.count_distinct(F.round(v, 12)).alias("n_unique"), F.percentile(v, F.array(*map(F.lit, (0.01, 0.25, 0.75, 0.99)))).alias("q"), F.avg((v > 0).cast("double")).alias("positive_share")
    )
    q = lambda i: F.element_at("q", i)
    ok = (F.col("finite_share") >= 0.99) & (F.col("n_unique") >= 20) & (q(4) - q(1) > 1e-6) & (q(3) - q(2) > 1e-6)
    return stats.select("dataset", "feature_name", "finite_share", "n_unique", (q(4) - q(1)).alias("span"), (q(3) - q(2)).alias("iqr"), "positive_share", ok.cast("int").alias("eligible"))
