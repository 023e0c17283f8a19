"""Aggregates: robust location and scale, normalisation, effect sizes, ranking metrics, calibration, summaries.

Rank-based metrics work on counts of distinct scores, so that equal scores cost one row, and on running sums over ranges
of them (``prefix``), so that no stream is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.operators.prefix import running_totals
from strandline.sources.shared import Scratch


def med(c, q: float = 0.5) -> Column:
    return F.percentile(F.col(c) if isinstance(c, str) else c, F.lit(q))


def robust_stats(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """median, iqr, mad and scale = max(1.4826 mad, iqr / 1.349, 1e-9): two passes, since the mad needs the median."""
    first = df.groupBy(*keys).agg(med(column).alias("median"), (med(column, 0.75) - med(column, 0.25)).alias("iqr"))
    second = df.join(first, keys).groupBy(*keys).agg(med(F.abs(F.col(column) - F.col("median"))).alias("mad"))
    return first.join(second, keys).select(*keys, "median", "iqr", "mad", F.greatest(1.4826 * F.col("mad"), F.col("iqr") / 1.349, F.lit(1e-9)).alias("scale"))


def robust_z(long: DataFrame, limit: float = 12.0, eps: float = 1e-9) -> DataFrame:
    """Baseline z of long rows (dataset, feature_name, value, baseline_window): (x - median) / (IQR + eps), clipped."""
    base = long.where("baseline_window = 1").groupBy("dataset", "feature_name").agg(med("value").alias("median_base"), (med("value", 0.75) - med("value", 0.25)).alias("iqr_base"))
    z = (F.col("value") - F.col("median_base")) / (F.col("iqr_base") + eps)
    return long.join(base, ["dataset", "feature_name"]).withColumn("z_value", A.clip(z, -limit, limit))


def saturation(z: DataFrame, limit: float = 12.0) -> DataFrame:
    at = F.abs(F.col("z_value")) >= limit - 0.1
    return z.groupBy("dataset", "feature_name").agg(F.avg((at & (F.col("z_value") < 0)).cast("double")).alias("low_rate"), F.avg((at & (F.col("z_value") > 0)).cast("double")).alias("high_rate"), F.avg(F.col("value").isNull().cast("double")).alias("missing_rate"))


def mid_ranks(df: DataFrame, keys: list[str], score: str, label: str, scratch: Scratch) -> DataFrame:
    """One row for each distinct score: positives, rows, and the mid rank of the score."""
    per = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum(label).alias("pos"), F.count("*").alias("cnt"))
    summed = running_totals(per, keys, [F.col(score)], {"_r": F.col("cnt")}, scratch)
    return summed.withColumn("rank", F.col("_r") - (F.col("cnt") - 1) / 2).drop("_r")


def auroc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Mann-Whitney AUROC with mid ranks; null where a class is missing."""
    scratch = Scratch(df.sparkSession, "auroc")
    p, n = F.sum("pos"), F.sum("cnt") - F.sum("pos")
    got = mid_ranks(df, keys, score, label, scratch).groupBy(*keys).agg((F.sum(F.col("rank") * F.col("pos")) - p * (p + 1) / 2).alias("_u"), p.alias("n_pos"), n.alias("n_neg"))
    result = got.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))
    return scratch.last(result)


def average_precision(df: DataFrame, keys: list[str], score: str, label: str, tie: str) -> DataFrame:
    """Sum of the precision at each positive over the number of positives, by falling score and then ``tie``."""
    scratch = Scratch(df.sparkSession, "average-precision")
    rows = df.where(F.col(score).isNotNull()).select(*keys, score, tie, F.col(label).alias("y"))
    hit = running_totals(rows, keys, [F.col(score).desc(), F.col(tie)], {"rn": F.lit(1).cast("long"), "tp": F.col("y").cast("long")}, scratch)
    return scratch.last(hit.where("y = 1").groupBy(*keys).agg(F.avg(F.col("tp") / F.col("rn")).alias("average_precision")))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    scratch = Scratch(df.sparkSession, "spearman")
    for c, name in ((a, "_ra"), (b, "_rb")):
        per = df.groupBy(*keys, c).agg(F.count("*").alias("_c"))
        ranked = running_totals(per, keys, [F.col(c)], {"_r": F.col("_c")}, scratch)
        df = df.join(ranked.select(*keys, c, (F.col("_r") - (F.col("_c") - 1) / 2).alias(name)), [*keys, c])
    spread = F.nullif(F.stddev_pop("_ra") * F.stddev_pop("_rb"), F.lit(0.0))  # null where one side does not vary
    return scratch.last(df.groupBy(*keys).agg((F.covar_pop("_ra", "_rb") / spread).alias("spearman")))


def cliffs_delta(df: DataFrame, keys: list[str], value: str, late: str) -> DataFrame:
    """Cliff's delta of late rows against the others, by mid ranks, and Cohen's d with the pooled deviation."""
    area = auroc(df, keys, value, late).select(*keys, (2 * F.col("auroc") - 1).alias("cliffs_delta"))
    x, one = F.col(value), F.col(late) == 1
    m = df.groupBy(*keys).agg(F.avg(F.when(one, x)).alias("m1"), F.avg(F.when(~one, x)).alias("m0"), F.var_samp(F.when(one, x)).alias("v1"), F.var_samp(F.when(~one, x)).alias("v0"), F.count(F.when(one, x)).alias("n1"), F.count(F.when(~one, x)).alias("n0"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return m.select(*keys, F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled).alias("cohen_d")).join(area, keys)


def direction_signs(long: DataFrame, least: float = 0.05) -> DataFrame:
    """Sign of the median shift from stage 1 to stage 5 of each feature; small shifts are 0."""
    z = F.col("z_value")
    got = long.groupBy("dataset", "feature_name").agg(med(F.when(F.col("stage") == 1, z)).alias("early"), med(F.when(F.col("stage") == 5, z)).alias("late"))
    delta = F.col("late") - F.col("early")
    return got.select("dataset", "feature_name", "early", "late", delta.alias("delta"), F.when(F.abs(delta) < least, 0).otherwise(F.coalesce(F.signum(delta), F.lit(0))).cast("int").alias("direction_sign"))


def calibration(df: DataFrame, keys: list[str], p: str, label: str, bins: int = 10) -> DataFrame:
    """ECE over equal bins (the last one closed), Brier score and mean entropy of a probability."""
    q, y = F.col(p), F.col(label)
    bin_ = F.least(F.floor(q * bins), F.lit(bins - 1))
    safe = A.clip(q, 1e-12, 1 - 1e-12)
    per = df.withColumn("_bin", bin_).groupBy(*keys, "_bin").agg(F.count("*").alias("n"), F.abs(F.avg(q) - F.avg(y)).alias("gap"), F.sum((q - y) * (q - y)).alias("sq"), F.sum(-(safe * F.log(safe) + (1 - safe) * F.log(1 - safe))).alias("h"))
    return per.groupBy(*keys).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"), (F.sum("h") / F.sum("n")).alias("entropy"))


def class_metrics(df: DataFrame, keys: list[str], truth: str, guess: str, classes: int = 5) -> DataFrame:
    """Macro F1 over classes that occur, accuracy and mean absolute distance of ordinal classes."""
    t, g = F.col(truth), F.col(guess)
    sums = [F.avg((t == g).cast("double")).alias("accuracy"), F.avg(F.abs(t - g)).alias("ordinal_mae")]
    for k in range(1, classes + 1):
        both, either = F.sum(((t == k) & (g == k)).cast("long")), F.sum((t == k).cast("long")) + F.sum((g == k).cast("long"))
        sums.append(F.when(either > 0, 2 * both / either).alias(f"_f{k}"))
    f = [F.col(f"_f{k}") for k in range(1, classes + 1)]
    return df.groupBy(*keys).agg(*sums).select(*keys, "accuracy", "ordinal_mae", A.mean_present(f).alias("macro_f1"))


def occupancy(df: DataFrame, regions: list[str]) -> DataFrame:
    """Counts and shares by stream, stage and region, with zeros for regions that do not occur."""
    counts = df.groupBy("dataset", "stage", "region").agg(F.count("*").alias("n"))
    spine = counts.select("dataset", "stage").distinct().withColumn("region", F.explode(F.array(*map(F.lit, regions))))
    w = Window.partitionBy("dataset", "stage")
    return spine.join(counts, ["dataset", "stage", "region"], "left").select("dataset", "stage", "region", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.sum(F.coalesce("n", F.lit(0))).over(w)).alias("share"))


def deciles(df: DataFrame, column: str, label: str) -> DataFrame:
    """Tenths of a stream by window index with edges int(n d / 10), their median score and label share."""
    n = df.groupBy("dataset").agg(F.count("*").alias("_n"))
    tenth = F.floor((F.col("window_index") * 10 + 9) / F.col("_n")).cast("int")
    exact = F.when(F.floor(F.col("_n") * (tenth + 1) / 10) <= F.col("window_index"), tenth + 1).when(F.floor(F.col("_n") * tenth / 10) > F.col("window_index"), tenth - 1).otherwise(tenth)
    return df.join(n, "dataset").groupBy("dataset", exact.alias("decile")).agg(F.count("*").alias("n"), med(column).alias("median_score"), F.avg(label).alias("share"))


def forecast_metrics(df: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    e = F.col(guess) - F.col(truth)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))
