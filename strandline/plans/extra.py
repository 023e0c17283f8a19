"""Further queries: operating points, comparisons, alignment, weights, fusion grids, heads and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.operators import metrics as M
from strandline.operators import models as L
from strandline.operators import rolling as R
from strandline.operators import streams as S
from strandline.plans import base as B
from strandline.plans.base import r6
from strandline.plans.catalog import LATE, OV, RECURSIVE, REGION, ROC, frame, late, query, regions

Z = [f"z_{f}" for f in B.FEATURES]


@query(LATE + ", t AS (SELECT dataset, quantile_cont(ra, 0.95) AS t FROM la WHERE stage <= 2 GROUP BY 1) SELECT dataset, round(t, 6) AS threshold, round(avg(CASE WHEN ra >= t THEN 1.0 ELSE 0.0 END) FILTER (stage = 5), 6) AS recall, round(avg(CASE WHEN ra >= t THEN 1.0 ELSE 0.0 END) FILTER (stage <= 2), 6) AS early_fpr FROM la JOIN t USING (dataset) GROUP BY dataset, t")
def recall_at_early_fpr(s, sf):
    sc = late(s, sf)
    t = sc.where("stage <= 2").groupBy("dataset").agg(M.med("ra", 0.95).alias("t"))
    hit = (F.col("ra") >= F.col("t")).cast("double")
    return sc.join(t, "dataset").groupBy("dataset", "t").agg(F.avg(F.when(F.col("stage") == 5, hit)).alias("recall"), F.avg(F.when(F.col("stage") <= 2, hit)).alias("early_fpr")).select("dataset", r6("t", "threshold"), r6("recall"), r6("early_fpr"))


@query(REGION + f", g AS (SELECT *, coalesce(lag(high) {OV}, false) AS b FROM rg) SELECT dataset, round(1000.0 * count(*) FILTER (high AND NOT b AND stage <= 2) / (max(end_cycle) FILTER (stage <= 2) - min(start_cycle) FILTER (stage <= 2)), 6) AS alarms FROM g GROUP BY 1")
def false_alarm_rate(s, sf):
    rows = S.framed(regions(s, sf).withColumn("high", F.col("awr") >= F.col("ta")), ["dataset"], "_at", {"_b": lambda w: F.coalesce(F.lag("high").over(w), F.lit(False))}, 1)
    early = rows.where("stage <= 2").groupBy("dataset").agg(F.sum((F.col("high") & ~F.col("_b")).cast("long")).alias("n"), (F.max("end_cycle") - F.min("start_cycle")).alias("span"))
    return early.select("dataset", r6(1000.0 * F.col("n") / F.col("span"), "alarms"))


@query("SELECT dataset, round(median(awr) FILTER (stage = 5) - median(awr) FILTER (stage = 1), 6) AS shift, round(median(bd) FILTER (stage = 5) - median(bd) FILTER (stage = 1), 6) AS bd_shift FROM sc GROUP BY 1")
def suppression_delta(s, sf):
    d = lambda c: M.med(F.when(F.col("stage") == 5, F.col(c))) - M.med(F.when(F.col("stage") == 1, F.col(c)))
    return B.scores(s, sf).groupBy("dataset").agg(r6(d("awr"), "shift"), r6(d("bd"), "bd_shift"))


@query(REGION + " SELECT dataset, window_index, round(avg(CASE WHEN high_pair THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS occupancy100 FROM rg")
def rolling_occupancy(s, sf):
    rows = regions(s, sf).withColumn("_f", (F.col("region") == "high_high").cast("double"))
    return frame(s, sf, {"occupancy100": R.rolling_mean("_f", 100)}, 99, rows).select("dataset", "window_index", r6("occupancy100"))


@query(f", d AS (SELECT dataset, window_index, (awr - lag(awr) {OV}) / 5 AS d FROM sc) SELECT dataset, window_index, round(quantile_cont(d, 0.5) OVER (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN 98 PRECEDING AND CURRENT ROW), 6) AS slope FROM d")
def median_slope(s, sf):
    d = frame(s, sf, {"_d": lambda w: (F.col("awr") - F.lag("awr").over(w)) / 5}, 1)
    return frame(s, sf, {"slope": R.rolling_median("_d", 99)}, 98, d).select("dataset", "window_index", r6("slope"))


@query(", h AS (SELECT dataset, CASE WHEN start_cycle <= floor(end_cycle / 500) * 500 + 100 THEN 1 ELSE 0 END AS guard, awr, bd FROM sc) SELECT dataset, guard, count(*) AS n, round(median(awr), 6) AS awr, round(median(bd), 6) AS bd FROM h GROUP BY ALL")
def guard_comparison(s, sf):
    rows = B.scores(s, sf).withColumn("guard", S.guard_overlap(F.col("start_cycle"), F.col("end_cycle")))
    return rows.groupBy("dataset", "guard").agg(F.count("*").alias("n"), r6(M.med("awr"), "awr"), r6(M.med("bd"), "bd"))


@query("SELECT dataset, feature_name, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{int(q * 100):02d}" for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM lo GROUP BY ALL")
def support_quantiles(s, sf):
    qs = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    got = B.long_features(s, sf).groupBy("dataset", "feature_name").agg(F.percentile("value", F.array(*map(F.lit, qs))).alias("q"))
    return got.select("dataset", "feature_name", *[r6(F.get("q", i), f"p{int(q * 100):02d}") for i, q in enumerate(qs)])


@query(", q AS (SELECT dataset, feature_name, quantile_cont(value, 0.2) AS a, quantile_cont(value, 0.8) AS b FROM lo GROUP BY ALL) SELECT dataset, feature_name, round(avg(value), 6) AS trimmed_mean FROM lo JOIN q USING (dataset, feature_name) WHERE value BETWEEN a AND b GROUP BY ALL")
def trimmed_mean(s, sf):
    lo = B.long_features(s, sf)
    q = lo.groupBy("dataset", "feature_name").agg(M.med("value", 0.2).alias("a"), M.med("value", 0.8).alias("b"))
    return lo.join(q, ["dataset", "feature_name"]).where("value between a and b").groupBy("dataset", "feature_name").agg(r6(F.avg("value"), "trimmed_mean"))


@query(", q AS (SELECT dataset, median(awr) AS m, quantile_cont(awr, 0.75) - quantile_cont(awr, 0.25) AS i FROM sc WHERE baseline_window = 1 GROUP BY 1), r AS (SELECT m AS ms, i AS si FROM q WHERE dataset = (SELECT min(dataset) FROM q)) SELECT dataset, window_index, round(ms + greatest(0.5, least(2.0, si / greatest(i, 1e-9))) * (awr - m), 6) AS aligned FROM sc JOIN q USING (dataset), r")
def logit_alignment(s, sf):
    """Scores of every stream moved to the baseline centre and (clipped) spread of a source stream: the first by name."""
    sc = B.scores(s, sf)
    q = sc.where("baseline_window = 1").groupBy("dataset").agg(M.med("awr").alias("m"), (M.med("awr", 0.75) - M.med("awr", 0.25)).alias("i"))
    source = q.agg(F.min_by(F.struct("m", "i"), "dataset").alias("s")).first()  # two numbers
    ms, si = source["s"] or (None, None)
    scale = A.clip(F.lit(si).cast("double") / F.greatest("i", F.lit(1e-9)), 0.5, 2.0)
    return sc.join(q, "dataset").select("dataset", "window_index", r6(F.lit(ms).cast("double") + scale * (F.col("awr") - F.col("m")), "aligned"))


@query("SELECT dataset, round(corr(z_x_mean, z_x_rms), 6) AS mean_rms, round(corr(z_x_mean, z_x_p2p), 6) AS mean_p2p, round(corr(z_x_rms, z_x_p2p), 6) AS rms_p2p FROM sc GROUP BY 1")
def feature_correlation(s, sf):
    return B.scores(s, sf).groupBy("dataset").agg(r6(F.corr(Z[0], Z[1]), "mean_rms"), r6(F.corr(Z[0], Z[2]), "mean_p2p"), r6(F.corr(Z[1], Z[2]), "rms_p2p"))


@query(", e AS (SELECT dataset, feature_name, abs(median(z_value) FILTER (stage = 5) - median(z_value) FILTER (stage = 1)) AS d FROM z GROUP BY ALL) SELECT dataset, feature_name, round(CASE WHEN d < 0.05 THEN 0 ELSE d END / sum(CASE WHEN d < 0.05 THEN 0 ELSE d END) OVER (PARTITION BY dataset), 6) AS weight FROM e")
def feature_weights(s, sf):
    """Shares of the features in a stream's shift; NaN where no feature of it shifts, null for a feature without a shift."""
    d = M.direction_signs(B.z_long(s, sf)).withColumn("_d", F.when(F.abs("delta") < 0.05, 0.0).otherwise(F.abs("delta")))
    return d.select("dataset", "feature_name", r6(A.divided(F.col("_d"), F.sum("_d").over(Window.partitionBy("dataset"))), "weight"))


ALPHA = ", g AS (SELECT unnest(generate_series(0, 20)) AS k), la AS (SELECT dataset || ':' || CAST(k AS VARCHAR) AS dataset, window_index, CASE WHEN stage = 5 THEN 1 ELSE 0 END AS late, round(k / 20.0::DOUBLE * z_x_mean + (1 - k / 20.0::DOUBLE) * z_x_p2p, 9) AS ra FROM sc, g)"


@query(ALPHA + ROC + " SELECT dataset, round((s - p * (p + 1) / 2) / (p * n), 6) AS auroc FROM au")
def alpha_fusion_grid(s, sf):
    """AUROC of 21 mixtures of two channels; every row meets the fixed grid, so the growth is a constant factor."""
    a = F.col("k") / F.lit(20.0)
    grid = late(s, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn("ra", F.round(a * F.col(Z[0]) + (1 - a) * F.col(Z[2]), 9))
    return M.auroc(grid.withColumn("dataset", F.concat_ws(":", "dataset", F.col("k").cast("string"))), ["dataset"], "ra", "late").select("dataset", r6("auroc"))


@query(LATE + ", d AS (SELECT dataset, round(ra, 1) + 0.0 AS t, sum(late) AS p, count(*) AS c FROM la GROUP BY ALL), c AS (SELECT dataset, t, sum(p) OVER w AS tp, sum(c) OVER w AS n, sum(p) OVER a AS pos FROM d WINDOW w AS (PARTITION BY dataset ORDER BY t DESC), a AS (PARTITION BY dataset)) SELECT dataset, round(t, 1) + 0.0 AS threshold, round(tp / n, 6) AS precision, round(tp / pos, 6) AS recall FROM c")
def pr_curve(s, sf):
    rows = late(s, sf).withColumn("t", F.round("ra", 1) + 0.0)  # no negative zero
    return L.threshold_candidates(rows, ["dataset"], "t", "late").select("dataset", (F.round("threshold", 1) + 0.0).alias("threshold"), r6("precision"), r6("recall"))


@query(", a AS (SELECT DISTINCT dataset, window_index FROM sc WHERE awr > 1), b AS (SELECT DISTINCT dataset, window_index FROM sc WHERE bd > 1) SELECT 'both' AS part, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'score_only', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def set_operations(s, sf):
    sc = B.scores(s, sf)
    a, b = sc.where("awr > 1").select("dataset", "window_index"), sc.where("bd > 1").select("dataset", "window_index")
    keys = ["dataset", "window_index"]
    return a.join(b, keys, "left_semi").select(F.lit("both").alias("part"), *keys).unionByName(a.join(b, keys, "left_anti").select(F.lit("score_only").alias("part"), *keys))


@query(", r AS (SELECT dataset, window_index, awr AS reference FROM sc WHERE window_index % 25 = 24 OR window_index = (SELECT max(window_index) FROM sc m WHERE m.dataset = sc.dataset)) SELECT dataset, window_index, round(reference, 6) AS reference, round(sc.bd, 6) AS bd FROM (SELECT * FROM sc WHERE bd > 1) sc RIGHT JOIN r USING (dataset, window_index)")
def right_join_reference(s, sf):
    sc = B.scores(s, sf)
    last = sc.groupBy("dataset").agg(F.max("window_index").alias("_last"))
    # the reference is resampled: every 25th window and the last one
    r = sc.join(last, "dataset").where("window_index % 25 = 24 or window_index = _last").select("dataset", "window_index", F.col("awr").alias("reference"))
    return sc.where("bd > 1").select("dataset", "window_index", "bd").join(r, ["dataset", "window_index"], "right").select("dataset", "window_index", r6("reference"), r6("bd"))


@query(", k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY abs(awr) DESC, window_index) AS i FROM sc) SELECT dataset, i AS rank, window_index, round(awr, 6) AS awr FROM k WHERE i <= 10")
def top_by_magnitude(s, sf):
    """Top ten of each stream by absolute score (a top-k report)."""
    w = Window.partitionBy("dataset").orderBy(F.abs("awr").desc(), "window_index")
    return B.scores(s, sf).withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("dataset", F.col("rank").cast("long").alias("rank"), "window_index", r6("awr"))


@query(
    ", e AS (SELECT dataset, window_index, greatest(0, least(1, 1 - bd / 10)) AS e FROM sc), r AS ("
    "SELECT dataset, CAST(-1 AS BIGINT) AS window_index, CAST(1 AS DOUBLE) AS v FROM (SELECT DISTINCT dataset FROM e) UNION ALL "
    "SELECT e.dataset, e.window_index, CASE WHEN e.e < v THEN greatest(0.5, e.e, v - 0.02) ELSE least(1, e.e, v + 0.01) END FROM r JOIN e ON e.dataset = r.dataset AND e.window_index = r.window_index + 1) "
    "SELECT dataset, window_index, round(v, 6) AS reliability FROM r WHERE window_index >= 0",
    RECURSIVE,
)
def reliability(s, sf):
    from strandline.streaming import hosts, machines

    rows = B.scores(s, sf).select("dataset", "window_index", A.clip(1 - F.col("bd") / 10, 0.0, 1.0).alias("evidence"))
    got = hosts.backfill(rows, ["dataset"], "window_index", machines.Reliability, "dataset string, window_index long, reliability double", ["reliability"])
    return got.select("dataset", "window_index", r6("reliability"))
