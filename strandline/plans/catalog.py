"""Every query of the library by name, with the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.operators import joins as J
from strandline.operators import metrics as M
from strandline.operators import models as L
from strandline.operators import rolling as R
from strandline.operators import streams as S
from strandline.operators import topk as K
from strandline.plans import base as B
from strandline.plans.base import SQL, SQL_LINES, SQL_WAVES, r6
from strandline.sources import tables as T
from strandline.sources.shared import Scratch
from strandline.streaming import hosts as H
from strandline.streaming import machines as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, on: str = SQL):
    """Register a function under its name, with the SELECT that follows the shared views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = on + sql
        return f

    return add


def frame(s, sf, columns: dict, halo: int, of=None) -> DataFrame:
    return S.framed(of if of is not None else B.scores(s, sf), ["dataset"], "_at", columns, halo)


#: The shared views, for queries that go on with a recursive one.
RECURSIVE = SQL.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1)
W20 = "OVER (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
OV = "OVER (PARTITION BY dataset ORDER BY window_index)"

# ================================================================== scans, projections, arrays


@query("SELECT dataset, vec_id, list_reduce(s, lambda a, b: a + b) IS NOT NULL AS ok, len(s) AS n, round(s[1], 6) AS first, round(s[12], 6) AS last FROM sl", SQL_WAVES)
def scan_wide_slice(s, sf):
    w = B.waves(s, sf).select("dataset", "vec_id", A.phase_slice(F.col("wave"), 64).alias("s"))
    return w.select("dataset", "vec_id", (F.size("s") > 0).alias("ok"), F.size("s").cast("long").alias("n"), r6(F.element_at("s", 1), "first"), r6(F.element_at("s", -1), "last"))


@query("SELECT dataset, cycle, round(rx, 8) AS rx, round(ry, 8) AS ry, round(sqrt(rx * rx + ry * ry), 8) AS rs FROM ls", SQL_LINES)
def ratio_channels(s, sf):
    return B.stream_lineitem(s, sf).select("dataset", "cycle", *[F.round(c, 8).alias(c) for c in ("rx", "ry", "rs")])


@query(
    "SELECT dataset, vec_id, round(list_avg(s), 6) AS mean, round(list_avg(list_transform(s, lambda x: abs(x))), 6) AS absmean, round(sqrt(list_avg(list_transform(s, lambda x: x * x))), 6) AS rms, "
    "round(list_stddev_pop(s), 6) AS std, round(list_max(s) - list_min(s), 6) AS p2p, round(list_aggregate(s, 'quantile_cont', 0.95), 6) AS q95, round(list_aggregate(s, 'quantile_cont', 0.05), 6) AS q05 FROM sl",
    SQL_WAVES,
)
def array_stats(s, sf):
    v = F.col("s")
    w = B.waves(s, sf).select("dataset", "vec_id", A.phase_slice(F.col("wave"), 64).alias("s"))
    return w.select(
        "dataset", "vec_id", r6(A.mean(v), "mean"), r6(A.mean(v, F.abs), "absmean"), r6(F.sqrt(A.mean(v, lambda x: x * x)), "rms"), r6(A.deviation(v), "std"), r6(F.array_max(v) - F.array_min(v), "p2p"), r6(A.quantile(v, 0.95), "q95"), r6(A.quantile(v, 0.05), "q05")
    )


@query(
    ", p AS (SELECT dataset, vec_id, unnest(s) AS x, unnest(generate_series(1, len(s))) AS i FROM sl), b AS (SELECT dataset, i, avg(x) AS m FROM p GROUP BY ALL) "
    "SELECT p.dataset, vec_id, round(1 - corr(x, m), 6) AS corrdist FROM p JOIN b USING (dataset, i) GROUP BY ALL",
    SQL_WAVES,
)
def corrdist(s, sf):
    w = B.waves(s, sf).select("dataset", "vec_id", A.phase_slice(F.col("wave"), 64).alias("s"))
    base = w.select("dataset", F.posexplode("s").alias("i", "x")).groupBy("dataset", "i").agg(F.avg("x").alias("m"))
    base = base.groupBy("dataset").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("b"))
    return w.join(base, "dataset").select("dataset", "vec_id", r6(A.correlation_distance(F.col("s"), F.col("b")), "corrdist"))


@query(
    ", a AS (SELECT dataset, vec_id, list_transform(s, lambda x: abs(x)) AS a FROM sl) SELECT dataset, vec_id, list_position(a, list_max(a)) + 28 AS peak_phase, "
    "round(len(list_filter(a, lambda x: x >= 0.8 * list_max(a))) / len(a), 6) AS peak_width FROM a",
    SQL_WAVES,
)
def peak_phase(s, sf):
    w = B.waves(s, sf).select("dataset", "vec_id", A.phase_slice(F.col("wave"), 64).alias("s"))
    return w.select("dataset", "vec_id", A.peak_phase(F.col("s"), 29).cast("long").alias("peak_phase"), r6(A.peak_width(F.col("s")), "peak_width"))


@query(", m AS (SELECT dataset, median(ry) AS m FROM ls GROUP BY 1) SELECT dataset, cycle, round(coalesce(ry, m), 6) AS ry, ry IS NULL AS imputed FROM ls JOIN m USING (dataset)", SQL_LINES)
def impute_median(s, sf):
    li = B.stream_lineitem(s, sf)
    m = li.groupBy("dataset").agg(M.med("ry").alias("_m"))
    return li.join(m, "dataset").select("dataset", "cycle", r6(F.coalesce("ry", "_m"), "ry"), F.col("ry").isNull().alias("imputed"))


@query("SELECT dataset, window_index, round(1 / (1 + exp(-greatest(-35, least(35, awr)))), 6) AS p, round(ln(greatest(1e-6, least(1 - 1e-6, 0.5 + awr / 100)) / (1 - greatest(1e-6, least(1 - 1e-6, 0.5 + awr / 100)))), 6) AS l FROM sc")
def sigmoid_logit(s, sf):
    return B.scores(s, sf).select("dataset", "window_index", r6(A.sigmoid(F.col("awr")), "p"), r6(A.logit(0.5 + F.col("awr") / 100), "l"))


@query(
    ", p AS (SELECT dataset, vec_id, list_transform(s, lambda x: exp(x) / list_sum(list_transform(s, lambda y: exp(y)))) AS p FROM sl) "
    "SELECT dataset, vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 6) AS entropy FROM p",
    SQL_WAVES,
)
def softmax_entropy(s, sf):
    w = B.waves(s, sf).select("dataset", "vec_id", A.softmax(A.phase_slice(F.col("wave"), 64)).alias("p"))
    return w.select("dataset", "vec_id", r6(A.entropy(F.col("p")), "entropy"))


@query("SELECT dataset, window_index, round(awr, 6) AS mean_z, round(0.5 * z_x_mean + 0.3 * z_x_rms + 0.2 * z_x_p2p, 6) AS weighted FROM sc")
def mean_z_score(s, sf):
    return B.scores(s, sf).select("dataset", "window_index", r6("awr", "mean_z"), r6(A.weighted({"z_x_mean": 0.5, "z_x_rms": 0.3, "z_x_p2p": 0.2}), "weighted"))


@query(
    ", c AS (SELECT dataset, window_index, 'm' AS n, 0.5 * z_x_mean AS v FROM sc UNION ALL SELECT dataset, window_index, 'r', 0.3 * z_x_rms FROM sc UNION ALL SELECT dataset, window_index, 'p', -0.2 * z_x_p2p FROM sc), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY dataset, window_index ORDER BY abs(v) DESC, n) AS i FROM c) SELECT dataset, window_index, string_agg(n, ';' ORDER BY i) AS top FROM k WHERE i <= 2 GROUP BY ALL"
)
def top_contributions(s, sf):
    c = {"m": 0.5 * F.col("z_x_mean"), "r": 0.3 * F.col("z_x_rms"), "p": -0.2 * F.col("z_x_p2p")}
    return B.scores(s, sf).select("dataset", "window_index", A.top_contributions(c, 2).alias("top"))


@query("SELECT dataset, window_index, CASE stage WHEN 1 THEN 0.0 WHEN 2 THEN 0.15 WHEN 3 THEN 0.4 WHEN 4 THEN 0.7 ELSE 1.0 END::DOUBLE AS soft, CASE stage WHEN 4 THEN 2.0 WHEN 5 THEN 4.0 ELSE 1.0 END::DOUBLE AS weight FROM sc")
def soft_labels(s, sf):
    return B.scores(s, sf).select("dataset", "window_index", A.mapped(F.col("stage"), A.SOFT_LABELS).alias("soft"), A.mapped(F.col("stage"), A.SOFT_WEIGHTS).alias("weight"))


THRESHOLDS = ", th AS (SELECT dataset, quantile_cont(awr, 0.95) AS ta, quantile_cont(bd, 0.95) AS tb FROM sc WHERE baseline_window = 1 GROUP BY 1)"


def thresholds(sc: DataFrame) -> DataFrame:
    return sc.where("baseline_window = 1").groupBy("dataset").agg(M.med("awr", 0.95).alias("ta"), M.med("bd", 0.95).alias("tb"))


def regions(s, sf) -> DataFrame:
    sc = B.scores(s, sf)
    return sc.join(thresholds(sc), "dataset").withColumn("region", A.state_region(F.col("awr"), F.col("bd"), F.col("ta"), F.col("tb")))


REGION = THRESHOLDS + (
    ", rg AS (SELECT sc.*, CASE WHEN awr >= ta AND bd >= tb THEN 'high_high' WHEN awr >= ta THEN 'high_score' WHEN bd >= tb THEN 'high_distance' ELSE 'stable' END AS region, awr >= ta AND bd >= tb AS high_pair, awr >= ta AS high FROM sc JOIN th USING (dataset))"
)


@query(REGION + " SELECT dataset, window_index, region FROM rg")
def region_map(s, sf):
    return regions(s, sf).select("dataset", "window_index", "region")


@query("SELECT dataset, feature_name, count(*) FILTER (value IS NULL) AS missing, round(avg(CASE WHEN z_value <= -11.9 THEN 1.0 ELSE 0.0 END), 6) AS low_rate, round(avg(CASE WHEN z_value >= 11.9 THEN 1.0 ELSE 0.0 END), 6) AS high_rate FROM z GROUP BY ALL")
def saturation(s, sf):
    return M.saturation(B.z_long(s, sf)).select("dataset", "feature_name", F.round("missing_rate").cast("long").alias("missing"), r6("low_rate"), r6("high_rate"))


# ================================================================== reshapes, filters, guards, splits


@query("SELECT dataset, window_index, feature_name, round(value, 6) AS value FROM lo")
def unpivot_long(s, sf):
    return B.long_features(s, sf).select("dataset", "window_index", "feature_name", r6("value"))


@query("SELECT dataset, window_index, round(z_x_mean, 6) AS x_mean, round(z_x_rms, 6) AS x_rms, round(z_x_p2p, 6) AS x_p2p FROM sc")
def pivot_first(s, sf):
    return T.pivot_first(B.z_long(s, sf), ["dataset", "window_index"], B.FEATURES, value="z_value").select("dataset", "window_index", *[r6(f) for f in B.FEATURES])


@query("SELECT dataset, window_index, CASE WHEN start_cycle <= floor(end_cycle / 500) * 500 + 100 THEN 1 ELSE 0 END AS guard FROM wi")
def guard_overlap(s, sf):
    return B.windows(s, sf).select("dataset", "window_index", S.guard_overlap(F.col("start_cycle"), F.col("end_cycle")).alias("guard"))


@query("SELECT dataset, window_index, nearest, crosses, CASE WHEN crosses = 1 OR abs(center_cycle - nearest) <= 50 THEN 1 ELSE 0 END AS guard FROM (SELECT *, CASE WHEN start_cycle < nearest AND end_cycle > nearest THEN 1 ELSE 0 END AS crosses FROM (SELECT *, greatest(500, round_even(center_cycle / 500, 0) * 500)::DOUBLE AS nearest FROM wi))")
def guard_nearest(s, sf):
    near, crosses, guard = S.guard_nearest(F.col("start_cycle"), F.col("center_cycle"), F.col("end_cycle"))
    return B.windows(s, sf).select("dataset", "window_index", near.alias("nearest"), crosses.alias("crosses"), guard.alias("guard"))


@query("SELECT dataset, window_index, CASE WHEN center_cycle - floor(center_cycle / 500) * 500 <= 100 THEN 1 ELSE 0 END AS guard, CASE WHEN center_cycle - floor(center_cycle / 500) * 500 <= 100 AND center_cycle >= 500 THEN 1 ELSE 0 END AS clamped FROM wi")
def guard_center(s, sf):
    c = F.col("center_cycle")
    return B.windows(s, sf).select("dataset", "window_index", S.guard_prior(c).alias("guard"), S.guard_prior(c, clamp=True).alias("clamped"))


@query(f"SELECT dataset, window_index, period, CASE WHEN period <> lag(period) {OV} THEN 1 ELSE 0 END AS restart, CASE WHEN abs(center_cycle - 500 * period) <= 50 THEN 1 ELSE 0 END AS guarded FROM (SELECT *, floor((center_cycle - 1) / 500)::BIGINT AS period FROM wi)")
def restart_mask(s, sf):
    return S.guard_restart(B.windows(s, sf)).select("dataset", "window_index", "period", "restart", "guarded")


@query("SELECT dataset, window_index, CASE WHEN few < 200 THEN CASE WHEN window_index < 100 THEN 1 ELSE 0 END ELSE b END AS reset, greatest(b, CASE WHEN few < 200 AND window_index < 100 THEN 1 ELSE 0 END) AS either FROM (SELECT *, baseline_window AS b, sum(baseline_window) OVER (PARTITION BY dataset) AS few FROM wi)")
def baseline_mask(s, sf):
    w = B.windows(s, sf)
    both = S.baseline_mask(S.baseline_mask(w, least=200).withColumnRenamed("in_baseline", "reset"), least=200, mode="or")
    return both.select("dataset", "window_index", "reset", F.col("in_baseline").alias("either"))


@query("SELECT dataset, window_index, CASE WHEN n < 20 THEN 'none' WHEN rn < c - 20 THEN 'train' WHEN rn >= c + 20 THEN 'validation' ELSE 'none' END AS part FROM (SELECT *, floor(n * 0.7::DOUBLE) AS c FROM (SELECT *, row_number() OVER (PARTITION BY dataset, stage ORDER BY window_index) - 1 AS rn, count(*) OVER (PARTITION BY dataset, stage) AS n FROM wi))")
def stage_split(s, sf):
    return S.stage_split(B.windows(s, sf)).select("dataset", "window_index", "part")


@query("SELECT dataset, window_index, CASE WHEN window_index < floor(n * 0.7::DOUBLE) THEN 'train' WHEN window_index >= floor(n * 0.7::DOUBLE) + 20 THEN 'validation' ELSE 'embargo' END AS part FROM (SELECT *, count(*) OVER (PARTITION BY dataset) AS n FROM wi)")
def chrono_split(s, sf):
    return S.chrono_split(B.windows(s, sf)).select("dataset", "window_index", "part")


@query("SELECT dataset, feature_name, count(DISTINCT round(value, 12)) AS n_unique, round(quantile_cont(value, 0.99) - quantile_cont(value, 0.01), 6) AS span, CASE WHEN count(DISTINCT round(value, 12)) >= 20 AND quantile_cont(value, 0.99) - quantile_cont(value, 0.01) > 1e-6 AND quantile_cont(value, 0.75) - quantile_cont(value, 0.25) > 1e-6 THEN 1 ELSE 0 END AS eligible FROM lo GROUP BY ALL")
def feature_support(s, sf):
    return S.support_filter(B.long_features(s, sf)).select("dataset", "feature_name", "n_unique", r6("span"), "eligible")


@query("SELECT dataset, window_index, round(x_mean, 6) AS x_mean FROM wi")
def label_guard(s, sf):
    return S.forbid_columns(S.drop_labels(B.windows(s, sf))).select("dataset", "window_index", r6("x_mean"))


# ================================================================== windows


@query("SELECT dataset, window_index, start_cycle, end_cycle, center_cycle, stage, baseline_window, round(x_mean, 6) AS x_mean, round(x_rms, 6) AS x_rms, round(x_p2p, 6) AS x_p2p FROM wi")
def count_windows(s, sf):
    return B.windows(s, sf).select(*B.IDS, *[r6(f) for f in B.FEATURES])


@query("SELECT dataset, window_index, feature_name, round(z_value, 6) AS z_value FROM z")
def robust_z(s, sf):
    return B.z_long(s, sf).select("dataset", "window_index", "feature_name", r6("z_value"))


@query(f"SELECT dataset, window_index, round(quantile_cont(awr, 0.5) {W20}, 6) AS med20, round(avg(awr) {W20}, 6) AS mean20 FROM sc")
def rolling_median(s, sf):
    return frame(s, sf, {"med20": R.rolling_median("awr", 20), "mean20": R.rolling_mean("awr", 20)}, 19).select("dataset", "window_index", r6("med20"), r6("mean20"))


@query(f", f AS (SELECT dataset, window_index, list(awr) {W20} AS v FROM sc), m AS (SELECT *, list_aggregate(v, 'median') AS m FROM f), d AS (SELECT *, 1.4826 * list_aggregate(list_transform(v, lambda x: abs(x - m)), 'median') AS mad FROM m) SELECT dataset, window_index, round(CASE WHEN len(v) < 3 THEN 0 WHEN mad < 1e-9 THEN list_stddev_pop(v) ELSE mad END, 6) AS mad20 FROM d")
def rolling_mad(s, sf):
    return frame(s, sf, {"mad20": R.rolling_mad("awr", 20)}, 19).select("dataset", "window_index", r6("mad20"))


RS = "SELECT dataset, window_index, CASE WHEN count(*) OVER (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) = 40 THEN (quantile_cont(awr, 0.5) OVER (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - quantile_cont(awr, 0.5) OVER (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING)) / 20 END AS rs, z_x_mean, z_x_rms, z_x_p2p, center_cycle FROM sc"


@query(f", t AS ({RS}) SELECT dataset, window_index, round(rs, 6) AS rs20, round(coalesce(rs, 0), 6) AS rate40 FROM t")
def rs_trend(s, sf):
    return frame(s, sf, {"rs20": R.trend("awr", 20), "rate40": R.half_rate("awr", 40)}, 39).select("dataset", "window_index", r6("rs20"), r6("rate40"))


@query(f"SELECT dataset, window_index, round(greatest(0, awr - quantile_cont(awr, 0.5) {W20}), 6) AS jump, round(coalesce(awr - lag(awr, 1) {OV}, 0), 6) AS d1, round(coalesce(awr - lag(awr, 10) {OV}, 0), 6) AS d10 FROM sc")
def jump_and_diffs(s, sf):
    return frame(s, sf, {"jump": R.jump("awr", 20), "d1": R.difference("awr", 1), "d10": R.difference("awr", 10)}, 19).select("dataset", "window_index", r6("jump"), r6("d1"), r6("d10"))


@query(f"SELECT dataset, window_index, round(regr_slope(awr, window_index + 1) OVER (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) AS slope50 FROM sc")
def regr_slope(s, sf):
    return frame(s, sf, {"slope50": R.slope("awr", "_at", 50)}, 49).select("dataset", "window_index", r6("slope50"))


TES = (
    f", f AS (SELECT dataset, window_index, baseline_window, list(awr) {W20} AS v, greatest(0, bd - quantile_cont(bd, 0.5) {W20}) AS bj, greatest(0, z_x_p2p - quantile_cont(z_x_p2p, 0.5) {W20}) AS sj FROM sc), "
    "m AS (SELECT *, list_aggregate(v, 'median') AS md FROM f), d AS (SELECT *, 1.4826 * list_aggregate(list_transform(v, lambda x: abs(x - md)), 'median') AS mad FROM m), "
    "q AS (SELECT dataset, window_index, baseline_window, CASE WHEN len(v) < 3 THEN 0 WHEN mad < 1e-9 THEN list_stddev_pop(v) ELSE mad END AS vol, bj, sj FROM d), "
    "b AS (SELECT dataset, median(vol) AS v0, quantile_cont(vol, 0.75) - quantile_cont(vol, 0.25) + 1e-6 AS v1, median(bj) AS b0, quantile_cont(bj, 0.75) - quantile_cont(bj, 0.25) + 1e-6 AS b1, median(sj) AS s0, quantile_cont(sj, 0.75) - quantile_cont(sj, 0.25) + 1e-6 AS s1 FROM q WHERE baseline_window = 1 GROUP BY 1), "
    "te AS (SELECT dataset, window_index, 0.4 * greatest(0, (vol - v0) / v1) + 0.4 * greatest(0, (bj - b0) / b1) + 0.2 * greatest(0, (sj - s0) / s1) AS tes FROM q JOIN b USING (dataset))"
)


def tes_frame(s, sf) -> DataFrame:
    q = frame(s, sf, {"vol": R.rolling_mad("awr", 20), "bj": R.jump("bd", 20), "sj": R.jump("z_x_p2p", 20)}, 19)
    iqr = lambda c: M.med(c, 0.75) - M.med(c, 0.25) + 1e-6
    b = q.where("baseline_window = 1").groupBy("dataset").agg(*[x for c in ("vol", "bj", "sj") for x in (M.med(c).alias(f"{c}0"), iqr(c).alias(f"{c}1"))])
    plus = lambda c: A.positive((F.col(c) - F.col(f"{c}0")) / F.col(f"{c}1"))
    return q.join(b, "dataset").withColumn("tes", 0.4 * plus("vol") + 0.4 * plus("bj") + 0.2 * plus("sj"))


@query(TES + " SELECT dataset, window_index, round(tes, 5) AS tes FROM te")
def tes(s, sf):
    return tes_frame(s, sf).select("dataset", "window_index", F.round("tes", 5).alias("tes"))


@query(REGION + f", g AS (SELECT *, sum(CASE WHEN high THEN 0 ELSE 1 END) OVER (PARTITION BY dataset ORDER BY window_index) AS island FROM rg) SELECT dataset, window_index, CASE WHEN high THEN sum(CASE WHEN high THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, island ORDER BY window_index) ELSE 0 END::BIGINT AS run FROM g")
def run_flag(s, sf):
    return R.runs(regions(s, sf).withColumn("high", F.col("awr") >= F.col("ta")), "high").select("dataset", "window_index", "run")


@query(REGION + f", g AS (SELECT *, coalesce(lag(high) {OV}, false) AS b FROM rg) SELECT dataset, count(*) FILTER (high AND NOT b) AS episodes FROM g GROUP BY 1")
def episodes(s, sf):
    return R.episodes(regions(s, sf).withColumn("high", F.col("awr") >= F.col("ta")), "high")


@query(", r AS (SELECT dataset, window_index, rank() OVER (PARTITION BY dataset ORDER BY awr) + (count(*) OVER (PARTITION BY dataset, awr) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY dataset) AS n FROM sc) SELECT dataset, window_index, round(100.0 * r / n, 6) AS pct FROM r")
def pct_rank(s, sf):
    return R.pct_rank(B.scores(s, sf).select("dataset", "window_index", "awr"), "awr").select("dataset", "window_index", r6("pct"))


VEL = (
    ", v AS (SELECT dataset, window_index, " + ", ".join(
        f"CASE WHEN count(*) OVER (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN quantile_cont({c}, 0.5) OVER (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) - quantile_cont({c}, 0.5) OVER (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) ELSE 0 END AS v{i}"
        for i, c in enumerate(("z_x_mean", "z_x_rms", "z_x_p2p"))
    ) + " FROM sc)"
)


@query(VEL + " SELECT dataset, window_index, round(sqrt(v0 * v0 + v1 * v1 + v2 * v2), 6) AS speed FROM v")
def velocity(s, sf):
    z = [f"z_{f}" for f in B.FEATURES]
    v = frame(s, sf, {f"v_{c}": R.half_difference(c, 20) for c in z}, 19)
    return v.select("dataset", "window_index", r6(A.norm(F.array(*[f"v_{c}" for c in z])), "speed"))


@query(f", f AS (SELECT dataset, window_index, list(z_x_mean) {W20} AS a, list(z_x_rms) {W20} AS b, list(z_x_p2p) {W20} AS c FROM sc), m AS (SELECT *, list_aggregate(a, 'median') AS ma, list_aggregate(b, 'median') AS mb, list_aggregate(c, 'median') AS mc FROM f), r AS (SELECT dataset, window_index, list_transform(generate_series(1, len(a)), lambda i: sqrt((a[i] - ma) ** 2 + (b[i] - mb) ** 2 + (c[i] - mc) ** 2)) AS r FROM m), d AS (SELECT *, list_aggregate(r, 'median') AS mr FROM r) SELECT dataset, window_index, round(list_aggregate(list_transform(r, lambda x: abs(x - mr)), 'median'), 6) AS volatility FROM d")
def volatility(s, sf):
    z = [f"z_{f}" for f in B.FEATURES]
    f = frame(s, sf, {f"l_{c}": R.frame_list(c, 20) for c in z}, 19)
    f = f.withColumns({f"m_{c}": A.median(F.col(f"l_{c}")) for c in z})
    square = lambda c: F.transform(f"l_{c}", lambda x: (x - F.col(f"m_{c}")) * (x - F.col(f"m_{c}")))
    total = F.zip_with(F.zip_with(square(z[0]), square(z[1]), lambda a, b: a + b), square(z[2]), lambda a, b: F.sqrt(a + b))
    return f.withColumn("_r", total).select("dataset", "window_index", r6(A.mad(F.col("_r"), 1.0), "volatility"))


@query("SELECT dataset, window_index, round(awr, 6) AS e, round(0.5 * (awr - coalesce(quantile_cont(awr, 0.5) OVER (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), awr)), 6) AS s, round(0.25 * (awr - coalesce(quantile_cont(awr, 0.5) OVER (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING), awr)), 6) AS l FROM sc")
def trajectory(s, sf):
    t = frame(s, sf, {"t": R.trajectory(["awr"])}, 100)
    return t.select("dataset", "window_index", *[r6(F.element_at("t", i + 1), n) for i, n in enumerate("esl")])


@query(f", f AS (SELECT dataset, window_index, list(awr) {W20} AS v FROM sc) SELECT dataset, window_index, 20 AS n, round(v[1], 6) AS first, round(v[len(v)], 6) AS last, 20 - len(v) AS padded FROM f")
def seq_windows(s, sf):
    t = frame(s, sf, {"t": R.padded_sequence(["awr"]), "_n": lambda w: F.count(F.lit(1)).over(R.back(w, 20))}, 19)
    at = lambda i: F.element_at(F.element_at("t", i), 1)
    return t.select("dataset", "window_index", F.size("t").alias("n"), r6(at(1), "first"), r6(at(-1), "last"), (20 - F.col("_n")).alias("padded"))


@query(f"SELECT dataset, window_index, CASE WHEN count(*) {W20} = 20 THEN round(avg(awr) {W20}, 6) END AS mean, CASE WHEN count(*) {W20} = 20 THEN round(stddev_pop(awr) {W20}, 6) END AS std, CASE WHEN count(*) {W20} = 20 THEN round(awr - first_value(awr) {W20}, 6) END AS delta FROM sc")
def history_vector(s, sf):
    t = frame(s, sf, {"h": R.history(["awr"])}, 19)
    return t.select("dataset", "window_index", *[r6(F.get("h", i), n) for i, n in ((1, "mean"), (2, "std"), (3, "delta"))])


@query("SELECT dataset, window_index, round(sum(awr) OVER (PARTITION BY dataset ORDER BY window_index), 4) AS regret, round(avg(abs(awr)) OVER (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS mae100 FROM sc")
def regret_and_mae(s, sf):
    r = S.running_sum(B.scores(s, sf), ["dataset"], "_at", "awr", "regret").withColumn("_e", F.abs("awr"))
    return frame(s, sf, {"mae100": R.rolling_mean("_e", 100)}, 99, r).select("dataset", "window_index", F.round("regret", 4).alias("regret"), r6("mae100"))


@query(", g AS (SELECT dataset, window_index, center_cycle - lag(center_cycle) OVER (PARTITION BY dataset ORDER BY window_index) AS d FROM wi) SELECT dataset, median(d)::DOUBLE AS stride FROM g WHERE d > 0 GROUP BY 1")
def nominal_stride(s, sf):
    d = frame(s, sf, {"d": R.difference("center_cycle", 1)}, 1, B.windows(s, sf).withColumn("_at", F.col("window_index") + 1))
    return d.where("d > 0").groupBy("dataset").agg(M.med("d").alias("stride"))


@query(
    ", p AS (SELECT dataset, window_index, 1 / (1 + exp(-greatest(-35, least(35, awr)))) AS p FROM sc), w AS ("
    "SELECT dataset, CAST(-1 AS BIGINT) AS window_index, CAST(0 AS DOUBLE) AS v FROM (SELECT DISTINCT dataset FROM p) UNION ALL "
    "SELECT p.dataset, p.window_index, w.v + CASE WHEN p.p > w.v THEN 0.15 ELSE 0.02 END * (p.p - w.v) FROM w JOIN p ON p.dataset = w.dataset AND p.window_index = w.window_index + 1) "
    "SELECT dataset, window_index, round(v, 6) AS slow_risk FROM w WHERE window_index >= 0",
    RECURSIVE,
)
def slow_risk(s, sf):
    rows = B.scores(s, sf).select("dataset", "window_index", A.sigmoid(F.col("awr")).alias("p"))
    got = H.backfill(rows, ["dataset"], "window_index", X.SlowRisk, "dataset string, window_index long, slow_risk double", ["slow_risk"])
    return got.select("dataset", "window_index", r6("slow_risk"))


# ================================================================== aggregates and evaluation


@query(THRESHOLDS + " SELECT dataset, round(ta, 6) AS awr_p95, round(tb, 6) AS bd_p95 FROM th")
def threshold_p95(s, sf):
    return thresholds(B.scores(s, sf)).select("dataset", r6("ta", "awr_p95"), r6("tb", "bd_p95"))


@query(", a AS (SELECT dataset, feature_name, median(value) AS m, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM lo GROUP BY ALL), d AS (SELECT lo.dataset, lo.feature_name, median(abs(value - m)) AS mad FROM lo JOIN a USING (dataset, feature_name) GROUP BY ALL) SELECT dataset, feature_name, round(m, 6) AS median, round(iqr, 6) AS iqr, round(mad, 6) AS mad, round(greatest(1.4826 * mad, iqr / 1.349, 1e-9), 6) AS scale FROM a JOIN d USING (dataset, feature_name)")
def robust_stats(s, sf):
    return M.robust_stats(B.long_features(s, sf), ["dataset", "feature_name"], "value").select("dataset", "feature_name", *[r6(c) for c in ("median", "iqr", "mad", "scale")])


LATE = ", la AS (SELECT *, CASE WHEN stage = 5 THEN 1 ELSE 0 END AS late, round(awr, 9) AS ra FROM sc)"


def late(s, sf) -> DataFrame:
    return B.scores(s, sf).withColumn("late", (F.col("stage") == 5).cast("int")).withColumn("ra", F.round("awr", 9))


ROC = ", rk AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY ra) + (count(*) OVER (PARTITION BY dataset, ra) - 1) / 2.0 AS r FROM la), au AS (SELECT dataset, sum(late)::BIGINT AS p, (count(*) - sum(late))::BIGINT AS n, sum(r * late) AS s FROM rk GROUP BY 1)"


@query(LATE + ROC + " SELECT dataset, p AS n_pos, n AS n_neg, round((s - p * (p + 1) / 2) / (p * n), 6) AS auroc FROM au")
def auroc(s, sf):
    return M.auroc(late(s, sf), ["dataset"], "ra", "late").select("dataset", "n_pos", "n_neg", r6("auroc"))


@query(LATE + ", o AS (SELECT dataset, late, row_number() OVER (PARTITION BY dataset ORDER BY ra DESC, window_index) AS rn, sum(late) OVER (PARTITION BY dataset ORDER BY ra DESC, window_index ROWS UNBOUNDED PRECEDING) AS tp FROM la) SELECT dataset, round(avg(tp / rn), 6) AS average_precision FROM o WHERE late = 1 GROUP BY 1")
def avg_precision(s, sf):
    return M.average_precision(late(s, sf), ["dataset"], "ra", "late", "window_index").select("dataset", r6("average_precision"))


@query(LATE + ", r AS (SELECT dataset, rank() OVER (PARTITION BY dataset ORDER BY ra) + (count(*) OVER (PARTITION BY dataset, ra) - 1) / 2.0 AS a, rank() OVER (PARTITION BY dataset ORDER BY stage) + (count(*) OVER (PARTITION BY dataset, stage) - 1) / 2.0 AS b FROM la) SELECT dataset, round(corr(a, b), 6) AS spearman FROM r GROUP BY 1")
def spearman(s, sf):
    return M.spearman(late(s, sf).select("dataset", "ra", "stage"), ["dataset"], "ra", "stage").select("dataset", r6("spearman"))


@query(LATE + ROC + ", co AS (SELECT dataset, avg(ra) FILTER (late = 1) AS m1, avg(ra) FILTER (late = 0) AS m0, var_samp(ra) FILTER (late = 1) AS v1, var_samp(ra) FILTER (late = 0) AS v0, count(*) FILTER (late = 1) AS n1, count(*) FILTER (late = 0) AS n0 FROM la GROUP BY 1) SELECT dataset, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS cohen_d, round(2 * (s - p * (p + 1) / 2) / (p * n) - 1, 6) AS cliffs_delta FROM co JOIN au USING (dataset)")
def cliffs_delta(s, sf):
    return M.cliffs_delta(late(s, sf), ["dataset"], "ra", "late").select("dataset", r6("cohen_d"), r6("cliffs_delta"))


@query(", e AS (SELECT dataset, feature_name, median(z_value) FILTER (stage = 1) AS early, median(z_value) FILTER (stage = 5) AS late FROM z GROUP BY ALL) SELECT dataset, feature_name, round(early, 6) AS early, round(late, 6) AS late, CASE WHEN abs(late - early) < 0.05 THEN 0 ELSE coalesce(sign(late - early), 0) END::INTEGER AS direction_sign FROM e")
def direction_sign(s, sf):
    return M.direction_signs(B.z_long(s, sf)).select("dataset", "feature_name", r6("early"), r6("late"), "direction_sign")


@query(LATE + ", q AS (SELECT dataset, 1 / (1 + exp(-greatest(-35, least(35, awr)))) AS p, late FROM la), b AS (SELECT dataset, least(9, floor(p * 10)) AS b, count(*) AS n, abs(avg(p) - avg(late)) AS g, sum((p - late) ** 2) AS sq FROM q GROUP BY ALL) SELECT dataset, round(sum(n * g) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier FROM b GROUP BY 1")
def ece_brier(s, sf):
    return M.calibration(late(s, sf).withColumn("p", A.sigmoid(F.col("awr"))), ["dataset"], "p", "late").select("dataset", r6("ece"), r6("brier"))


GUESS = ", gu AS (SELECT dataset, stage, least(5, greatest(1, floor(awr) + 3))::INTEGER AS g FROM sc)"


@query(GUESS + ", k AS (SELECT dataset, unnest([1, 2, 3, 4, 5]) AS c FROM (SELECT DISTINCT dataset FROM gu)), f AS (SELECT k.dataset, c, CASE WHEN sum(CASE WHEN stage = c THEN 1 ELSE 0 END + CASE WHEN g = c THEN 1 ELSE 0 END) > 0 THEN 2.0 * sum(CASE WHEN stage = c AND g = c THEN 1 ELSE 0 END) / sum(CASE WHEN stage = c THEN 1 ELSE 0 END + CASE WHEN g = c THEN 1 ELSE 0 END) END AS f FROM k JOIN gu USING (dataset) GROUP BY ALL), a AS (SELECT dataset, avg(CASE WHEN stage = g THEN 1.0 ELSE 0.0 END) AS accuracy, avg(abs(stage - g)) AS mae FROM gu GROUP BY 1) SELECT a.dataset, round(accuracy, 6) AS accuracy, round(mae, 6) AS ordinal_mae, round(avg(f), 6) AS macro_f1 FROM a JOIN f USING (dataset) GROUP BY ALL")
def class_metrics(s, sf):
    g = B.scores(s, sf).withColumn("g", F.least(F.lit(5), F.greatest(F.lit(1), F.floor("awr") + 3)).cast("int"))
    return M.class_metrics(g, ["dataset"], "stage", "g").select("dataset", r6("accuracy"), r6("ordinal_mae"), r6("macro_f1"))


@query(REGION + ", sp2 AS (SELECT DISTINCT dataset, stage, unnest(['stable', 'high_score', 'high_distance', 'high_high']) AS region FROM rg), c AS (SELECT dataset, stage, region, count(*) AS n FROM rg GROUP BY ALL) SELECT dataset, stage, region, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY dataset, stage), 6) AS share FROM sp2 LEFT JOIN c USING (dataset, stage, region)")
def occupancy(s, sf):
    return M.occupancy(regions(s, sf), ["stable", "high_score", "high_distance", "high_high"]).select("dataset", "stage", "region", "n", r6("share"))


@query("SELECT dataset, stage, count(*) AS n, round(median(awr), 6) AS awr_median, round(quantile_cont(awr, 0.1), 6) AS awr_p10, round(quantile_cont(awr, 0.9), 6) AS awr_p90, round(median(bd), 6) AS bd_median FROM sc GROUP BY ALL")
def stage_summary(s, sf):
    return B.scores(s, sf).groupBy("dataset", "stage").agg(F.count("*").alias("n"), r6(M.med("awr"), "awr_median"), r6(M.med("awr", 0.1), "awr_p10"), r6(M.med("awr", 0.9), "awr_p90"), r6(M.med("bd"), "bd_median"))


@query(LATE + ", n AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS n FROM la), t AS (SELECT n.*, d FROM n, (SELECT unnest(generate_series(0, 9)) AS d) WHERE window_index >= n * d // 10 AND window_index < n * (d + 1) // 10) SELECT dataset, d::INTEGER AS decile, count(*) AS n, round(median(ra), 6) AS median_score, round(avg(late), 6) AS share FROM t GROUP BY ALL")
def decile_metrics(s, sf):
    return M.deciles(late(s, sf), "ra", "late").select("dataset", "decile", "n", r6("median_score"), r6("share"))


@query(", g AS (SELECT dataset, 3 - (CASE WHEN window_index * 3 < n THEN 2 WHEN window_index * 3 < 2 * n THEN 1 ELSE 0 END) AS seg, awr FROM (SELECT *, count(*) OVER (PARTITION BY dataset) AS n FROM sc)) SELECT dataset, seg::INTEGER AS segment, count(*) AS n, round(avg(abs(awr)), 6) AS mae, round(sqrt(avg(awr * awr)), 6) AS rmse FROM g GROUP BY ALL")
def segment_metrics(s, sf):
    sc = B.scores(s, sf)
    n = sc.groupBy("dataset").agg(F.count("*").alias("_n"))
    third = F.col("window_index") * 3
    seg = sc.join(n, "dataset").withColumn("segment", F.when(third < F.col("_n"), 1).when(third < 2 * F.col("_n"), 2).otherwise(3)).withColumn("zero", F.lit(0.0))
    return M.forecast_metrics(seg, ["dataset", "segment"], "awr", "zero").select("dataset", "segment", "n", r6("mae"), r6("rmse"))


@query(", p AS (SELECT dataset, feature_name, quantile_cont(value, 0.01) AS lo1, quantile_cont(value, 0.99) AS hi1 FROM lo WHERE baseline_window = 1 GROUP BY ALL) SELECT lo.dataset, window_index, round(avg(CASE WHEN value < lo1 OR value > hi1 THEN 1.0 ELSE 0.0 END), 6) AS oos FROM lo JOIN p USING (dataset, feature_name) GROUP BY ALL")
def oos_support(s, sf):
    lo = B.long_features(s, sf)
    p = lo.where("baseline_window = 1").groupBy("dataset", "feature_name").agg(M.med("value", 0.01).alias("a"), M.med("value", 0.99).alias("b"))
    out = (F.col("value") < F.col("a")) | (F.col("value") > F.col("b"))
    return lo.join(p, ["dataset", "feature_name"]).groupBy("dataset", "window_index").agg(r6(F.avg(out.cast("double")), "oos"))


@query("SELECT dataset, split_part(feature_name, '_', 1) AS channel, split_part(feature_name, '_', 2) AS family, round(sum(abs(z_value)), 4) AS total FROM z GROUP BY ALL")
def contrib_rollup(s, sf):
    meta = T.feature_metadata(B.FEATURES, s)
    return B.z_long(s, sf).join(meta, "feature_name").groupBy("dataset", "channel", F.col("feature_family").alias("family")).agg(F.round(F.sum(F.abs("z_value")), 4).alias("total"))


# ================================================================== events and joins

EVENTS = TES + ", ev2 AS (SELECT te.dataset, te.window_index, tes, center_cycle FROM te JOIN sc USING (dataset, window_index) WHERE tes >= 3)"


def tes_events(s, sf) -> DataFrame:
    return tes_frame(s, sf).where("round(tes, 5) >= 3").select("dataset", "window_index", "center_cycle", "tes")


def bounds(s, sf) -> DataFrame:
    """Where the stages of each stream begin."""
    return B.scores(s, sf).where("stage >= 2").groupBy("dataset", "stage").agg(F.min("center_cycle").alias("boundary_cycle")).select("dataset", "boundary_cycle")


NEAR = (
    ", bo AS (SELECT dataset, min(center_cycle) AS b FROM sc WHERE stage >= 2 GROUP BY dataset, stage), "
    "ne AS (SELECT ev2.dataset, window_index, min_by(b, abs(center_cycle - b) * 10000000 + b / 1000) AS boundary_cycle, min(abs(center_cycle - b)) AS distance FROM ev2 JOIN bo USING (dataset) GROUP BY ALL)"
)


@query(EVENTS.replace("tes >= 3", "round(tes, 5) >= 3") + NEAR + " SELECT dataset, window_index, boundary_cycle, distance, distance <= 500 AS matched FROM ne")
def nearest_boundary(s, sf):
    return J.nearest_boundary(tes_events(s, sf), bounds(s, sf)).select("dataset", "window_index", "boundary_cycle", "distance", "matched")


@query(EVENTS.replace("tes >= 3", "round(tes, 5) >= 3") + NEAR + ", g AS (SELECT dataset, count(*) AS n_events, count(*) FILTER (distance <= 100) AS n_matched, median(distance) AS median_distance FROM ne GROUP BY 1) SELECT * FROM g UNION ALL SELECT 'ALL', sum(n_events)::BIGINT, sum(n_matched)::BIGINT, median(median_distance) FROM g")
def event_eval_all(s, sf):
    near = J.nearest_boundary(tes_events(s, sf), bounds(s, sf), 100)
    g = near.groupBy("dataset").agg(F.count("*").alias("n_events"), F.sum(F.col("matched").cast("long")).alias("n_matched"), M.med("distance").alias("median_distance"))
    total = g.agg(F.lit("ALL").alias("dataset"), F.sum("n_events").alias("n_events"), F.sum("n_matched").alias("n_matched"), M.med("median_distance").alias("median_distance"))
    return T.union_all([g, total])


#: Segments of a stream that ends at cycle 1, as (number, from, to, mapped from, mapped to). One has a gap before it.
SEGMENTS = [(1, 0.0, 0.25, 0.0, 0.35), (2, 0.25, 0.5, 0.35, 0.45), (3, 0.6, 0.9, 0.5, 1.1)]


@query(
    ", en AS (SELECT dataset, max(end_cycle) AS e FROM wi GROUP BY 1), se AS (SELECT dataset, seg, lo * e AS lo, hi * e AS hi, a * e AS a, b * e AS b FROM en, (VALUES (1, 0.0, 0.25, 0.0, 0.35), (2, 0.25, 0.5, 0.35, 0.45), (3, 0.6, 0.9, 0.5, 1.1)) t(seg, lo, hi, a, b)), "
    "p AS (SELECT wi.dataset, window_index, center_cycle, coalesce(min(seg) FILTER (center_cycle BETWEEN lo AND hi), 3) AS seg FROM wi JOIN se USING (dataset) GROUP BY wi.dataset, window_index, center_cycle) "
    "SELECT dataset, window_index, seg::INTEGER AS seg, round(a + (center_cycle - lo) * (b - a) / (hi - lo), 6) AS mapped FROM p JOIN se USING (dataset, seg)"
)
def cycle_map(s, sf):
    """Piecewise-linear maps of each stream, in shares of its length."""
    w = B.windows(s, sf)
    ends = w.groupBy("dataset").agg(F.max("end_cycle").alias("_e"))
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), *[(F.lit(v) * F.col("_e")).alias(n) for n, v in zip(("lo", "hi", "out_lo", "out_hi"), r, strict=True)]) for k, *r in SEGMENTS]))
    return J.interval_map(w, ends.select("dataset", parts.alias("_p")).select("dataset", "_p.*")).select("dataset", "window_index", "seg", r6("mapped"))


@query(", j AS (SELECT a.dataset, a.window_index, min(b.window_index) AS due_index FROM wi a LEFT JOIN wi b ON a.dataset = b.dataset AND b.center_cycle >= a.center_cycle + 100 GROUP BY ALL) SELECT j.dataset, j.window_index, due_index, round(x_mean, 6) AS due_value FROM j LEFT JOIN wi w ON w.dataset = j.dataset AND w.window_index = due_index")
def asof_due(s, sf):
    return J.forward_asof(B.windows(s, sf), 100, "x_mean").select("dataset", "window_index", "due_index", r6("due_value"))


@query(", c AS (SELECT a.dataset, CASE WHEN round(b.awr, 9) > round(a.awr, 9) THEN 1.0 WHEN round(b.awr, 9) = round(a.awr, 9) THEN 0.5 ELSE 0.0 END AS c FROM sc a JOIN sc b ON a.dataset = b.dataset AND b.window_index = a.window_index + 100) SELECT dataset, count(*) AS n, round(avg(c), 6) AS concordance FROM c GROUP BY 1")
def pair_concordance(s, sf):
    got = J.fixed_gap_pairs(late(s, sf).select("dataset", "window_index", "ra"), 100, "ra")
    return got.groupBy("dataset").agg(F.count("*").alias("n"), r6(F.avg("concordant"), "concordance"))


#: Gap bins of sampled pairs in cycles, and the pairs of each.
PAIR_BINS, PAIRS_PER_BIN, PAIR_SEED = [(100, 500), (500, 1000), (1000, None)], 200, 11
PAIR_SQL = (
    ", gp AS (SELECT dataset, window_index AS w FROM sc WHERE NOT start_cycle <= floor(end_cycle / 500) * 500 + 100), "
    "bn AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {low}, {high or 10**12}, 'gap_{low}_{high or 'plus'}')" for i, (low, high) in enumerate(PAIR_BINS)) + ") t(bin, lo, hi, gap_bin)), "
    "pn AS (SELECT a.dataset, bin, gap_bin, a.w AS earlier, b.w AS later, row_number() OVER (PARTITION BY a.dataset, bin ORDER BY a.w, b.w) - 1 AS number, count(*) OVER (PARTITION BY a.dataset, bin) AS t FROM gp a JOIN gp b ON a.dataset = b.dataset AND b.w > a.w JOIN bn ON (b.w - a.w) * 5 >= lo AND (b.w - a.w) * 5 < hi), "
    f"dk AS (SELECT *, unnest(range(m)) AS k FROM (SELECT DISTINCT dataset, bin, t, least(t, {PAIRS_PER_BIN}) AS m FROM pn)), "
    f"dn AS (SELECT dataset, bin, k * t // m + CAST(floor({J.draw_hash_sql('k', 'bin', PAIR_SEED)} / {J.DRAW_PRIME}.0::DOUBLE * ((k + 1) * t // m - k * t // m)) AS BIGINT) AS number FROM dk), "
    "sm AS (SELECT dataset, gap_bin, earlier, later, (later - earlier) * 5.0::DOUBLE AS gap FROM pn JOIN dn USING (dataset, bin, number))"
)


def drawn_pairs(s, sf) -> DataFrame:
    """dataset, gap_bin, earlier, later, gap of sampled pairs of unguarded windows."""
    scratch = Scratch(s, "pairs")
    rows = B.scores(s, sf).select("dataset", "window_index", S.guard_overlap(F.col("start_cycle"), F.col("end_cycle")).alias("guard"))
    names = F.array(*[F.lit(f"gap_{low}_{high or 'plus'}") for low, high in PAIR_BINS])
    got = J.sampled_pairs(rows, PAIR_BINS, PAIRS_PER_BIN, scratch, seed=PAIR_SEED)
    return scratch.last(got.select("dataset", F.get(names, F.col("bin").cast("int")).alias("gap_bin"), "earlier", "later", "gap"))


@query(PAIR_SQL + " SELECT * FROM sm")
def temporal_pairs(s, sf):
    """Pairs of unguarded windows, drawn in three gap bins from the counted pairs of each stream."""
    return drawn_pairs(s, sf)


@query(
    PAIR_SQL + ", de AS (SELECT sm.dataset, gap_bin, round(b.awr, 9) - round(a.awr, 9) AS d FROM sm JOIN sc a ON a.dataset = sm.dataset AND a.window_index = earlier JOIN sc b ON b.dataset = sm.dataset AND b.window_index = later) "
    "SELECT dataset, gap_bin, count(*) AS pairs, round(avg(CASE WHEN d > 0 THEN 1.0 WHEN d = 0 THEN 0.5 ELSE 0.0 END), 6) AS concordance FROM de GROUP BY ALL"
)
def sampled_concordance(s, sf):
    """How often the later window of a sampled pair scores higher, by gap bin: the mirrored pairs are the same counts."""
    sc = B.scores(s, sf).select("dataset", "window_index", F.round("awr", 9).alias("a"))
    ends = drawn_pairs(s, sf).join(sc.toDF("dataset", "earlier", "_a"), ["dataset", "earlier"]).join(sc.toDF("dataset", "later", "_b"), ["dataset", "later"])
    d = F.col("_b") - F.col("_a")
    return ends.groupBy("dataset", "gap_bin").agg(F.count("*").alias("pairs"), r6(F.avg(F.when(d > 0, 1.0).when(d == 0, 0.5).otherwise(0.0)), "concordance"))


@query(EVENTS.replace("tes >= 3", "round(tes, 5) >= 3") + " SELECT DISTINCT sc.dataset, sc.window_index FROM sc JOIN ev2 ON sc.dataset = ev2.dataset AND abs(sc.window_index - ev2.window_index) <= 2")
def peak_neighbourhood(s, sf):
    return J.neighbourhood(B.scores(s, sf), tes_events(s, sf)).select("dataset", "window_index")


@query(
    ", nn AS (SELECT dataset, count(*) AS n FROM sc GROUP BY 1), sp3 AS (SELECT dataset, k AS span_id, k * n // 8 AS a, k * n // 8 + n // 5 AS b FROM nn, (SELECT unnest(generate_series(0, 6)) AS k)) SELECT span_id, sc.dataset, count(*) AS n, "
    + ", ".join(f"round(avg(CASE WHEN stage = {k} THEN 1.0 ELSE 0.0 END), 6) AS stage{k}" for k in range(1, 6))
    + " FROM sc JOIN sp3 ON sc.dataset = sp3.dataset AND window_index BETWEEN a AND b GROUP BY ALL"
)
def interval_fractions(s, sf):
    """Stage shares inside seven overlapping spans of each stream."""
    sc = B.scores(s, sf)
    n = sc.groupBy("dataset").agg(F.count("*").alias("_n")).withColumn("span_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    start = F.floor(F.col("span_id") * F.col("_n") / 8)
    spans = n.select("span_id", "dataset", start.alias("start_window"), (start + F.floor(F.col("_n") / 5)).alias("end_window"))
    return J.interval_fractions(sc, spans).select("span_id", "dataset", "n", *[r6(f"stage{k}") for k in range(1, 6)])


@query(", nn AS (SELECT dataset, count(*) AS n FROM sc GROUP BY 1) SELECT count(*) AS n, 0.0::DOUBLE AS awr FROM sc JOIN nn USING (dataset) WHERE window_index < floor(n * 0.6)")
def prefix_causality(s, sf):
    """Scores of the first 60 % of each stream do not change when later rows are cut off: the largest difference must be 0."""
    sc = B.scores(s, sf)
    n = sc.groupBy("dataset").agg(F.count("*").alias("_n"))
    full = frame(s, sf, {"m": R.rolling_median("awr", 20)}, 19)
    short = frame(s, sf, {"m": R.rolling_median("awr", 20)}, 19, sc.join(n, "dataset").where(F.col("window_index") < F.floor(F.col("_n") * 0.6)).drop("_n"))
    return J.max_difference(full, short, ["dataset", "window_index"], ["m"]).select("n", F.col("m").alias("awr"))


# ================================================================== top-k, peaks, fits


@query(
    ", o AS (SELECT dataset, window_index, center_cycle, round(awr, 9) AS score FROM sc), r AS ("
    "SELECT dataset, CAST(0 AS INTEGER) AS pick, CAST(NULL AS BIGINT) AS window_index, CAST(NULL AS DOUBLE) AS score, CAST([] AS DOUBLE[]) AS taken FROM (SELECT DISTINCT dataset FROM o) UNION ALL "
    "SELECT dataset, pick + 1, b.window_index, b.score, list_append(taken, b.center_cycle) FROM ("
    "SELECT r.dataset, r.pick, r.taken, max_by({'window_index': o.window_index, 'score': o.score, 'center_cycle': o.center_cycle}, {'s': o.score, 'w': -o.window_index}) AS b FROM r JOIN o ON o.dataset = r.dataset "
    "WHERE r.pick < 20 AND len(list_filter(r.taken, lambda x: abs(x - o.center_cycle) < 500)) = 0 GROUP BY r.dataset, r.pick, r.taken)) "
    "SELECT dataset, pick, window_index, round(score, 6) AS score FROM r WHERE pick > 0",
    RECURSIVE,
)
def topk_spaced(s, sf):
    rows = B.scores(s, sf).withColumn("score", F.round("awr", 9))
    return K.spaced_top(rows, "score", 20, 500.0).select("dataset", "pick", "window_index", r6("score"))


@query(f", l AS (SELECT dataset, window_index, awr, lag(awr) {OV} AS a, lead(awr) {OV} AS b FROM sc) SELECT dataset, window_index, round(awr, 6) AS height FROM l WHERE awr > a AND awr > b AND awr >= 0.5")
def local_peaks(s, sf):
    return K.local_peaks(B.scores(s, sf), "awr", 0.5).select("dataset", "window_index", r6("height"))


@query(
    ", o AS (SELECT dataset, window_index, center_cycle, round(awr, 9) AS score FROM sc), r AS ("
    "SELECT dataset, 0 AS pick, CAST(NULL AS BIGINT) AS window_index, CAST([] AS DOUBLE[]) AS taken FROM (SELECT DISTINCT dataset FROM o) UNION ALL "
    "SELECT dataset, pick + 1, b.window_index, list_append(taken, b.center_cycle) FROM ("
    "SELECT r.dataset, r.pick, r.taken, max_by({'window_index': o.window_index, 'center_cycle': o.center_cycle}, {'s': o.score, 'w': -o.window_index}) AS b FROM r JOIN o ON o.dataset = r.dataset "
    "WHERE r.pick < 12 AND len(list_filter(r.taken, lambda x: abs(x - o.center_cycle) < 2500)) = 0 GROUP BY r.dataset, r.pick, r.taken)), "
    "p AS (SELECT * FROM r WHERE pick > 0), c AS (SELECT dataset, count(*) AS n FROM o GROUP BY 1), d AS (SELECT c.dataset, count(p.pick) AS got, count(p.pick) < least(10, any_value(n)) AS relaxed FROM c LEFT JOIN p ON p.dataset = c.dataset GROUP BY c.dataset), "
    "f AS (SELECT o.dataset, o.window_index, row_number() OVER (PARTITION BY o.dataset ORDER BY o.score DESC, o.window_index) AS i FROM o ANTI JOIN p ON p.dataset = o.dataset AND p.window_index = o.window_index) "
    "SELECT p.dataset, CAST(pick AS INTEGER) AS pick, window_index, CAST(relaxed AS INTEGER) AS relaxed FROM p JOIN d USING (dataset) UNION ALL "
    "SELECT dataset, CAST(got + i AS INTEGER), window_index, 1 FROM f JOIN d USING (dataset) WHERE relaxed AND got + i <= 12",
    RECURSIVE,
)
def topk_relaxed(s, sf):
    """Twelve rows of each stream at least 2500 cycles apart, filled up with its best others where that gives under ten."""
    rows = B.scores(s, sf).withColumn("score", F.round("awr", 9))
    return K.spaced_top(rows, "score", 12, 2500.0, least=10).select("dataset", "pick", "window_index", "relaxed")


@query(
    ", o AS (SELECT dataset, window_index AS w, round(awr, 9) AS x FROM sc), g AS (SELECT *, sum(n) OVER (PARTITION BY dataset ORDER BY w) AS r FROM (SELECT *, CASE WHEN x IS DISTINCT FROM lag(x) OVER (PARTITION BY dataset ORDER BY w) THEN 1 ELSE 0 END AS n FROM o)), "
    "q AS (SELECT *, lag(x) OVER k AS x0, lead(x) OVER k AS x2 FROM (SELECT dataset, r, (min(w) + max(w)) // 2 AS w, any_value(x) AS x FROM g GROUP BY dataset, r) WINDOW k AS (PARTITION BY dataset ORDER BY r)), "
    "h AS (SELECT dataset, w, x FROM q WHERE x > x0 AND x > x2 AND x >= 0.5), r AS ("
    "SELECT dataset, 0 AS i, CAST(NULL AS BIGINT) AS w, CAST([] AS BIGINT[]) AS taken FROM (SELECT DISTINCT dataset FROM h) UNION ALL "
    "SELECT dataset, i + 1, b, list_append(taken, b) FROM (SELECT r.dataset, r.i, r.taken, max_by(h.w, {'x': h.x, 'w': h.w}) AS b FROM r JOIN h ON h.dataset = r.dataset WHERE len(list_filter(r.taken, lambda t: abs(t - h.w) < 20)) = 0 GROUP BY r.dataset, r.i, r.taken)), "
    "k AS (SELECT h.* FROM h JOIN r USING (dataset, w)), "
    "e AS (SELECT k.dataset, k.w, k.x, coalesce((SELECT max(o.w) FROM o WHERE o.dataset = k.dataset AND o.w < k.w AND o.x > k.x), -1) AS a, coalesce((SELECT min(o.w) FROM o WHERE o.dataset = k.dataset AND o.w > k.w AND o.x > k.x), 1000000000) AS b FROM k), "
    "m AS (SELECT e.dataset, e.w, e.x, e.x - greatest((SELECT min(o.x) FROM o WHERE o.dataset = e.dataset AND o.w > e.a AND o.w <= e.w), (SELECT min(o.x) FROM o WHERE o.dataset = e.dataset AND o.w >= e.w AND o.w < e.b)) AS p FROM e) "
    "SELECT dataset, w AS window_index, round(x, 6) AS height, round(p, 6) AS prominence FROM m WHERE p >= 0.3",
    RECURSIVE,
)
def peaks(s, sf):
    """Peaks of the score by height, distance and prominence."""
    rows = B.scores(s, sf).withColumn("score", F.round("awr", 9))
    return K.prominent_peaks(rows, "score", 0.5, 20, 0.3).select("dataset", "window_index", r6("height"), r6("prominence"))


@query()
def ridge_normal_eq(s, sf):
    h = frame(s, sf, {"h": R.history(["awr"]), "y": lambda w: F.lag("awr", 20).over(w)}, 39)
    x = h.where("h is not null").select("dataset", *[F.get("h", i).alias(f"h{i}") for i in range(4)], (F.col("awr") - F.col("y")).alias("y"))
    return L.ridge(x, ["dataset"], ["h0", "h1", "h2", "h3"], "y").select("dataset", "term", r6("coefficient"), "n")


@query()
def baseline_distance(s, sf):
    return L.mahalanobis(B.scores(s, sf), [f"z_{f}" for f in B.FEATURES]).select("dataset", "window_index", F.round("distance", 5).alias("distance"))


@query(LATE + ", d AS (SELECT dataset, ra, sum(late) AS p, count(*) AS c FROM la GROUP BY ALL), c AS (SELECT dataset, ra, sum(p) OVER w AS tp, sum(c) OVER w AS n, sum(p) OVER a AS pos, sum(c) OVER a AS al FROM d WINDOW w AS (PARTITION BY dataset ORDER BY ra DESC), a AS (PARTITION BY dataset)), m AS (SELECT dataset, ra AS threshold, tp / pos AS recall, (n - tp) / (al - pos) AS fpr, tp / n AS precision FROM c), o AS (SELECT *, recall >= 0.85 AS ok, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN recall >= 0.85 THEN 0 ELSE 1 END, CASE WHEN recall >= 0.85 THEN fpr ELSE -(0.7 * recall + 0.3 * precision - 0.5 * fpr) END, -recall, -precision, threshold) AS i FROM m) SELECT dataset, round(threshold, 6) AS threshold, round(recall, 6) AS recall, round(fpr, 6) AS fpr, round(precision, 6) AS precision, CASE WHEN ok THEN 1 ELSE 0 END AS feasible FROM o WHERE i = 1")
def threshold_search(s, sf):
    return L.choose_threshold(late(s, sf), ["dataset"], "ra", "late").select("dataset", r6("threshold"), r6("recall"), r6("fpr"), r6("precision"), "feasible")


# ================================================================== state machines


def machine_rows(s, sf) -> DataFrame:
    sc = frame(s, sf, {"v50": R.half_difference("awr", 50), "v100": R.half_difference("awr", 100), "vol": R.rolling_mad("awr", 50)}, 99)
    sc = sc.join(thresholds(sc), "dataset")
    return sc.withColumn("guard", S.guard_overlap(F.col("start_cycle"), F.col("end_cycle")))


@query(
    ", g AS (SELECT dataset, window_index, round(awr, 9) > 0 AS c, start_cycle <= floor(end_cycle / 500) * 500 + 100 AS guard FROM sc), r AS ("
    "SELECT dataset, CAST(-1 AS BIGINT) AS window_index, CAST(0 AS DOUBLE) AS success, CAST(0 AS DOUBLE) AS failure, 'searching' AS phase FROM (SELECT DISTINCT dataset FROM g) UNION ALL "
    "SELECT dataset, window_index, CASE WHEN still THEN success WHEN c THEN success + 5 WHEN failure + 5 >= 150 THEN 0 ELSE success END, "
    "CASE WHEN still THEN failure WHEN c THEN 0 WHEN failure + 5 >= 150 THEN 0 ELSE failure + 5 END, "
    "CASE WHEN still THEN phase WHEN c AND success + 5 >= 500 THEN 'confirmed' WHEN c AND success + 5 >= 300 THEN 'candidate' WHEN NOT c AND failure + 5 >= 150 THEN 'searching' ELSE phase END "
    "FROM (SELECT g.dataset, g.window_index, g.c, r.success, r.failure, r.phase, g.guard OR r.phase = 'confirmed' AS still FROM r JOIN g ON g.dataset = r.dataset AND g.window_index = r.window_index + 1)) "
    "SELECT * FROM r WHERE window_index >= 0",
    RECURSIVE,
)
def evidence_accumulator(s, sf):
    rows = machine_rows(s, sf).withColumn("condition", F.round("awr", 9) > 0).select("dataset", "window_index", "condition", "guard")
    return H.backfill(rows, ["dataset"], "window_index", X.Evidence, "dataset string, window_index long, success double, failure double, phase string", ["success", "failure", "phase"])


#: The plateau may not begin before this cycle; limits are this quantile of the source's rows beyond it.
PLATEAU_CYCLE, PLATEAU_QUANTILE = 600.0, 0.75
ZS = [f"z_{f}" for f in B.FEATURES]


def vector_rows(s, sf) -> DataFrame:
    """Feature vectors r with distance d, velocities over 20, 50 and 100 rows, volatility and guard; no label columns."""
    sc = S.drop_labels(L.mahalanobis(B.scores(s, sf), ZS)).withColumn("guard", S.guard_overlap(F.col("start_cycle"), F.col("end_cycle")))
    wide = R.vector_moves(sc.select("dataset", "window_index", "center_cycle", "baseline_window", "guard", "_at", *ZS, F.col("distance").alias("d")), ["dataset"], "_at", ZS, (20, 50, 100), 50)
    return wide.select("dataset", "window_index", "center_cycle", "baseline_window", "guard", F.array(*ZS).alias("r"), "d", "v20", "v50", "v100", "vol")


def priors(rows: DataFrame, q: float = PLATEAU_QUANTILE) -> DataFrame:
    """dataset, d95, v50, v100, vol, low, high: what a stream hands on to targets as its limits, a row a stream.

    Quantiles are over unguarded rows from PLATEAU_CYCLE on, or over all unguarded ones where there are none; ``low`` and
    ``high`` bound the support of each feature.
    """
    free = rows.where("guard = 0").withColumn("late", F.col("center_cycle") >= PLATEAU_CYCLE)
    any_late = F.max("late")
    of = lambda c: F.when(any_late, M.med(F.when(F.col("late"), c), q)).otherwise(M.med(c, q))
    limits = free.groupBy("dataset").agg(of(A.norm(F.col("v50"))).alias("v50"), of(A.norm(F.col("v100"))).alias("v100"), of(F.col("vol")).alias("vol"))
    ends = lambda p: F.array(*[M.med(F.get("r", i), p) for i in range(len(ZS))])
    support = rows.groupBy("dataset").agg(ends(0.01).alias("low"), ends(0.99).alias("high"), M.med(F.when(F.col("baseline_window") == 1, F.col("d")), 0.95).alias("d95"))
    return limits.join(support, "dataset")


def prior_table(s, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The priors of all source streams as a table of a version, named by its fingerprint."""
    table = scratch.settle(priors(rows), "priors")
    return table.withColumn("version", F.lit(T.fingerprint(table).first()["digest"]))


@query(
    ", g AS (SELECT sc.*, start_cycle <= floor(end_cycle / 500) * 500 + 100 AS guard FROM sc), "
    + "v AS (SELECT *, "
    + ", ".join(f"CASE WHEN count(*) OVER w{k} = {k} THEN quantile_cont({c}, 0.5) OVER h{k} - quantile_cont({c}, 0.5) OVER b{k} ELSE 0 END AS v{k}_{c}" for k in (50, 100) for c in (f"z_{f}" for f in B.FEATURES))
    + " FROM g WINDOW " + ", ".join(f"w{k} AS (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW), h{k} AS (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN {k // 2 - 1} PRECEDING AND CURRENT ROW), b{k} AS (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN {k - 1} PRECEDING AND {k // 2} PRECEDING)" for k in (50, 100))
    + "), n AS (SELECT dataset, center_cycle >= 600 AS late, " + ", ".join(f"sqrt({' + '.join(f'v{k}_z_{f} * v{k}_z_{f}' for f in B.FEATURES)}) AS n{k}" for k in (50, 100)) + " FROM v WHERE NOT guard) "
    "SELECT dataset, " + ", ".join(f"round(CASE WHEN bool_or(late) THEN quantile_cont(n{k}, 0.75) FILTER (late) ELSE quantile_cont(n{k}, 0.75) END, 6) AS v{k}" for k in (50, 100)) + " FROM n GROUP BY 1"
)
def source_priors(s, sf):
    """Velocity limits that each stream hands on as a source."""
    return priors(vector_rows(s, sf)).select("dataset", r6("v50"), r6("v100"))


PLATEAU = "dataset string, window_index long, plateau string, exit string, severe string, distance double, instability double, severe_score double, severe_20 double, severe_50 double, event string, direction array<double>, locked_at double, exit_at double, severe_at double"
PLATEAU_COLUMNS = [c.split()[0] for c in PLATEAU.split(", ")][2:]


def plateau_run(rows: DataFrame, limits: DataFrame, elapsed: bool = False) -> DataFrame:
    """Streams under limits (dataset, d95, v50, v100, vol, low, high and perhaps severe, a direction to begin with)."""
    own = limits.select("dataset", F.struct("d95", "v50", "v100", "vol").alias("prior"), "low", "high", F.col("severe") if "severe" in limits.columns else F.lit(None).cast("array<double>").alias("severe"))
    outside = [((F.get("r", i) < F.get("low", i)) | (F.get("r", i) > F.get("high", i))).cast("double") for i in range(len(ZS))]
    fed = rows.join(own, "dataset").withColumn("oos", sum(outside, F.lit(0.0)) / len(ZS)).drop("low", "high", "baseline_window")
    return H.backfill(fed, ["dataset"], "window_index", lambda: X.PlateauEngine(PLATEAU_CYCLE, elapsed=elapsed), PLATEAU, PLATEAU_COLUMNS)


def handed_on(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The limits of each stream's source, under the stream's own name."""
    return directions(rows).join(table.withColumnRenamed("dataset", "source"), "source")


def plateau_result(df: DataFrame) -> DataFrame:
    return df.select("dataset", "window_index", "plateau", "exit", "severe", *[r6(c) for c in ("distance", "instability", "severe_score", "severe_20", "severe_50")], "event", "locked_at", "exit_at", "severe_at")


@query()
def plateau_state(s, sf):
    """Plateau, exit and severity of each stream under the limits of its source; no direction is handed on."""
    scratch = Scratch(s, "plateau")
    rows = scratch.settle(vector_rows(s, sf), "rows")
    return scratch.last(plateau_result(plateau_run(rows, handed_on(rows, prior_table(s, rows, scratch)))))


@query()
def plateau_elapsed(s, sf):
    """The same by elapsed cycles, which a guard breaks."""
    scratch = Scratch(s, "plateau")
    rows = scratch.settle(vector_rows(s, sf), "rows")
    return scratch.last(plateau_result(plateau_run(rows, handed_on(rows, prior_table(s, rows, scratch)), elapsed=True)))


@query()
def plateau_with_source(s, sf):
    """Two phases: sources run under their own limits, and a direction that they learned after an exit goes to targets."""
    scratch = Scratch(s, "plateau")
    rows = scratch.settle(vector_rows(s, sf), "rows")
    table = prior_table(s, rows, scratch)
    learned = plateau_run(rows, table).where("direction IS NOT NULL").groupBy("dataset").agg(F.max_by("direction", "window_index").alias("severe"))
    model = scratch.settle(table.join(learned, "dataset", "left"), "model")
    return scratch.last(plateau_result(plateau_run(rows, handed_on(rows, model))))


@query(
    THRESHOLDS + ", q AS (SELECT sc.dataset, window_index, end_cycle <= 500 AS calm, start_cycle <= floor(end_cycle / 500) * 500 + 100 AS guard, "
    "CASE WHEN round(awr, 9) > round(2 * abs(ta), 9) THEN 4 WHEN round(awr, 9) >= round(ta, 9) AND round(bd, 9) >= round(tb, 9) THEN 2 ELSE 0 END AS flag FROM sc JOIN th USING (dataset)), r AS ("
    "SELECT dataset, CAST(-1 AS BIGINT) AS window_index, 'CALIBRATION' AS mode, CAST(-1 AS BIGINT) AS freeze_until, 0 AS prio, CAST(0 AS BIGINT) AS safe_run, '' AS event FROM (SELECT DISTINCT dataset FROM q) UNION ALL "
    "SELECT dataset, window_index, CASE WHEN calm THEN 'CALIBRATION' WHEN guard THEN 'RESTART_GUARD' WHEN window_index <= until2 THEN mode2 WHEN run2 >= 10 THEN 'ACTIVE_UPDATE' ELSE 'ACTIVE_MONITOR' END, until2, "
    "CASE WHEN freed THEN 0 ELSE prio2 END, run2, CASE WHEN freed THEN 'EXIT_FREEZE' ELSE event2 END FROM ("
    "SELECT *, NOT calm AND NOT guard AND window_index > until2 AND starts_with(mode2, 'FROZEN') AS freed, CASE WHEN calm OR guard OR window_index <= until2 THEN 0 ELSE safe_run + 1 END AS run2 FROM ("
    "SELECT *, CASE WHEN NOT takes THEN freeze_until WHEN active THEN greatest(freeze_until, window_index + 100) ELSE window_index + 100 END AS until2, CASE WHEN takes AND (stronger OR NOT active) THEN want ELSE prio END AS prio2, "
    "CASE WHEN takes AND (stronger OR NOT active) THEN CASE WHEN want = 4 THEN 'FROZEN_RISK' ELSE 'FROZEN_EVENT' END ELSE mode END AS mode2, CASE WHEN NOT takes THEN '' WHEN active THEN 'EXTEND_FREEZE' ELSE 'ENTER_STATE' END AS event2 FROM ("
    "SELECT *, want > 0 AND (NOT active OR stronger OR window_index + 100 >= freeze_until + 20) AS takes FROM ("
    "SELECT q.dataset, q.window_index, q.calm, q.guard, CASE WHEN calm OR guard THEN 0 ELSE flag END AS want, r.mode, r.freeze_until, r.prio, r.safe_run, q.window_index <= r.freeze_until AS active, CASE WHEN calm OR guard THEN 0 ELSE flag END > r.prio AS stronger "
    "FROM r JOIN q ON q.dataset = r.dataset AND q.window_index = r.window_index + 1))))) "
    "SELECT dataset, window_index, mode, freeze_until, CASE prio WHEN 4 THEN 'HIGH_RISK' WHEN 2 THEN 'HIGH_AWR_HIGH_BD' ELSE '' END AS reason, safe_run, event FROM r WHERE window_index >= 0",
    RECURSIVE,
)
def freeze_machine(s, sf):
    at = lambda c: F.round(c, 9)
    rows = machine_rows(s, sf).select("dataset", "window_index", "end_cycle", "guard", ((at("awr") >= at("ta")) & (at("bd") >= at("tb"))).alias("high_pair"), (at("awr") > at(2 * F.abs("ta"))).alias("high_risk"))
    return H.backfill(rows, ["dataset"], "window_index", X.FreezeMachine, "dataset string, window_index long, mode string, freeze_until long, reason string, safe_run long, event string", ["mode", "freeze_until", "reason", "safe_run", "event"])


def adapter_rows(s, sf) -> DataFrame:
    """Windows with features, trends, events and the limits of their baselines."""
    sc = machine_rows(s, sf)
    rows = frame(s, sf, {"rs50": R.trend("awr", 50)}, 99, sc).join(tes_frame(s, sf).select("dataset", "window_index", F.col("tes")), ["dataset", "window_index"])
    base = sc.where("baseline_window = 1").groupBy("dataset").agg(F.array(*[M.med(c) for c in ZS]).alias("_c"))
    mad = sc.where("baseline_window = 1").join(base, "dataset").groupBy("dataset").agg(F.array(*[1.4826 * M.med(F.abs(F.col(c) - F.get("_c", i))) for i, c in enumerate(ZS)]).alias("mad0"))
    return rows.join(mad, "dataset").select("dataset", "window_index", "end_cycle", "guard", F.array(*ZS).alias("x"), "mad0", "awr", "bd", "rs50", "tes", F.col("ta").alias("awr95"), F.col("tb").alias("bd95"), F.lit(3.0).alias("tes_limit"))


@query()
def gated_adapter(s, sf):
    """Reliabilities and offset learned in safe windows, with freezes, checkpoints and rollbacks."""
    columns = ["awr", "probability", "slow_risk", "offset", "noise", "frozen", "gate", "reason", "event", "reliability"]
    schema = "dataset string, window_index long, awr double, probability double, slow_risk double, offset double, noise double, frozen int, gate int, reason string, event string, reliability array<double>"
    got = H.backfill(adapter_rows(s, sf), ["dataset"], "window_index", X.GatedAdapter, schema, columns)
    return got.select("dataset", "window_index", *[c for c in columns if c != "reliability"], *[F.get("reliability", i).alias(f"reliability_{f}") for i, f in enumerate(B.FEATURES)])


@query()
def freeze_rollback(s, sf):
    """The freeze machine with updates of an offset, cooldowns, checkpoints and rollbacks."""
    rows = adapter_rows(s, sf)
    logit = F.col("awr") - 2
    slow = frame(s, sf, {"slow": R.rolling_mean("_p", 20)}, 19, rows.withColumns({"_p": A.sigmoid(logit), "_at": F.col("window_index") + 1}))
    high = (F.col("awr") >= F.col("awr95")) & (F.col("bd") >= F.col("bd95"))
    fed = slow.select("dataset", "window_index", "end_cycle", "guard", "awr", "bd", "slow", (0.005 * (-2.944438979166440 - logit)).alias("delta"), high.alias("high_pair"), (F.col("tes") >= 3 * F.col("tes_limit")).alias("tes"), (F.col("awr") > 2 * F.abs("awr95")).alias("high_risk"), (F.col("bd") < F.col("bd95")).alias("safe"))
    return H.backfill(fed, ["dataset"], "window_index", X.FreezeMachine, "dataset string, window_index long, mode string, freeze_until long, reason string, safe_run long, event string, value double", ["mode", "freeze_until", "reason", "safe_run", "event", "value"])


@query()
def nuisance_adapter(s, sf):
    rows = machine_rows(s, sf).select("dataset", "window_index", "end_cycle", "guard", F.array(*[f"z_{f}" for f in B.FEATURES]).alias("x"))
    make = lambda: X.NuisanceAdapter([[1.0, 1.0, 0.0]])
    return H.backfill(rows, ["dataset"], "window_index", make, "dataset string, window_index long, score double, beta_norm double, reason string", ["score", "beta_norm", "reason"])


HORIZONS = (50, 100, 200)
#: Forecasts are issued every 50 cycles, from ten rows of three inputs, which are the outputs, too.
ISSUE, ISSUE_ROWS, OUTPUTS, FORECAST_HORIZONS = 10, 10, ("awr", "bd", "z_x_p2p"), (50, 100, 200, 500)


def directions(sc: DataFrame) -> DataFrame:
    """source, dataset: each stream (few, one row each) with the next one by name as its source, the last with the first."""
    names = sc.select("dataset").distinct()
    by_name = Window.orderBy("dataset")
    first = F.first("dataset").over(by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return names.select("dataset", F.coalesce(F.lead("dataset").over(by_name), first).alias("source"))


def issued(s, sf) -> DataFrame:
    """Every ISSUE-th window of each stream, numbered in ``_at``."""
    return machine_rows(s, sf).where(F.col("window_index") % ISSUE == 0).select("dataset", "window_index", "center_cycle", "guard", *OUTPUTS, (F.col("window_index") / ISSUE + 1).cast("long").alias("_at"))


def source_heads(base: DataFrame) -> DataFrame:
    """dataset, output, horizon, frozen: ridge weights of the change over a horizon, fitted on the whole source stream.

    A target stream gets the weights of its source and never one of its own rows. Below 20 rows there is no head.
    """
    back = lambda w: w.rowsBetween(1 - ISSUE_ROWS, 0)
    parts = {"_m": lambda c: lambda w: F.avg(c).over(back(w)), "_d": lambda c: lambda w: F.stddev_pop(c).over(back(w)), "_e": lambda c: lambda w: F.col(c) - F.first(c).over(back(w))}
    terms = ["one", *[f"{p}_{c}" for p in parts for c in OUTPUTS]]
    columns = {f"{p}_{c}": make(c) for p, make in parts.items() for c in OUTPUTS} | {"_n": lambda w: F.count("*").over(back(w))}
    full = S.framed(base, ["dataset"], "_at", columns, ISSUE_ROWS - 1).where(F.col("_n") == ISSUE_ROWS).withColumn("one", F.lit(1.0))
    outputs = F.explode(F.array(*[F.struct(F.lit(c).alias("output"), F.col(c).alias("v")) for c in OUTPUTS])).alias("_o")
    asked = full.withColumn("horizon", F.explode(F.array(*map(F.lit, FORECAST_HORIZONS)))).select("dataset", "horizon", (F.col("_at") + F.col("horizon") / (5 * ISSUE)).cast("long").alias("_at"), *terms, outputs).select("dataset", "horizon", "_at", *terms, "_o.*")
    later = base.select("dataset", "_at", outputs).select("dataset", "_at", "_o.output", F.col("_o.v").alias("later"))
    fit = L.ridge(asked.join(later, ["dataset", "_at", "output"]).withColumn("y", F.col("later") - F.col("v")), ["dataset", "output", "horizon"], terms, "y")
    weights = F.map_from_entries(F.collect_list(F.struct("term", "coefficient")))
    heads = fit.groupBy("dataset", "output", "horizon").agg(weights.alias("_w")).select(F.col("dataset").alias("source"), "output", F.col("horizon").cast("double").alias("horizon"), F.array(*[F.element_at("_w", t) for t in terms]).alias("frozen"))
    return directions(base).join(heads, "source").drop("source")


@query()
def safe_ensemble(s, sf):
    """Delayed-feedback forecasts of three outputs over four horizons, each stream with the frozen heads of its source.

    Streams, outputs and horizons are keys of their own, so they run in parallel.
    """
    scratch = Scratch(s, "forecasts")
    base = scratch.settle(issued(s, sf), "issued")
    inputs = F.array(*OUTPUTS).alias("inputs")
    outputs = F.explode(F.array(*[F.struct(F.lit(c).alias("output"), F.col(c).alias("value")) for c in OUTPUTS])).alias("_o")
    rows = base.select("dataset", "window_index", "center_cycle", "guard", inputs, outputs).select("*", "_o.*", F.explode(F.array(*[F.lit(float(h)) for h in FORECAST_HORIZONS])).alias("horizon")).drop("_o")
    rows = rows.join(scratch.settle(source_heads(base), "heads"), ["dataset", "output", "horizon"], "left")
    columns = ["zero", "linear", "kalman", "frozen", "online", "safe", "alpha", "mode", "episode", "settled"]
    schema = "dataset string, output string, horizon double, window_index long, zero double, linear double, kalman double, frozen double, online double, safe double, alpha double, mode string, episode int, settled int"
    make = lambda: X.Forecaster(history=ISSUE_ROWS, ring=100)
    return scratch.last(H.backfill(rows, ["dataset", "output", "horizon"], "window_index", make, schema, columns))


@query()
def shared_forecast(s, sf):
    """Forecasts of all outputs by one recursive fit a stream and horizon, whose outputs share a covariance."""
    scratch = Scratch(s, "forecasts")
    base = scratch.settle(issued(s, sf), "issued")
    by_output = F.map_from_entries(F.collect_list(F.struct("output", "frozen")))
    heads = source_heads(base).groupBy("dataset", "horizon").agg(by_output.alias("_w")).where(F.size("_w") == len(OUTPUTS))
    heads = heads.select("dataset", "horizon", F.array(*[F.element_at("_w", c) for c in OUTPUTS]).alias("frozen"))
    both = F.array(*OUTPUTS)
    rows = base.select("dataset", "window_index", "center_cycle", both.alias("inputs"), both.alias("values"), F.explode(F.array(*[F.lit(float(h)) for h in FORECAST_HORIZONS])).alias("horizon"))
    rows = rows.join(scratch.settle(heads, "heads"), ["dataset", "horizon"], "left")
    got = H.backfill(rows, ["dataset", "horizon"], "window_index", lambda: X.SharedForecaster(ISSUE_ROWS), "dataset string, horizon double, window_index long, frozen array<double>, online array<double>, settled int", ["frozen", "online", "settled"])
    part = lambda c, p: [F.get(c, i).alias(f"{p}_{name}") for i, name in enumerate(OUTPUTS)]
    return scratch.last(got.select("dataset", "horizon", "window_index", "settled", *part("frozen", "frozen"), *part("online", "online")))


@query()
def forecast_scores(s, sf):
    """Mean error, root mean square and share of right directions of each model, output and horizon, where observed."""
    made = safe_ensemble(s, sf)
    truth = issued(s, sf).select("dataset", "window_index", F.explode(F.array(*[F.struct(F.lit(c).alias("output"), F.col(c).alias("later")) for c in OUTPUTS])).alias("_o")).select("dataset", "window_index", "_o.*")
    due = (F.col("window_index") + F.col("horizon") / 5).cast("long")
    both = made.where("safe IS NOT NULL").withColumn("due", due).join(truth.withColumnRenamed("window_index", "due"), ["dataset", "output", "due"])
    models = ["zero", "linear", "kalman", "frozen", "online", "safe"]
    long = both.select("dataset", "output", "horizon", F.col("zero").alias("now"), "later", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("guess")) for m in models])).alias("_m")).select("*", "_m.*")
    e, right = F.col("guess") - F.col("later"), F.signum(F.col("guess") - F.col("now")) == F.signum(F.col("later") - F.col("now"))
    return long.groupBy("dataset", "output", "horizon", "model").agg(F.count("*").alias("n"), r6(F.avg(F.abs(e)), "mae"), r6(F.sqrt(F.avg(e * e)), "rmse"), r6(F.avg(right.cast("double")), "direction_accuracy"))


@query(
    ", h AS (SELECT dataset, window_index, awr, avg(awr) OVER w AS m, stddev_pop(awr) OVER w AS d, awr - first_value(awr) OVER w AS e, count(*) OVER w AS c, count(*) OVER (PARTITION BY dataset) - 19 AS n FROM sc WINDOW w AS (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), "
    "t AS (SELECT a.dataset, k.k AS horizon, b.awr - a.awr AS y, a.m, a.d, a.e FROM h a, (SELECT unnest([50, 100, 200]) AS k) k JOIN h b ON b.dataset = a.dataset AND b.window_index = a.window_index + k.k / 5 WHERE a.c = 20 AND b.c = 20 AND a.window_index < 0.4 * a.n) "
    "SELECT dataset, horizon::DOUBLE AS horizon, count(*) AS n, round(sum(m * y), 4) AS my, round(sum(d * y), 4) AS dy, round(sum(e * y), 4) AS ey FROM t GROUP BY ALL"
)
def frozen_head_sums(s, sf):
    """The right sides of the frozen heads' normal equations; the heads themselves are solved from them."""
    h = frame(s, sf, {"h": R.history(["awr"])}, 19).where("h is not null").select("dataset", "window_index", "awr", *[F.get("h", i).alias(f"h{i}") for i in (1, 2, 3)])
    n = h.groupBy("dataset").agg(F.count("*").alias("_n"))
    x = h.join(n, "dataset").where(F.col("window_index") < 0.4 * F.col("_n")).withColumn("horizon", F.explode(F.array(*[F.lit(float(k)) for k in HORIZONS])))
    x = x.withColumn("due", (F.col("window_index") + F.col("horizon") / 5).cast("long"))
    rows = x.join(h.select("dataset", F.col("window_index").alias("due"), F.col("awr").alias("later")), ["dataset", "due"]).withColumn("y", F.col("later") - F.col("awr"))
    g = L.gram(rows, ["dataset", "horizon"], ["h1", "h2", "h3"], "y")
    return g.select("dataset", "horizon", "n", F.round("h1__y", 4).alias("my"), F.round("h2__y", 4).alias("dy"), F.round("h3__y", 4).alias("ey"))


def _hmm_sql() -> str:
    """One step of the filter, with the tri-diagonal transition written out."""
    stay, forward, back = 0.97, 0.025, 0.005
    rows = [{j: v for j, v in ((i - 1, back), (i, stay), (i + 1, forward)) if 0 <= j < 5} for i in range(5)]
    into = [" + ".join(f"r.q{i} * {v / sum(row.values())!r}" for i, row in enumerate(rows) for j, v in row.items() if j == k) for k in range(5)]
    seen = [f"exp(-0.5 * power(greatest(-3, least(3, awr)) - ({k} - 2), 2)) AS o{k}" for k in range(5)]
    steps = ", ".join(f"o{k} * ({into[k]}) AS n{k}" for k in range(5))
    total, qs = " + ".join(f"n{k}" for k in range(5)), ", ".join(f"n{k} / t AS q{k}" for k in range(5))
    first = ", ".join(f"CAST({int(k == 0)} AS DOUBLE) AS q{k}" for k in range(5))
    return (
        f", ob AS (SELECT dataset, window_index, {', '.join(seen)} FROM sc), r AS (SELECT dataset, CAST(-1 AS BIGINT) AS window_index, {first} FROM (SELECT DISTINCT dataset FROM ob) UNION ALL "
        f"SELECT dataset, window_index, {qs} FROM (SELECT *, {total} AS t FROM (SELECT ob.dataset, ob.window_index, {steps} FROM r JOIN ob ON ob.dataset = r.dataset AND ob.window_index = r.window_index + 1))), "
        "l AS (SELECT dataset, window_index, [q0, q1, q2, q3, q4] AS q FROM r WHERE window_index >= 0) "
        "SELECT dataset, window_index, CAST(list_position(q, list_max(q)) AS INTEGER) AS stage, round(list_max(q), 5) AS top, round(list_max(q) - list_reverse_sort(q)[2], 5) AS margin FROM l"
    )


@query(_hmm_sql(), RECURSIVE)
def hmm_filter(s, sf):
    centre = lambda k: F.exp(-0.5 * F.pow(A.clip(F.col("awr"), -3.0, 3.0) - (k - 2), 2))
    rows = B.scores(s, sf).select("dataset", "window_index", F.array(*[centre(k) for k in range(5)]).alias("observation"))
    got = H.backfill(rows, ["dataset"], "window_index", X.ForwardFilter, "dataset string, window_index long, posterior array<double>, stage int, margin double", ["posterior", "stage", "margin"])
    return got.select("dataset", "window_index", "stage", F.round(F.array_max("posterior"), 5).alias("top"), F.round("margin", 5).alias("margin"))


@query()
def regime_discovery(s, sf):
    rows = machine_rows(s, sf).select("dataset", "window_index", "guard", F.col("awr").alias("level"))
    return H.backfill(rows, ["dataset"], "window_index", X.RegimeDiscovery, "dataset string, window_index long, stage int, score double, candidate int, event string", ["stage", "score", "candidate", "event"])


REGIME_GRID = [(t, least, dwell) for t in (2.0, 3.0, 4.0) for least in (10, 20, 30) for dwell in (20, 40, 60)]


@query()
def regime_grid(s, sf):
    """27 parameter cells of the regime machine in one pass a stream: stages found, and the share of windows whose stage is
    that of the label, which is attached afterwards, by overlaps of spans. The best cell of a stream is selected."""
    scratch = Scratch(s, "regimes")
    sc = scratch.settle(machine_rows(s, sf).select("dataset", "window_index", "guard", F.col("awr").alias("level"), "stage"), "rows")
    makes = [lambda p=p: X.RegimeDiscovery(threshold=p[0], least=p[1], dwell=p[2]) for p in REGIME_GRID]
    found = scratch.settle(H.changes(S.drop_labels(sc), ["dataset"], "window_index", makes, "stage"), "changes")
    ends = sc.groupBy("dataset").agg((F.max("window_index") + 1).alias("_n"))
    until = F.lead("window_index").over(Window.partitionBy("dataset", "cell").orderBy("window_index"))  # a row a stage
    spans = found.join(ends, "dataset").withColumn("until", F.coalesce(until, "_n"))
    labels = sc.groupBy("dataset", "stage").agg(F.min("window_index").alias("_from"), (F.max("window_index") + 1).alias("_to"))
    overlap = F.greatest(F.least("until", "_to") - F.greatest("window_index", "_from"), F.lit(0))
    agreed = spans.join(labels, ["dataset", "stage"], "left").groupBy("dataset", "cell", "_n").agg(F.max("stage").alias("stages"), F.sum(F.coalesce(overlap, F.lit(0))).alias("_same"))
    share = agreed.withColumn("agreement", F.col("_same") / F.col("_n"))
    best = share.groupBy("dataset").agg(F.max_by("cell", F.struct(F.round("agreement", 9), -F.col("cell"))).alias("_best"))
    of = lambda i: F.get(F.array(*[F.lit(p[i]) for p in REGIME_GRID]), F.col("cell"))
    return scratch.last(share.join(best, "dataset").select("dataset", of(0).alias("threshold"), of(1).alias("least"), of(2).alias("dwell"), "stages", r6("agreement"), (F.col("cell") == F.col("_best")).cast("int").alias("selected")))


@query(
    ", n AS (SELECT dataset, count(*) AS n FROM sc GROUP BY 1) SELECT dataset, CAST(k AS INTEGER) AS tenth, n - greatest(1, CAST(floor(n * k / 10 + 0.5) AS BIGINT)) AS n, CAST(0 AS DOUBLE) AS difference, CAST(0 AS BIGINT) AS other_events FROM n, (SELECT unnest(range(11)) AS k)"
)
def snapshot_replay(s, sf):
    """The adapter's state is kept at eleven points of each stream; what is replayed from each equals the unbroken run."""
    scratch = Scratch(s, "snapshots")
    rows = scratch.settle(adapter_rows(s, sf), "rows")
    columns = ["probability", "slow_risk", "offset", "noise", "event"]
    schema = "probability double, slow_risk double, offset double, noise double, event string"
    n = rows.groupBy("dataset").agg(F.count("*").alias("_n")).withColumn("tenth", F.explode(F.sequence(F.lit(0), F.lit(10))))
    points = n.select("dataset", "tenth", (F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("tenth") / 10 + 0.5)) - 1).alias("at"))
    marked = rows.join(points.select("dataset", F.col("at").alias("window_index"), F.lit(True).alias("mark")).distinct(), ["dataset", "window_index"], "left")
    kept = scratch.settle(H.snapshots(marked, ["dataset"], "window_index", "mark", X.GatedAdapter), "kept")
    first = kept.select("dataset", F.col("window_index").alias("at"), "body")
    # eleven points, whatever a stream's length; a state goes with the first row after it
    again = rows.join(points, "dataset").where("window_index > at").join(first.withColumn("window_index", F.col("at") + 1), ["dataset", "window_index", "at"], "left").drop("at")
    resumed = H.backfill(again, ["dataset", "tenth"], "window_index", X.GatedAdapter, "dataset string, tenth int, window_index long, " + schema, columns, snapshot="body")
    whole = H.backfill(rows, ["dataset"], "window_index", X.GatedAdapter, "dataset string, window_index long, " + schema, columns).select("dataset", "window_index", *[F.col(c).alias(f"_{c}") for c in columns])
    gap = F.greatest(*[F.abs(F.col(c) - F.col(f"_{c}")) for c in columns[:-1]])
    got = resumed.join(whole, ["dataset", "window_index"]).groupBy("dataset", "tenth").agg(F.count("*").alias("n"), F.max(gap).alias("difference"), F.sum((F.col("event") != F.col("_event")).cast("long")).alias("other_events"))
    zero = F.lit(0)
    return scratch.last(points.join(got, ["dataset", "tenth"], "left").select("dataset", "tenth", F.coalesce("n", zero).alias("n"), F.coalesce("difference", F.lit(0.0)).alias("difference"), F.coalesce("other_events", zero).alias("other_events")))


@query()
def ordered_prototypes(s, sf):
    rows = machine_rows(s, sf).select("dataset", "window_index", "guard", F.col("awr").alias("level"))
    make = lambda: X.OrderedPrototypes([-2.0, -1.0, 0.0, 1.0, 2.0])
    return H.backfill(rows, ["dataset"], "window_index", make, "dataset string, window_index long, stage int, confidence double, event string", ["stage", "confidence", "event"])


def prototypes(rows: DataFrame) -> DataFrame:
    """dataset, prototypes, variances (a vector a stage), tes99: what a labelled source stream hands on, a row a stream."""
    stages = rows.where("guard = 0").groupBy("dataset", "stage").agg(F.array(*[F.avg(F.get("x", i)) for i in range(len(ZS))]).alias("m"), F.array(*[F.var_pop(F.get("x", i)) for i in range(len(ZS))]).alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("stage", "m", "v")))
    wide = stages.groupBy("dataset").agg(ordered.alias("_s")).where(F.size("_s") == 5)
    of = lambda c: F.transform("_s", lambda x: x[c])
    return wide.select("dataset", of("m").alias("prototypes"), of("v").alias("variances")).join(rows.groupBy("dataset").agg(M.med("tes", 0.99).alias("tes99")), "dataset")


def prototype_rows(s, sf) -> DataFrame:
    return adapter_rows(s, sf).join(B.scores(s, sf).select("dataset", "window_index", "stage"), ["dataset", "window_index"]).select("dataset", "window_index", "stage", "guard", "x", "tes")


@query(
    ", g AS (SELECT * FROM sc WHERE NOT start_cycle <= floor(end_cycle / 500) * 500 + 100) SELECT dataset, stage, round(avg(z_x_mean), 6) AS m_x_mean, round(avg(z_x_rms), 6) AS m_x_rms, round(avg(z_x_p2p), 6) AS m_x_p2p, round(var_pop(z_x_mean), 6) AS v_x_mean, round(var_pop(z_x_rms), 6) AS v_x_rms, round(var_pop(z_x_p2p), 6) AS v_x_p2p FROM g GROUP BY ALL"
)
def source_prototypes(s, sf):
    """Means and variances of each stage that a stream hands on as a source."""
    long = prototypes(prototype_rows(s, sf)).select("dataset", F.posexplode(F.arrays_zip("prototypes", "variances")).alias("_k", "_p"))
    part = lambda field, name: [r6(F.get(F.col(f"_p.{field}"), i), f"{name}_{f}") for i, f in enumerate(B.FEATURES)]
    return long.select("dataset", (F.col("_k") + 1).alias("stage"), *part("prototypes", "m"), *part("variances", "v"))


@query()
def prototype_memory(s, sf):
    """Prototypes of a source stream adapted to each target, with memory, drift freezes, checkpoints and rollbacks."""
    scratch = Scratch(s, "prototypes")
    rows = scratch.settle(prototype_rows(s, sf), "rows")
    table = scratch.settle(prototypes(rows), "source")
    given = directions(rows).join(table.withColumnRenamed("dataset", "source"), "source").select("dataset", F.struct("prototypes", "variances", "tes99").alias("source"))
    fed = S.drop_labels(rows).join(given, "dataset")
    columns = ["stage", "confidence", "entropy", "margin", "js", "reason", "event", "support", "remembered", "drift"]
    schema = "dataset string, window_index long, stage int, confidence double, entropy double, margin double, js double, reason string, event string, support int, remembered int, drift double"
    return scratch.last(H.backfill(fed, ["dataset"], "window_index", X.PrototypeMemory, schema, columns))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, robust z, mean score, baseline threshold and AUROC of the last stage, for each stream."""
    sc = B.scores(spark, sf_dir).withColumn("late", (F.col("stage") == 5).cast("int"))
    return M.auroc(sc, ["dataset"], "awr", "late").join(thresholds(sc), "dataset").select("dataset", "n_pos", "n_neg", r6("auroc"), r6("ta", "awr_p95"), r6("tb", "bd_p95"))
