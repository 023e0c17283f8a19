"""Queries of model comparison, selection, axes, audits and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.operators import evaluation as E
from strandline.operators import metrics as M
from strandline.operators import rolling as R
from strandline.operators import streams as S
from strandline.operators import topk as K
from strandline.plans import base as B
from strandline.plans.base import r6
from strandline.plans.catalog import EVENTS, LATE, OV, RECURSIVE, TES, THRESHOLDS, frame, late, query, tes_events, tes_frame, thresholds
from strandline.sources.shared import Scratch

Z = [f"z_{f}" for f in B.FEATURES]
FIVE = range(1, 6)

# ================================================================== comparison of models

MODELS = {"mean_z": "awr", "distance": "bd", "mean_only": "z_x_mean", "no_p2p": "no_p2p"}
MODEL_SQL = (
    ", mo AS (SELECT *, (z_x_mean + z_x_rms) / 2 AS no_p2p FROM sc), ml AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS model_name, dataset, stage, round({c}, 9) AS score FROM mo" for m, c in MODELS.items())
    + "), mr AS (SELECT *, CASE WHEN stage = 5 THEN 1 ELSE 0 END AS late, rank() OVER (PARTITION BY model_name, dataset ORDER BY score) + (count(*) OVER (PARTITION BY model_name, dataset, score) - 1) / 2.0 AS r FROM ml), "
    "ev3 AS (SELECT model_name, dataset, (sum(r * late) - sum(late) * (sum(late) + 1) / 2) / (sum(late) * (count(*) - sum(late))) AS auroc, "
    "median(score) FILTER (stage = 1) AS median_early, median(score) FILTER (late = 1) AS median_late FROM mr GROUP BY ALL), "
    "cm AS (SELECT model_name, avg(auroc) AS mean_auroc, min(auroc) AS worst_auroc, avg(median_late - median_early) AS mean_score_gap, min(median_late - median_early) AS worst_score_gap FROM ev3 GROUP BY 1)"
)


def evaluated(s, sf) -> DataFrame:
    sc = B.scores(s, sf).withColumn("no_p2p", (F.col("z_x_mean") + F.col("z_x_rms")) / 2)
    return E.evaluate_models(E.model_rows(sc, MODELS, ["dataset", "stage"]))


def compared(s, sf) -> DataFrame:
    return E.compare_models(evaluated(s, sf), ["auroc", "score_gap"])


@query(MODEL_SQL + " SELECT model_name, dataset, round(auroc, 6) AS auroc, round(median_early, 6) AS median_early, round(median_late, 6) AS median_late, round(median_late - median_early, 6) AS score_gap FROM ev3")
def target_evaluation(s, sf):
    return evaluated(s, sf).select("model_name", "dataset", r6("auroc"), r6("median_early"), r6("median_late"), r6("score_gap"))


@query(MODEL_SQL + " SELECT model_name, round(mean_auroc, 6) AS mean_auroc, round(worst_auroc, 6) AS worst_auroc, round(mean_score_gap, 6) AS mean_score_gap, round(worst_score_gap, 6) AS worst_score_gap FROM cm")
def model_comparison(s, sf):
    return compared(s, sf).select("model_name", *[r6(c) for c in ("mean_auroc", "worst_auroc", "mean_score_gap", "worst_score_gap")])


@query(
    MODEL_SQL + " SELECT (SELECT model_name FROM cm ORDER BY round(worst_auroc, 9) DESC, model_name LIMIT 1) AS best_model, round(a.worst_auroc - b.worst_auroc, 6) AS drop, "
    "CASE WHEN abs(a.worst_auroc - b.worst_auroc) >= 0.08 THEN 'strong' WHEN abs(a.worst_auroc - b.worst_auroc) >= 0.03 THEN 'moderate' ELSE 'weak' END AS dependency FROM cm a, cm b WHERE a.model_name = 'mean_z' AND b.model_name = 'no_p2p'"
)
def dependency_decision(s, sf):
    """How much the worst case depends on one feature family, and the best model: one row."""
    worst = lambda m: F.max(F.when(F.col("model_name") == m, F.col("worst_auroc")))
    best = F.min_by("model_name", F.struct((-F.round("worst_auroc", 9)).alias("a"), "model_name"))
    one = compared(s, sf).agg(best.alias("best_model"), (worst("mean_z") - worst("no_p2p")).alias("drop"))
    return one.select("best_model", r6("drop"), E.dependency_grade(F.col("drop")).alias("dependency"))


@query(
    LATE + ", k AS (SELECT dataset, ra, stage, count(*) AS c FROM la GROUP BY ALL), p AS (SELECT a.dataset, sum(a.c * b.c * sign(a.stage - b.stage) * sign(a.ra - b.ra)) / 2 AS s FROM k a JOIN k b USING (dataset) GROUP BY 1), "
    "t1 AS (SELECT dataset, sum(c * (c - 1) / 2) AS t FROM (SELECT dataset, ra, sum(c) AS c FROM k GROUP BY ALL) GROUP BY 1), t2 AS (SELECT dataset, sum(c * (c - 1) / 2) AS t FROM (SELECT dataset, stage, sum(c) AS c FROM k GROUP BY ALL) GROUP BY 1), "
    "n AS (SELECT dataset, sum(c) AS n FROM k GROUP BY 1) SELECT dataset, n::BIGINT AS n, round(s / sqrt((n * (n - 1) / 2 - t1.t) * (n * (n - 1) / 2 - t2.t)), 6) AS kendall FROM p JOIN t1 USING (dataset) JOIN t2 USING (dataset) JOIN n USING (dataset)"
)
def kendall(s, sf):
    return E.kendall(late(s, sf), ["dataset"], "ra", "stage", list(FIVE)).select("dataset", "n", r6("kendall"))


GAPS = (20, 100, 300)
GAP_SQL = (
    ", pr AS (SELECT a.dataset, g.gap * 5 AS cycles, round(b.awr, 9) - round(a.awr, 9) AS d FROM sc a, (SELECT unnest([20, 100, 300]) AS gap) g JOIN sc b ON b.dataset = a.dataset AND b.window_index = a.window_index + g.gap), "
    "pg AS (SELECT dataset, CASE WHEN cycles >= 2000 THEN 'gap_2000_plus' WHEN cycles >= 1000 THEN 'gap_1000_2000' WHEN cycles >= 500 THEN 'gap_500_1000' WHEN cycles >= 100 THEN 'gap_100_500' END AS gap_bin, round(d, 9) AS d FROM pr)"
)


def gap_pairs(s, sf) -> DataFrame:
    """Differences of windows a fixed number of windows apart, for each gap; joins are by key."""
    sc = B.scores(s, sf).select("dataset", "window_index", F.round("awr", 9).alias("a"))
    far = sc.withColumn("gap", F.explode(F.array(*map(F.lit, GAPS)))).select("dataset", "gap", (F.col("window_index") + F.col("gap")).alias("window_index"), F.col("a").alias("_a"))
    pairs = far.join(sc, ["dataset", "window_index"])
    return pairs.select("dataset", "window_index", E.gap_bin(F.col("gap") * 5).alias("gap_bin"), F.round(F.col("a") - F.col("_a"), 9).alias("d"))


@query(
    GAP_SQL + ", mi AS (SELECT dataset, gap_bin, d, 1 AS y FROM pg UNION ALL SELECT dataset, gap_bin, -d, 0 FROM pg), ra2 AS (SELECT *, rank() OVER (PARTITION BY dataset, gap_bin ORDER BY d) + (count(*) OVER (PARTITION BY dataset, gap_bin, d) - 1) / 2.0 AS r FROM mi), "
    "au2 AS (SELECT dataset, gap_bin, (sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc FROM ra2 GROUP BY ALL) "
    "SELECT dataset, gap_bin, count(*) AS pairs, round(any_value(auc), 6) AS auc, round(avg(CASE WHEN d > 0 THEN 1.0 WHEN d = 0 THEN 0.5 ELSE 0.0 END), 6) AS accuracy, round(avg(ln(1 + exp(-greatest(-35, least(35, d))))), 6) AS logloss FROM pg JOIN au2 USING (dataset, gap_bin) GROUP BY ALL"
)
def pair_metrics_by_gap(s, sf):
    return E.pair_metrics(gap_pairs(s, sf), ["dataset", "gap_bin"], "d").select("dataset", "gap_bin", "pairs", r6("auc"), r6("accuracy"), r6("logloss"))


@query(
    MODEL_SQL + LATE + ", lr AS (SELECT dataset, stage, late, rank() OVER (PARTITION BY dataset ORDER BY ra) + (count(*) OVER (PARTITION BY dataset, ra) - 1) / 2.0 AS r, rank() OVER (PARTITION BY dataset ORDER BY stage) + (count(*) OVER (PARTITION BY dataset, stage) - 1) / 2.0 AS q FROM la), "
    "sp4 AS (SELECT dataset, corr(r, q) AS rho FROM lr GROUP BY 1) SELECT dataset, round(0.65 * coalesce(auroc, 0) + 0.35 * (coalesce(rho, 0) + 1) / 2, 6) AS selection_score FROM ev3 JOIN sp4 USING (dataset) WHERE model_name = 'mean_z'"
)
def selection_score(s, sf):
    """A weighted score of finite metrics; missing ones count as 0."""
    area = evaluated(s, sf).where("model_name = 'mean_z'").select("dataset", "auroc")
    rho = M.spearman(late(s, sf).withColumn("stage", F.col("stage").cast("double")), ["dataset"], "ra", "stage")
    zero = lambda c: F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(0.0))
    return area.join(rho, "dataset").select("dataset", r6(0.65 * zero("auroc") + 0.35 * (zero("spearman") + 1) / 2, "selection_score"))


# ================================================================== events, boundaries, first cycles


@query(
    EVENTS.replace("tes >= 3", "round(tes, 5) >= 3") + THRESHOLDS + f", ri AS (SELECT dataset, window_index, round(awr - lag(awr, 10) {OV}, 6) AS rise FROM sc), nr AS ("
    "SELECT ev2.dataset, ev2.window_index, bool_or(coalesce(ri.rise > 1, false)) AS rising FROM ev2 JOIN ri ON ri.dataset = ev2.dataset AND ri.window_index BETWEEN ev2.window_index - 2 AND ev2.window_index + 2 GROUP BY ALL) "
    "SELECT nr.dataset, nr.window_index, CASE WHEN round(awr, 6) >= round(ta, 6) AND rising THEN 'high_and_rising' WHEN round(awr, 6) >= round(ta, 6) THEN 'high' WHEN rising THEN 'rising' ELSE 'event_only' END AS event_type FROM nr JOIN sc USING (dataset, window_index) JOIN th USING (dataset)"
)
def event_ladder(s, sf):
    """Events by whether the score is high and whether it rises nearby; the neighbourhood is joined by key."""
    near = tes_events(s, sf).select("dataset", "window_index", F.explode(F.array(*[F.col("window_index") + k for k in range(-2, 3)])).alias("_at"))
    rise = frame(s, sf, {"rise": R.difference("awr", 10)}, 10).select("dataset", F.col("window_index").alias("_at"), (F.round("rise", 6) > 1).alias("up"))
    rising = near.join(rise, ["dataset", "_at"]).groupBy("dataset", "window_index").agg(F.max(F.coalesce("up", F.lit(False))).alias("rising"))
    sc = B.scores(s, sf)
    rows = rising.join(sc, ["dataset", "window_index"]).join(thresholds(sc), "dataset")
    high = F.round("awr", 6) >= F.round("ta", 6)
    return rows.select("dataset", "window_index", F.when(high & F.col("rising"), "high_and_rising").when(high, "high").when(F.col("rising"), "rising").otherwise("event_only").alias("event_type"))


TRUE_SQL = (
    THRESHOLDS + ", tr AS (SELECT dataset, stage, min(center_cycle) AS true_cycle FROM sc WHERE stage >= 2 GROUP BY ALL), "
    "fo AS (SELECT dataset, k::INTEGER AS stage, min(center_cycle) AS discovered_cycle FROM sc JOIN th USING (dataset), (SELECT unnest(generate_series(2, 5)) AS k) WHERE round(bd, 6) >= round(tb * (0.9 + 0.1 * k), 6) GROUP BY ALL)"
)


def boundaries(s, sf) -> tuple[DataFrame, DataFrame]:
    """True first cycles of the stages after the first, and the first cycles at which the distance passes a ladder."""
    sc = B.scores(s, sf)
    steps = sc.join(thresholds(sc), "dataset").withColumn("stage", F.explode(F.array(*[F.lit(k) for k in range(2, 6)])))
    found = steps.where(F.round("bd", 6) >= F.round(F.col("tb") * (0.9 + 0.1 * F.col("stage")), 6)).groupBy("dataset", "stage").agg(F.min("center_cycle").alias("discovered_cycle"))
    return sc.where("stage >= 2").groupBy("dataset", "stage").agg(F.min("center_cycle").alias("true_cycle")), found


@query(TRUE_SQL + " SELECT dataset, stage, true_cycle, discovered_cycle, discovered_cycle - true_cycle AS signed_error, abs(discovered_cycle - true_cycle) AS absolute_error FROM tr LEFT JOIN fo USING (dataset, stage)")
def boundary_errors(s, sf):
    return E.boundary_errors(*boundaries(s, sf))


@query(
    TRUE_SQL + ", er AS (SELECT dataset, avg(abs(discovered_cycle - true_cycle)) AS mean_error, count(*) FILTER (discovered_cycle IS NULL) AS missed, count(*) AS nt FROM tr LEFT JOIN fo USING (dataset, stage) GROUP BY 1), "
    "ea AS (SELECT dataset, count(*) AS nf, count(*) FILTER (discovered_cycle < true_cycle) AS early_false FROM fo LEFT JOIN tr USING (dataset, stage) GROUP BY 1) "
    "SELECT dataset, round(mean_error, 6) AS mean_error, missed, greatest(0, coalesce(nf, 0) - nt)::BIGINT AS extra, coalesce(early_false, 0)::BIGINT AS early_false FROM er LEFT JOIN ea USING (dataset)"
)
def boundary_summary(s, sf):
    return E.boundary_summary(*boundaries(s, sf)).select("dataset", r6("mean_error"), "missed", "extra", "early_false")


@query(THRESHOLDS + " SELECT dataset, min(center_cycle) FILTER (round(awr, 9) >= round(ta, 9)) AS first_high, min(center_cycle) FILTER (round(bd, 9) >= round(3 * tb, 9)) AS first_far FROM sc JOIN th USING (dataset) GROUP BY 1")
def first_cycle(s, sf):
    """The first cycle at which a condition holds; null where it never does."""
    sc = B.scores(s, sf)
    at = lambda c: F.round(c, 9)
    first = lambda ok: F.min(F.when(ok, F.col("center_cycle")))
    return sc.join(thresholds(sc), "dataset").groupBy("dataset").agg(first(at("awr") >= at("ta")).alias("first_high"), first(at("bd") >= at(3 * F.col("tb"))).alias("first_far"))


# ================================================================== audits of pairs, states, labels and supports


@query(
    ", n2 AS (SELECT dataset, count(*) AS n FROM sc GROUP BY 1), pt AS (SELECT sc.dataset, window_index, start_cycle <= floor(end_cycle / 500) * 500 + 100 AS guard, CASE WHEN window_index < floor(n * 0.7) THEN 'train' WHEN window_index >= floor(n * 0.7) + 20 THEN 'validation' ELSE 'embargo' END AS part FROM sc JOIN n2 USING (dataset)), "
    "pa AS (SELECT a.dataset, a.part, a.window_index AS i, b.window_index AS j FROM pt a JOIN pt b ON b.dataset = a.dataset AND b.window_index = a.window_index + 40 AND b.part = a.part WHERE a.part <> 'embargo' AND NOT a.guard AND NOT b.guard), "
    "en AS (SELECT DISTINCT dataset, part, unnest([i, j]) AS w FROM pa), sh AS (SELECT dataset, count(*) AS shared FROM (SELECT dataset, w FROM en GROUP BY ALL HAVING count(DISTINCT part) > 1) GROUP BY 1) "
    "SELECT dataset, count(*) FILTER (part = 'train') AS train_pairs, count(*) FILTER (part = 'validation') AS validation_pairs, coalesce(any_value(shared), 0)::BIGINT AS shared_endpoints, count(*) FILTER (j - i <> 40) AS bad_gaps FROM pa LEFT JOIN sh USING (dataset) GROUP BY dataset"
)
def pair_audit(s, sf):
    """Pairs of both sides of a chronological split: counts, endpoints on both sides (none), gaps out of bounds (none)."""
    rows = S.chrono_split(B.scores(s, sf)).withColumn("guard", S.guard_overlap(F.col("start_cycle"), F.col("end_cycle"))).where("part <> 'embargo' and guard = 0").select("dataset", "part", "window_index")
    later = rows.select("dataset", "part", (F.col("window_index") - 40).alias("window_index"), F.col("window_index").alias("j"))
    pairs = rows.join(later, ["dataset", "part", "window_index"])
    ends = pairs.select("dataset", "part", F.explode(F.array("window_index", "j")).alias("w")).distinct()
    shared = ends.groupBy("dataset", "w").agg(F.count("*").alias("c")).where("c > 1").groupBy("dataset").agg(F.count("*").alias("_s"))
    is_ = lambda p: F.sum((F.col("part") == p).cast("long"))
    got = pairs.groupBy("dataset").agg(is_("train").alias("train_pairs"), is_("validation").alias("validation_pairs"), F.sum((F.col("j") - F.col("window_index") != 40).cast("long")).alias("bad_gaps"))
    return got.join(shared, "dataset", "left").select("dataset", "train_pairs", "validation_pairs", F.coalesce("_s", F.lit(0)).alias("shared_endpoints"), "bad_gaps")


@query(f", g AS (SELECT dataset, window_index, CAST(1 + greatest(0, least(4, floor(round(bd, 6)))) AS INTEGER) AS state FROM sc) SELECT dataset, window_index, state, coalesce(abs(state - lag(state) {OV}) <= 1, true) AS compatible FROM g")
def state_jumps(s, sf):
    """States may move by one step at a time; the first one always may."""
    state = (1 + F.greatest(F.lit(0), F.least(F.lit(4), F.floor(F.round("bd", 6))))).cast("int")
    rows = frame(s, sf, {"_was": lambda w: F.lag("state").over(w)}, 1, B.scores(s, sf).withColumn("state", state))
    return rows.select("dataset", "window_index", "state", F.coalesce(F.abs(F.col("state") - F.col("_was")) <= 1, F.lit(True)).alias("compatible"))


@query(" SELECT dataset, window_index, round(awr, 6) AS awr, stage FROM sc")
def late_labels(s, sf):
    """Labels are attached after scoring, by key; the scored rows have none."""
    sc = B.scores(s, sf)
    scored = S.forbid_columns(S.drop_labels(sc))
    return scored.join(sc.select("dataset", "window_index", "stage"), ["dataset", "window_index"], "left").select("dataset", "window_index", r6("awr"), "stage")


@query(f", f AS (SELECT dataset, window_index, CASE WHEN baseline_window = 1 THEN NULL ELSE center_cycle END AS a, lag(center_cycle) {OV} AS b, start_cycle::DOUBLE AS c FROM sc) SELECT dataset, window_index, coalesce(a, b, c) AS mapped FROM f")
def mapped_fallback(s, sf):
    """The first mapping that is there."""
    rows = frame(s, sf, {"_b": lambda w: F.lag("center_cycle").over(w)}, 1)
    return rows.select("dataset", "window_index", F.coalesce(F.when(F.col("baseline_window") != 1, F.col("center_cycle")), F.col("_b"), F.col("start_cycle").cast("double")).alias("mapped"))


@query(
    ", li AS (SELECT dataset, feature_name, quantile_cont(z_value, 0.01) AS p01, quantile_cont(z_value, 0.99) AS p99 FROM z WHERE baseline_window = 1 GROUP BY ALL), fl AS (SELECT z.dataset, window_index, "
    "CASE WHEN round(z_value, 9) < round(p01, 9) OR round(z_value, 9) > round(p99, 9) THEN 1 ELSE 0 END AS out, CASE feature_name WHEN 'x_mean' THEN 0.6 WHEN 'x_rms' THEN 0.4 ELSE 0.0 END AS wc, CASE feature_name WHEN 'x_p2p' THEN 0.5 ELSE 0.25 END AS wb FROM z JOIN li USING (dataset, feature_name)) "
    "SELECT dataset, window_index, sum(out)::BIGINT AS outside, round(sum(out * wc)::DOUBLE, 6) AS oos_common, round(sum(out * wb)::DOUBLE, 6) AS oos_branch, round(1 - sum(out * wc)::DOUBLE, 6) AS confidence_common, round(1 - sum(out * wb)::DOUBLE, 6) AS confidence_branch FROM fl GROUP BY ALL"
)
def weighted_support(s, sf):
    """Out-of-support flags weighed by the common and the branch axis, and the confidences that they leave."""
    z = B.z_long(s, sf)
    limits = z.where("baseline_window = 1").groupBy("dataset", "feature_name").agg(M.med("z_value", 0.01).alias("p01"), M.med("z_value", 0.99).alias("p99"))
    at = lambda c: F.round(c, 9)
    out = ((at("z_value") < at("p01")) | (at("z_value") > at("p99"))).cast("int")
    f = F.col("feature_name")
    common, branch = F.when(f == "x_mean", 0.6).when(f == "x_rms", 0.4).otherwise(0.0), F.when(f == "x_p2p", 0.5).otherwise(0.25)
    got = z.join(limits, ["dataset", "feature_name"]).groupBy("dataset", "window_index").agg(F.sum(out).alias("outside"), F.sum(out * common).alias("c"), F.sum(out * branch).alias("b"))
    return got.select("dataset", "window_index", "outside", r6("c", "oos_common"), r6("b", "oos_branch"), r6(1 - F.col("c"), "confidence_common"), r6(1 - F.col("b"), "confidence_branch"))


SETS = [("F1", ["x_mean"]), ("F2", ["x_mean", "x_rms"]), ("F3", ["x_mean", "x_p2p"]), ("F4", ["x_mean", "x_rms", "x_p2p"]), ("F5", ["x_mean", "x_rms"]), ("F6", ["x_rms", "x_p2p"])]


@query(
    ", el AS (SELECT dataset, feature_name FROM lo GROUP BY ALL HAVING avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.99 AND count(DISTINCT round(value, 12)) >= 20 AND quantile_cont(value, 0.99) - quantile_cont(value, 0.01) > 1e-6 AND quantile_cont(value, 0.75) - quantile_cont(value, 0.25) > 1e-6), "
    "de AS (SELECT * FROM (VALUES (0,'F1',0,'x_mean'),(1,'F2',0,'x_mean'),(1,'F2',1,'x_rms'),(2,'F3',0,'x_mean'),(2,'F3',1,'x_p2p'),(3,'F4',0,'x_mean'),(3,'F4',1,'x_rms'),(3,'F4',2,'x_p2p'),(4,'F5',0,'x_mean'),(4,'F5',1,'x_rms'),(5,'F6',0,'x_rms'),(5,'F6',1,'x_p2p')) t(k, candidate_set, i, feature_name)), "
    "cs AS (SELECT dataset, k, candidate_set, string_agg(feature_name, ';' ORDER BY i) AS features, count(*) AS feature_count FROM de JOIN el USING (feature_name) GROUP BY ALL HAVING bool_or(feature_name = 'x_mean')) "
    "SELECT dataset, candidate_set, features, feature_count FROM cs QUALIFY row_number() OVER (PARTITION BY dataset, features ORDER BY k) = 1"
)
def candidate_sets(s, sf):
    return E.candidate_sets(S.support_filter(B.long_features(s, sf)).where("eligible = 1"), SETS, "x_mean")


@query(" SELECT DISTINCT feature_name FROM lo")
def feature_pool(s, sf):
    return B.long_features(s, sf).dropDuplicates(["feature_name"]).select("feature_name")


@query(" SELECT dataset, window_index, round(z_x_mean, 6) AS z_x_mean, round(z_x_rms, 6) AS z_x_rms, round(z_x_p2p, 6) AS z_x_p2p FROM sc")
def regex_columns(s, sf):
    """Columns by a pattern, as compact state tables are cut."""
    sc = B.scores(s, sf)
    wide = sc.select("dataset", "window_index", sc.colRegex("`z_.*`"))
    return wide.select("dataset", "window_index", *[r6(c) for c in wide.columns if c.startswith("z_")])


@query(
    ", di AS (SELECT dataset, feature_name, median(z_value) FILTER (stage = 5) - median(z_value) FILTER (stage = 1) AS d FROM z GROUP BY ALL) SELECT dataset, feature_name, CASE WHEN d IS NULL THEN 'missing' WHEN round(d, 9) >= 0 THEN 'increase' ELSE 'decrease' END AS direction, "
    "CASE WHEN feature_name IN ('x_mean', 'x_rms') THEN 'amplitude' ELSE 'span' END AS family, CASE WHEN abs(round(d, 9)) >= 1 THEN 'High' WHEN abs(round(d, 9)) >= 0.3 THEN 'Medium' ELSE 'Low' END AS priority FROM di"
)
def audit_labels(s, sf):
    """Words for what an audit found: direction, family and priority of a feature."""
    d = M.direction_signs(B.z_long(s, sf)).withColumn("d", F.round("delta", 9))
    direction = F.when(F.col("d").isNull(), "missing").when(F.col("d") >= 0, "increase").otherwise("decrease")
    size = F.abs("d")
    return d.select("dataset", "feature_name", direction.alias("direction"), F.when(F.col("feature_name").isin("x_mean", "x_rms"), "amplitude").otherwise("span").alias("family"), F.when(size >= 1, "High").when(size >= 0.3, "Medium").otherwise("Low").alias("priority"))


# ================================================================== pruning, axes, anchors, benefit


DIRECT = {"z_x_mean": 2, "z_x_rms": 1, "z_x_p2p": 1}


def _prune_sql(limit: float) -> str:
    """The greedy steps, pair by pair, written out for the three features."""
    pairs = [("z_x_mean", "z_x_rms"), ("z_x_mean", "z_x_p2p"), ("z_x_rms", "z_x_p2p")]
    areas = ", ".join(f"max(auroc) FILTER (model_name = '{f}') AS a_{f}" for f in Z)
    sql = f", fa AS (SELECT dataset, {areas} FROM ev4 GROUP BY 1), s0 AS (SELECT fa.*, " + ", ".join(f"(SELECT abs(corr({a}, {b})) FROM sc WHERE sc.dataset = fa.dataset) AS c_{a}__{b}" for a, b in pairs)
    sql += ", " + ", ".join(f"true AS k_{f}, '' AS b_{f}" for f in Z) + " FROM fa)"
    for i, (a, b) in enumerate(pairs):
        tie = DIRECT[a] > DIRECT[b] if DIRECT[a] != DIRECT[b] else a < b
        first = f"CASE WHEN abs(a_{a} - a_{b}) >= 0.005 THEN a_{a} > a_{b} ELSE {str(tie).lower()} END"
        hit = f"k_{a} AND k_{b} AND c_{a}__{b} >= {limit}"
        sql += f", s{i + 1} AS (SELECT * REPLACE (k_{a} AND NOT ({hit} AND NOT {first}) AS k_{a}, k_{b} AND NOT ({hit} AND {first}) AS k_{b}, CASE WHEN {hit} AND NOT {first} THEN '{b}' ELSE b_{a} END AS b_{a}, CASE WHEN {hit} AND {first} THEN '{a}' ELSE b_{b} END AS b_{b}) FROM s{i})"
    return sql + " " + " UNION ALL ".join(f"SELECT dataset, '{f}' AS feature_name, CASE WHEN k_{f} THEN 1 ELSE 0 END AS kept, b_{f} AS correlated_with FROM s3" for f in Z)


FEATURE_AUC = (
    ", ml4 AS (" + " UNION ALL ".join(f"SELECT '{f}' AS model_name, dataset, CASE WHEN stage = 5 THEN 1 ELSE 0 END AS late, round({f}, 9) AS score FROM sc" for f in Z) + "), "
    "mr4 AS (SELECT *, rank() OVER (PARTITION BY model_name, dataset ORDER BY score) + (count(*) OVER (PARTITION BY model_name, dataset, score) - 1) / 2.0 AS r FROM ml4), "
    "ev4 AS (SELECT model_name, dataset, greatest(a, 1 - a) AS auroc FROM (SELECT model_name, dataset, (sum(r * late) - sum(late) * (sum(late) + 1) / 2) / (sum(late) * (count(*) - sum(late))) AS a FROM mr4 GROUP BY ALL))"
)


@query(FEATURE_AUC + _prune_sql(0.3))
def feature_pruning(s, sf):
    """Of correlated features the better, then the more direct one stays."""
    sc = B.scores(s, sf)
    area = E.evaluate_models(E.model_rows(sc, {f: f for f in Z}, ["dataset", "stage"])).withColumn("auroc", F.greatest(F.col("auroc"), 1 - F.col("auroc")))
    wide = area.groupBy("dataset").agg(*[F.max(F.when(F.col("model_name") == f, F.col("auroc"))).alias(f) for f in Z])
    return E.prune_correlated(sc, ["dataset"], Z, wide, 0.3, DIRECT)


AXIS_SQL = (
    ", dd AS (SELECT dataset, feature_name, median(z_value) FILTER (stage = 5) - median(z_value) FILTER (stage = 1) AS d FROM z GROUP BY ALL), na AS (SELECT min(dataset) AS one, max(dataset) AS two FROM dd), "
    "ww AS (SELECT a.feature_name, a.d AS one, b.d AS two FROM na JOIN dd a ON a.dataset = na.one JOIN dd b ON b.dataset = na.two AND b.feature_name = a.feature_name), "
    "rw AS (SELECT *, CASE WHEN sign(one) = sign(two) AND one <> 0 AND greatest(abs(one), abs(two)) >= 0.05 THEN 1 ELSE 0 END AS kept FROM ww), rx AS (SELECT *, CASE WHEN kept = 1 THEN sign(one) * sqrt(abs(one) * abs(two)) ELSE 0 END AS raw FROM rw), "
    "ca AS (SELECT *, coalesce(raw / nullif((SELECT sum(abs(raw)) FROM rx), 0), 0) AS weight FROM rx)"
)


def axis_weights(s, sf) -> DataFrame:
    """Median shifts of each feature in the first and the last stream by name."""
    d = M.direction_signs(B.z_long(s, sf)).select("dataset", "feature_name", "delta")
    ends = d.agg(F.min("dataset"), F.max("dataset")).first()  # two names
    return d.groupBy("feature_name").agg(*[F.max(F.when(F.col("dataset") == name, F.col("delta"))).alias(x) for x, name in zip(("one", "two"), ends, strict=True)])


@query(AXIS_SQL + " SELECT feature_name, round(one, 6) AS one, round(two, 6) AS two, kept, round(weight, 6) AS weight FROM ca")
def common_axis(s, sf):
    return E.common_axis(axis_weights(s, sf)).select("feature_name", r6("one"), r6("two"), "kept", r6("weight"))


@query(
    AXIS_SQL + ", bs AS (SELECT sqrt(sum(weight * weight)) AS q, sum(one * weight) AS s1, sum(two * weight) AS s2 FROM ca), br AS (SELECT feature_name, one AS d1, two AS d2, one - weight / q * (s1 / q) AS r1, two - weight / q * (s2 / q) AS r2 FROM ca, bs), "
    "bw AS (SELECT *, r2 - r1 AS raw FROM br) SELECT feature_name, round(r1, 6) AS residual1, round(r2, 6) AS residual2, round(raw / ((SELECT sqrt(sum(raw * raw)) FROM bw) + 1e-9), 6) AS weight FROM bw"
)
def branch_axis(s, sf):
    axis = E.common_axis(axis_weights(s, sf)).select("feature_name", F.col("one").alias("d1"), F.col("two").alias("d2"), F.col("weight").alias("axis"))
    return E.branch_axis(axis).select("feature_name", r6("residual1"), r6("residual2"), r6("weight"))


@query(
    ", rw AS (SELECT dataset, window_index, baseline_window, 0.5 * z_x_mean + 0.3 * z_x_rms + 0.2 * z_x_p2p AS raw FROM sc), an AS (SELECT dataset, median(raw) FILTER (baseline_window = 1) AS anchor, greatest(quantile_cont(raw, 0.75) FILTER (baseline_window = 1) - quantile_cont(raw, 0.25) FILTER (baseline_window = 1), "
    "0.25 * (quantile_cont(raw, 0.75) - quantile_cont(raw, 0.25)), 1e-6) AS scale FROM rw GROUP BY 1) SELECT dataset, window_index, round(raw - anchor, 6) AS relative, round((raw - anchor) / scale, 6) AS scaled FROM rw JOIN an USING (dataset)"
)
def score_anchor(s, sf):
    rows = B.scores(s, sf).withColumn("raw", A.weighted({"z_x_mean": 0.5, "z_x_rms": 0.3, "z_x_p2p": 0.2}))
    return E.anchored(rows, "raw", F.col("baseline_window") == 1).select("dataset", "window_index", r6("relative"), r6("scaled"))


@query(
    f", fc AS (SELECT dataset, window_index, awr, lag(awr, 10) {OV} AS was FROM sc), du AS (SELECT f.dataset, h.h AS horizon, abs(t.awr - f.awr) AS frozen, abs(t.awr - (f.awr + (f.awr - f.was) / 10 * h.h)) AS online FROM fc f, (SELECT unnest([10, 20, 40]) AS h) h JOIN sc t ON t.dataset = f.dataset AND t.window_index = f.window_index + h.h WHERE f.was IS NOT NULL), "
    "ms AS (SELECT dataset, horizon, avg(frozen) AS f, avg(online) AS o FROM du GROUP BY ALL) SELECT dataset, count(*) FILTER (o <= 0.95 * f) AS beneficial, round(avg(f), 6) AS frozen_mae, round(avg(o), 6) AS online_mae, CASE WHEN count(*) FILTER (o <= 0.95 * f) >= 2 THEN 'PASS' ELSE 'FAIL' END AS status FROM ms GROUP BY 1"
)
def online_benefit(s, sf):
    """Mean absolute errors of an online and a frozen forecast by horizon, and whether the online one helps at enough of them."""
    f = frame(s, sf, {"was": lambda w: F.lag("awr", 10).over(w)}, 10).where("was is not null").select("dataset", "window_index", "awr", "was")
    due = f.withColumn("horizon", F.explode(F.array(*map(F.lit, (10, 20, 40))))).withColumn("online", F.col("awr") + (F.col("awr") - F.col("was")) / 10 * F.col("horizon"))
    due = due.select("dataset", "horizon", (F.col("window_index") + F.col("horizon")).alias("window_index"), F.col("awr").alias("frozen"), "online")
    rows = due.join(B.scores(s, sf).select("dataset", "window_index", F.col("awr").alias("truth")), ["dataset", "window_index"])
    per = rows.groupBy("dataset", "horizon").agg(F.avg(F.abs(F.col("truth") - F.col("frozen"))).alias("f"), F.avg(F.abs(F.col("truth") - F.col("online"))).alias("o"))
    good = F.sum((F.col("o") <= 0.95 * F.col("f")).cast("long"))
    return per.groupBy("dataset").agg(good.alias("beneficial"), r6(F.avg("f"), "frozen_mae"), r6(F.avg("o"), "online_mae"), F.when(good >= 2, "PASS").otherwise("FAIL").alias("status"))


@query(f" SELECT dataset, window_index, round(median(awr) OVER (PARTITION BY dataset ORDER BY window_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS smoothed FROM sc")
def smoothed_score(s, sf):
    """Causal smoothing of the selected score over five windows."""
    return frame(s, sf, {"smoothed": R.rolling_median("awr", 5)}, 4).select("dataset", "window_index", r6("smoothed"))


# ================================================================== summaries, categories, ablations, contexts


SUMMARY = ["awr", "bd", *Z]


@query(
    THRESHOLDS + " SELECT sc.dataset, stage, count(*) AS n, " + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_{n}" for c in SUMMARY for q, n in ((0.1, "p10"), (0.5, "median"), (0.9, "p90")))
    + ", round(avg(CASE WHEN round(awr, 9) >= round(ta, 9) THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS high_rate, count(*) FILTER (round(awr, 9) >= round(ta, 9) AND round(bd, 9) >= round(tb, 9)) AS high_pairs FROM sc JOIN th USING (dataset) GROUP BY sc.dataset, stage"
)
def stage_state_summary(s, sf):
    """Quantiles of all scores by stream and stage, and how often they are high."""
    sc = B.scores(s, sf)
    at = lambda c: F.round(c, 9)
    high, both = at("awr") >= at("ta"), (at("awr") >= at("ta")) & (at("bd") >= at("tb"))
    quantiles = [r6(M.med(c, q), f"{c}_{n}") for c in SUMMARY for q, n in ((0.1, "p10"), (0.5, "median"), (0.9, "p90"))]
    return sc.join(thresholds(sc), "dataset").groupBy("dataset", "stage").agg(F.count("*").alias("n"), *quantiles, r6(F.avg(high.cast("double")), "high_rate"), F.sum(both.cast("long")).alias("high_pairs"))


@query(f", v AS (SELECT *, abs(bd - lag(bd) {OV}) AS d, start_cycle <= floor(end_cycle / 500) * 500 + 100 AS guard FROM sc) SELECT dataset, round(abs(median(awr) FILTER (baseline_window = 1 AND NOT guard)), 6) AS baseline_drift, round(median(bd) FILTER (baseline_window = 1 AND NOT guard), 6) AS baseline_distance, round(median(d), 6) AS volatility FROM v GROUP BY 1")
def frozen_summary(s, sf):
    """How far the unguarded baseline drifted, and how volatile the distance is."""
    rows = frame(s, sf, {"_was": lambda w: F.lag("bd").over(w)}, 1).withColumn("guard", S.guard_overlap(F.col("start_cycle"), F.col("end_cycle")))
    base = (F.col("baseline_window") == 1) & (F.col("guard") == 0)
    return rows.groupBy("dataset").agg(r6(F.abs(M.med(F.when(base, F.col("awr")))), "baseline_drift"), r6(M.med(F.when(base, F.col("bd"))), "baseline_distance"), r6(M.med(F.abs(F.col("bd") - F.col("_was"))), "volatility"))


CATEGORIES = {"high_high": ("a >= a90 AND b >= b90", "a + b"), "high_low": ("a >= a90 AND b <= b50", "a - b"), "low_high": ("a <= a50 AND b >= b90", "b - a"), "late_high": ("stage = 5 AND a >= a75", "a")}


@query(
    ", rr AS (SELECT dataset, window_index, stage, round(awr, 9) AS a, round(bd, 9) AS b FROM sc), qq AS (SELECT dataset, " + ", ".join(f"round(quantile_cont({c}, {q / 100}), 9) AS {c}{q}" for c in "ab" for q in (50, 75, 90)) + " FROM rr GROUP BY 1), ct AS ("
    + " UNION ALL ".join(f"SELECT dataset, '{k}' AS category, window_index, round({v}, 9) AS score FROM rr JOIN qq USING (dataset) WHERE {w}" for k, (w, v) in CATEGORIES.items())
    + ") SELECT dataset, category, count(*) AS n, arg_min(window_index, {'s': -score, 'w': window_index}) AS best_window, round(max(score), 6) AS best_score FROM ct GROUP BY ALL"
)
def candidate_categories(s, sf):
    """Windows by category, from quantiles of each stream: how many, and the best one."""
    rows = B.scores(s, sf).select("dataset", "window_index", "stage", F.round("awr", 9).alias("a"), F.round("bd", 9).alias("b"))
    q = rows.groupBy("dataset").agg(*[F.round(M.med(c, k / 100), 9).alias(f"{c}{k}") for c in "ab" for k in (50, 75, 90)])
    kinds = F.array(*[F.when(F.expr(w), F.struct(F.lit(k).alias("category"), F.round(F.expr(v), 9).alias("score"))) for k, (w, v) in CATEGORIES.items()])
    found = rows.join(q, "dataset").withColumn("_c", F.explode(F.filter(kinds, lambda x: x.isNotNull()))).select("dataset", "window_index", "_c.*")
    best = F.min_by("window_index", F.struct((-F.col("score")).alias("s"), "window_index"))
    return found.groupBy("dataset", "category").agg(F.count("*").alias("n"), best.alias("best_window"), r6(F.max("score"), "best_score"))


#: Nine categories of spaced candidates: which windows, and by what score. Smoothed score p, distance b, branch c, their
#: growth gp, gb and |gc|, events t and support o; a number after a column is its quantile over the stream.
SPACED_RULES = {
    "high_P_high_BD": ("p >= p90 AND b >= b90", "p + b"), "high_BD_low_P": ("b >= b90 AND p <= p50", "b"), "stable_branch_candidate": ("c <= c10", "-c"), "severe_branch_candidate": ("c >= c90", "c"),
    "rapid_P_growth": ("gp >= gp95", "gp"), "rapid_BD_growth": ("gb >= gb95", "gb"), "branch_transition": ("gc >= gc95", "gc"), "high_TES": ("t >= t95", "t"), "high_weighted_OOS": ("o >= o95", "o"),
}
SPACED_QUANTILES = [("p", 50), ("p", 90), ("b", 90), ("c", 10), ("c", 90), ("gp", 95), ("gb", 95), ("gc", 95), ("t", 95), ("o", 95)]


def _spaced_sql() -> str:
    w20, b20 = "ROWS BETWEEN 19 PRECEDING AND CURRENT ROW", "ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING"
    grow = lambda c: f"CASE WHEN count(*) OVER f40 = 40 THEN (quantile_cont({c}, 0.5) OVER f20 - quantile_cont({c}, 0.5) OVER b20) / 20 END"
    order = "PARTITION BY dataset ORDER BY window_index"
    return (
        TES + ", li AS (SELECT dataset, feature_name, quantile_cont(z_value, 0.01) AS p01, quantile_cont(z_value, 0.99) AS p99 FROM z WHERE baseline_window = 1 GROUP BY ALL), "
        "oo AS (SELECT dataset, window_index, round(sum(CASE WHEN round(z_value, 9) < round(p01, 9) OR round(z_value, 9) > round(p99, 9) THEN CASE feature_name WHEN 'x_mean' THEN 0.6 WHEN 'x_rms' THEN 0.4 ELSE 0.0 END ELSE 0.0 END)::DOUBLE, 6) AS o FROM z JOIN li USING (dataset, feature_name) GROUP BY ALL), "
        f"va AS (SELECT dataset, window_index, start_cycle, end_cycle, center_cycle, start_cycle <= floor(end_cycle / 500) * 500 + 100 AS guard, round(quantile_cont(awr, 0.5) OVER f20, 9) AS p, round(bd, 9) AS b, round(z_x_p2p, 9) AS c, round({grow('awr')}, 9) AS gp, round({grow('bd')}, 9) AS gb, round(abs({grow('z_x_p2p')}), 9) AS gc "
        f"FROM sc WINDOW f20 AS ({order} {w20}), b20 AS ({order} {b20}), f40 AS ({order} ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)), "
        "vb AS (SELECT va.*, round(tes, 5) AS t, o FROM va JOIN te USING (dataset, window_index) JOIN oo USING (dataset, window_index)), "
        "vq AS (SELECT dataset, " + ", ".join(f"round(quantile_cont({c}, {q / 100}), 9) AS {c}{q}" for c, q in SPACED_QUANTILES) + " FROM vb GROUP BY 1), "
        "cd AS (" + " UNION ALL ".join(f"SELECT dataset, '{k}' AS category, window_index, start_cycle, end_cycle, center_cycle, round({v}, 9) AS score FROM vb JOIN vq USING (dataset) WHERE NOT guard AND {w}" for k, (w, v) in SPACED_RULES.items()) + "), "
        "pk AS (SELECT dataset, category, 0 AS pick, CAST(NULL AS BIGINT) AS window_index, CAST(NULL AS DOUBLE) AS score, CAST([] AS DOUBLE[]) AS taken FROM (SELECT DISTINCT dataset, category FROM cd) UNION ALL "
        "SELECT dataset, category, pick + 1, x.window_index, x.score, list_append(taken, x.center_cycle) FROM (SELECT pk.dataset, pk.category, pk.pick, pk.taken, max_by({'window_index': cd.window_index, 'score': cd.score, 'center_cycle': cd.center_cycle}, {'s': cd.score, 'w': -cd.window_index}) AS x "
        "FROM pk JOIN cd ON cd.dataset = pk.dataset AND cd.category = pk.category WHERE pk.pick < 20 AND len(list_filter(pk.taken, lambda y: abs(y - cd.center_cycle) < 500)) = 0 GROUP BY pk.dataset, pk.category, pk.pick, pk.taken)) "
        "SELECT pk.dataset, pk.category, CAST(pick AS INTEGER) AS pick, pk.window_index, round(any_value(pk.score), 5) AS score, min(cd.start_cycle) AS start_cycle, max(cd.end_cycle) AS end_cycle, count(*) AS windows FROM pk JOIN cd ON cd.dataset = pk.dataset AND cd.category = pk.category AND abs(cd.window_index - pk.window_index) <= 10 WHERE pick > 0 GROUP BY ALL"
    )


@query(_spaced_sql(), RECURSIVE)
def spaced_candidates(s, sf):
    """Candidates of nine categories, at least 500 cycles apart, at most twenty each, with the span of like windows around."""
    growth = {"gp": R.trend("awr", 20), "gb": R.trend("bd", 20), "gc": R.trend("z_x_p2p", 20), "p": R.rolling_median("awr", 20)}
    at = lambda c, n=9: F.round(c, n).alias(c)
    guard = S.guard_overlap(F.col("start_cycle"), F.col("end_cycle")).alias("guard")
    base = frame(s, sf, growth, 39).select("dataset", "window_index", "start_cycle", "end_cycle", "center_cycle", guard, at("p"), F.round("bd", 9).alias("b"), F.round("z_x_p2p", 9).alias("c"), at("gp"), at("gb"), F.round(F.abs("gc"), 9).alias("gc"))
    rows = base.join(tes_frame(s, sf).select("dataset", "window_index", F.round("tes", 5).alias("t")), ["dataset", "window_index"]).join(weighted_support(s, sf).select("dataset", "window_index", F.col("oos_common").alias("o")), ["dataset", "window_index"])
    scratch = Scratch(s, "candidates")
    rows = scratch.settle(rows, "rows")
    q = rows.groupBy("dataset").agg(*[F.round(M.med(c, k / 100), 9).alias(f"{c}{k}") for c, k in SPACED_QUANTILES])
    kinds = F.array(*[F.when(F.expr(w), F.struct(F.lit(k).alias("category"), F.round(F.expr(v), 9).alias("score"))) for k, (w, v) in SPACED_RULES.items()])
    found = rows.where("guard = 0").join(q, "dataset").withColumn("_c", F.explode(F.filter(kinds, lambda x: x.isNotNull())))
    found = scratch.settle(found.select(F.concat_ws("|", "dataset", "_c.category").alias("dataset"), "window_index", "start_cycle", "end_cycle", "center_cycle", "_c.score"), "found")
    picks = K.spaced_top(found, "score", 20, 500.0).select("dataset", "pick", F.col("window_index").alias("peak"), "score")
    near = picks.withColumn("window_index", F.explode(F.sequence(F.col("peak") - 10, F.col("peak") + 10)))
    spans = near.join(found.drop("score"), ["dataset", "window_index"]).groupBy("dataset", "pick", "peak", "score").agg(F.min("start_cycle").alias("start_cycle"), F.max("end_cycle").alias("end_cycle"), F.count("*").alias("windows"))
    name = F.split("dataset", r"\|")
    return scratch.last(spans.select(F.get(name, 0).alias("dataset"), F.get(name, 1).alias("category"), "pick", F.col("peak").alias("window_index"), F.round("score", 5).alias("score"), "start_cycle", "end_cycle", "windows"))


GROUPS = {"all": Z, "amplitude": Z[:2], "span": Z[2:], "no_mean": Z[1:]}
GROUP_SQL = "UNION ALL ".join(f"SELECT '{g}' AS feature_group, dataset, stage, round(({' + '.join(f)}) / {len(f)}, 9) AS score FROM sc " for g, f in GROUPS.items())


@query(
    f", gr AS ({GROUP_SQL}), gk AS (SELECT *, CASE WHEN stage = 5 THEN 1 ELSE 0 END AS late, rank() OVER (PARTITION BY feature_group, dataset ORDER BY score) + (count(*) OVER (PARTITION BY feature_group, dataset, score) - 1) / 2.0 AS r FROM gr), "
    "ga AS (SELECT feature_group, dataset, (sum(r * late) - sum(late) * (sum(late) + 1) / 2) / (sum(late) * (count(*) - sum(late))) AS auroc FROM gk GROUP BY ALL) SELECT feature_group, round(avg(auroc), 6) AS mean_auroc, round(min(auroc), 6) AS worst_auroc FROM ga GROUP BY 1"
)
def ablation_groups(s, sf):
    """Mean scores of feature groups, compared over the streams."""
    sc = B.scores(s, sf).withColumns({f"g_{g}": sum((F.col(c) for c in f[1:]), F.col(f[0])) / len(f) for g, f in GROUPS.items()})
    got = E.compare_models(E.evaluate_models(E.model_rows(sc, {g: f"g_{g}" for g in GROUPS}, ["dataset", "stage"])), ["auroc"])
    return got.select(F.col("model_name").alias("feature_group"), r6("mean_auroc"), r6("worst_auroc"))


@query(" SELECT dataset, feature_name, round(0.5 * median(z_value) FILTER (stage = 1), 6) AS early, round(0.5 * median(z_value) FILTER (stage = 5), 6) AS late, round(0.5 * median(z_value) FILTER (stage = 5) - 0.5 * median(z_value) FILTER (stage = 1), 6) AS gap FROM z GROUP BY ALL")
def ablation_contributions(s, sf):
    """Contributions of a feature in the first and the last stage, and their gap."""
    d = M.direction_signs(B.z_long(s, sf))
    return d.select("dataset", "feature_name", r6(0.5 * F.col("early"), "early"), r6(0.5 * F.col("late"), "late"), r6(0.5 * F.col("late") - 0.5 * F.col("early"), "gap"))


@query(
    ", ci AS (SELECT dataset, " + ", ".join(f"least(3, 5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))) AS cap_{c}" for c in Z) + " FROM sc GROUP BY 1) SELECT dataset, window_index, round(1 / (1 + exp(-greatest(-35, least(35, "
    + " + ".join(f"least(4.0, cap_{c}) * {c}" for c in Z) + " - 1)))), 6) AS probability FROM sc JOIN ci USING (dataset)"
)
def capped_head(s, sf):
    """A static head whose coefficients are capped by the spread of their features: min(3, 5 IQR)."""
    sc = B.scores(s, sf)
    caps = sc.groupBy("dataset").agg(*[F.least(F.lit(3.0), 5 * (M.med(c, 0.75) - M.med(c, 0.25))).alias(f"_{c}") for c in Z])
    total = sum((F.least(F.lit(4.0), F.col(f"_{c}")) * F.col(c) for c in Z), F.lit(-1.0))
    return sc.join(caps, "dataset").select("dataset", "window_index", r6(A.sigmoid(total), "probability"))


@query(" SELECT dataset, count(*) AS n, count(*) FILTER (x IS NULL) AS missing, count(*) - count(DISTINCT event_id) AS repeated, min(cycle) AS first_cycle, max(cycle) AS last_cycle, bool_and(cycle BETWEEN 1 AND n) AS in_range FROM st GROUP BY 1")
def stream_audit(s, sf):
    """Rows, missing values, repeated keys and numbering of each stream."""
    e = B.stream_events(s, sf)
    n = F.count("*")
    return e.groupBy("dataset").agg(n.alias("n"), F.sum(F.col("x").isNull().cast("long")).alias("missing"), (n - F.count_distinct("event_id")).alias("repeated"), F.min("cycle").alias("first_cycle"), F.max("cycle").alias("last_cycle"), F.min(F.col("cycle").between(1, F.col("n"))).alias("in_range"))


@query(
    MODEL_SQL + ", ac AS (SELECT max(worst_auroc) FILTER (model_name = 'mean_z') AS w, max(mean_auroc) FILTER (model_name = 'mean_z') AS m, max(mean_score_gap) FILTER (model_name = 'mean_z') AS g FROM cm) "
    "SELECT 'worst_above_half' AS criterion, round(w, 6) AS value, CASE WHEN round(w, 6) >= 0.5 THEN 'PASS' ELSE 'FAIL' END AS status FROM ac UNION ALL SELECT 'mean_above_half', round(m, 6), CASE WHEN round(m, 6) >= 0.5 THEN 'PASS' ELSE 'FAIL' END FROM ac UNION ALL SELECT 'gap_positive', round(g, 6), CASE WHEN round(g, 6) > 0 THEN 'PASS' ELSE 'FAIL' END FROM ac"
)
def acceptance(s, sf):
    """Criteria over the compared models, each with its value and verdict."""
    one = compared(s, sf).where("model_name = 'mean_z'")
    rules = [("worst_above_half", "worst_auroc", lambda v: v >= 0.5), ("mean_above_half", "mean_auroc", lambda v: v >= 0.5), ("gap_positive", "mean_score_gap", lambda v: v > 0)]
    rows = F.array(*[F.struct(F.lit(n).alias("criterion"), F.round(c, 6).alias("value"), F.when(ok(F.round(c, 6)), "PASS").otherwise("FAIL").alias("status")) for n, c, ok in rules])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")
