"""Fitted heads and resampling: bounded risk heads over grids, rank heads, and their bootstraps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.operators import bootstrap as Q
from strandline.operators import evaluation as E
from strandline.operators import metrics as M
from strandline.operators import models as L
from strandline.operators import streams as S
from strandline.operators.logistic import Cells, fit_cells
from strandline.plans import base as B
from strandline.plans.base import SQL_WAVES, r6
from strandline.plans.catalog import directions, query
from strandline.plans.evaluation import SETS
from strandline.sources import tables as T
from strandline.sources.shared import Scratch

Z = [f"z_{f}" for f in B.FEATURES]
#: Grids, caps and weights of the heads. Fixed values.
SOFT_L2, SOFT_CAP = (0.1, 0.5, 1.0, 2.0, 5.0), 5.0
CAPPED_L2, MOST_STANDARDIZED, MOST_EFFECTIVE = (0.05, 0.1, 0.5, 1.0, 2.0), 3.0, 5.0
SUM_L2, POSITIVE_WEIGHT = 0.01, 4.0
RANK_C = (0.01, 0.05, 0.1, 0.5, 1.0, 5.0)
RANK_GAP, GRID_GAP, REPEATS, RANK_BLOCK = 100, 50, 200, 50
SEED = 5

# ------------------------------------------------------------------ bootstrap of direction signs


@query(
    ", s15 AS (SELECT dataset, stage, window_index, z_x_mean, z_x_rms, z_x_p2p FROM sc WHERE stage IN (1, 5)), lo15 AS (SELECT dataset, stage, window_index, 'z_x_mean' AS feature_name, round(z_x_mean, 9) AS v FROM s15 UNION ALL SELECT dataset, stage, window_index, 'z_x_rms', round(z_x_rms, 9) FROM s15 UNION ALL SELECT dataset, stage, window_index, 'z_x_p2p', round(z_x_p2p, 9) FROM s15), "
    "bb AS (SELECT *, (window_index - min(window_index) OVER (PARTITION BY dataset, stage)) // 20 AS block FROM lo15), bl AS (SELECT DISTINCT dataset, stage, block FROM bb), "
    f"wt AS (SELECT dataset, stage, block, r, {Q.draw_sql(SEED, 'stage', 'r', 'block')} AS w FROM bl, (SELECT unnest(range(500)) AS r)), "
    "cu AS (SELECT dataset, stage, feature_name, r, v, sum(w) OVER (PARTITION BY dataset, stage, feature_name, r ORDER BY v, block ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY dataset, stage, feature_name, r) AS n FROM (SELECT bb.*, r, w FROM bb JOIN wt USING (dataset, stage, block))), "
    "me AS (SELECT dataset, stage, feature_name, r, (min(v) FILTER (upto >= (n + 1) // 2 AND n > 0) + min(v) FILTER (upto >= n // 2 + 1)) / 2 AS m FROM cu GROUP BY ALL), "
    "sh AS (SELECT dataset, feature_name, r, max(m) FILTER (stage = 5) - max(m) FILTER (stage = 1) AS d FROM me GROUP BY ALL), "
    "fu AS (SELECT dataset, feature_name, median(v) FILTER (stage = 5) - median(v) FILTER (stage = 1) AS d FROM bb GROUP BY ALL), si AS (SELECT dataset, feature_name, CASE WHEN abs(d) < 0.05 THEN 0 ELSE sign(d) END AS g FROM fu) "
    "SELECT dataset, feature_name, CAST(g AS INTEGER) AS direction_sign, CASE WHEN g = 0 THEN 0 ELSE round(count(*) FILTER (sign(d) = g) / 500.0, 6) END AS stability FROM sh JOIN si USING (dataset, feature_name) GROUP BY dataset, feature_name, g"
)
def bootstrap_stability(s, sf):
    """Share of 500 block-bootstrap replicates in which the early-to-late shift of a feature keeps its sign."""
    rows = B.scores(s, sf).select("dataset", "stage", "window_index", F.explode(F.array(*[F.struct(F.lit(f).alias("feature_name"), F.round(f, 9).alias("v")) for f in Z])).alias("_f"))
    got = Q.direction_stability(rows.select("dataset", "stage", "window_index", "_f.*"), F.col("v"), 500, 20, SEED)
    return got.select("dataset", "feature_name", "direction_sign", r6("stability"))


# ------------------------------------------------------------------ risk heads


def guarded(s, sf) -> DataFrame:
    sc = B.scores(s, sf)
    return sc.withColumn("guard", S.guard_overlap(F.col("start_cycle"), F.col("end_cycle")))


def risk_rows(s, sf) -> DataFrame:
    """Unguarded windows with part (train, validation), soft label and weight of their stage."""
    rows = S.stage_split(guarded(s, sf), gap=4).where("guard = 0")
    return rows.withColumns({"soft": A.mapped(F.col("stage"), A.SOFT_LABELS), "weight": A.mapped(F.col("stage"), A.SOFT_WEIGHTS), "late": (F.col("stage") == 5).cast("int")})


def standardized(rows: DataFrame, features: list[str], eps: float = 1e-9) -> tuple[DataFrame, pd.DataFrame]:
    """Rows centred and scaled by the medians and quartile ranges of their stream's training rows, and those widths."""
    stats = rows.where("part = 'train'").groupBy("dataset").agg(*[x for f in features for x in (M.med(f).alias(f"_m_{f}"), F.greatest(M.med(f, 0.75) - M.med(f, 0.25), F.lit(eps)).alias(f"_i_{f}"))])
    out = rows.join(stats, "dataset").withColumns({f: (F.col(f) - F.col(f"_m_{f}")) / F.col(f"_i_{f}") for f in features})
    return out, stats.toPandas().set_index("dataset")  # a row a stream


def head_grid(rows: DataFrame, widths: pd.DataFrame, sets: list[tuple[str, list[str]]], l2: tuple[float, ...], cap) -> DataFrame:
    """Every set and ridge weight of every stream, fitted on training rows and judged on validation rows.

    A head is valid if its fit ended, no weight of an unscaled feature exceeds MOST_EFFECTIVE and it tells ten rows apart;
    the best valid one (else the best) is selected.
    """
    scratch = Scratch(rows.sparkSession, "head-grid")
    rows = scratch.settle(rows, "rows")
    names = [(c, lam) for c, _ in sets for lam in l2]
    fits = fit_cells(rows.where("part = 'train'"), ["dataset"], Z, "soft", "weight", lambda key: Cells.grid(Z, [fs for _, fs in sets], list(l2), cap(key[0])))
    scale = widths.loc[fits["dataset"], [f"_i_{f}" for f in Z]].to_numpy()
    fits["effective"] = (fits[Z].to_numpy() / scale).max(axis=1)
    fits["candidate_set"], fits["l2"] = [names[k][0] for k in fits["cell"]], [names[k][1] for k in fits["cell"]]
    heads = rows.sparkSession.createDataFrame(fits.rename(columns={f: f"b_{f}" for f in Z}))
    keys = ["dataset", "candidate_set", "l2"]
    logit = sum((F.col(f"b_{f}") * F.col(f) for f in Z), F.col("intercept"))
    judged = rows.where("part = 'validation'").join(heads.select(*keys, "intercept", *[f"b_{f}" for f in Z]), "dataset").select(*keys, "window_index", "stage", "late", "soft", F.round(logit, 9).alias("z"))
    judged = scratch.settle(judged, "judged")
    early = judged.where("stage <= 2").groupBy(*keys).agg(M.med("z", 0.9).alias("limit"))
    p = A.sigmoid(F.col("z"))
    plain = judged.join(early, keys, "left").groupBy(*keys).agg(
        F.avg((p - F.col("soft")) * (p - F.col("soft"))).alias("brier"), F.avg(F.when(F.col("stage") >= 4, (F.col("z") >= F.coalesce("limit", F.lit(float("inf")))).cast("double"))).alias("recall"), F.count_distinct(F.round("z", 9)).alias("distinct_logits")
    )
    ranked = M.auroc(judged, keys, "z", "late").join(M.average_precision(judged, keys, "z", "late", "window_index"), keys).join(M.spearman(judged, keys, "z", "stage"), keys)
    score = 0.30 * F.col("auroc") + 0.25 * F.col("average_precision") + 0.20 * F.coalesce((F.col("spearman") + 1) / 2, F.lit(0.0)) + 0.15 * (1 - F.col("brier")) + 0.10 * F.col("recall")
    out = heads.join(ranked, keys).join(plain, keys).withColumn("selection_score", score)
    out = out.withColumn("valid", F.col("success") & (F.col("effective") <= MOST_EFFECTIVE + 1e-9) & (F.col("distinct_logits") >= 10))
    out = scratch.settle(out, "heads")
    best = out.groupBy("dataset").agg(F.max_by(F.struct("candidate_set", "l2"), F.struct("valid", F.round("selection_score", 9), -F.col("l2"))).alias("_b"))
    chosen = (F.struct("candidate_set", "l2") == F.col("_b")).cast("int")
    return scratch.last(out.join(best, "dataset").select(*keys, r6("intercept"), *[r6(f"b_{f}", f"b_{f}") for f in Z], r6("effective", "max_effective_beta"), F.col("valid").cast("int").alias("valid"), r6("selection_score"), chosen.alias("selected")))


@query()
def risk_head_soft_grid(s, sf):
    """Soft-label heads of each stream over five ridge weights, coefficients in [0, 5]."""
    rows, widths = standardized(risk_rows(s, sf), Z)
    return head_grid(rows, widths, [("all", Z)], SOFT_L2, lambda _: SOFT_CAP)


@query()
def risk_head_capped_grid(s, sf):
    """Heads of each stream over feature sets and ridge weights; a weight is capped at 3 and, unscaled, at 5."""
    rows, widths = standardized(risk_rows(s, sf), Z)
    seen, sets = set(), []
    for name, fs in SETS:
        if "x_mean" in fs and tuple(fs) not in seen:
            seen.add(tuple(fs))
            sets.append((name, [f"z_{f}" for f in fs]))
    cap = lambda stream: np.minimum(MOST_STANDARDIZED, MOST_EFFECTIVE * widths.loc[stream, [f"_i_{f}" for f in Z]].to_numpy(float))
    return head_grid(rows, widths, sets, CAPPED_L2, cap)


@query()
def risk_head_sum(s, sf):
    """The first risk head of each stream: stage 5 against 1 to 3, summed loss, weights at least 0, free intercept."""
    rows = risk_rows(s, sf).where("stage <> 4").withColumn("weight", F.when(F.col("late") == 1, POSITIVE_WEIGHT).otherwise(1.0))
    rows, _ = standardized(rows, Z)
    fits = fit_cells(rows.where("part = 'train'"), ["dataset"], Z, "late", "weight", Cells.grid(Z, [Z], [SUM_L2], intercept=(-np.inf, np.inf)), summed=True)
    return s.createDataFrame(fits).select("dataset", r6("intercept"), *[r6(f"{f}", f"b_{f}") for f in Z], F.col("success").cast("int").alias("success"))


@query()
def risk_head(s, sf):
    """Coefficients of one bounded soft-label risk head over all streams."""
    sc = B.scores(s, sf).withColumns({"soft": A.mapped(F.col("stage"), A.SOFT_LABELS), "weight": A.mapped(F.col("stage"), A.SOFT_WEIGHTS)})
    b0, beta = L.risk_head(sc, Z, "soft", "weight")
    return s.createDataFrame([("intercept", float(b0)), *sorted(beta.items())], "feature_name string, coefficient double")


# ------------------------------------------------------------------ rank heads


def gap_differences(rows: DataFrame, gap: int = RANK_GAP) -> DataFrame:
    """Later minus earlier features of windows ``gap`` apart, with the index of the earlier one."""
    later = rows.select("dataset", (F.col("window_index") - gap).alias("window_index"), *[F.col(c).alias(f"_{c}") for c in Z])
    return rows.select("dataset", "window_index", *Z).join(later, ["dataset", "window_index"]).select("dataset", "window_index", *[(F.col(f"_{c}") - F.col(c)).alias(c) for c in Z], F.lit(1.0).alias("up"))


@query()
def rank_head(s, sf):
    """Weights of the temporal rank head on windows 100 apart, over all streams."""
    return s.createDataFrame(sorted(L.rank_head(gap_differences(B.scores(s, sf)), Z).items()), "feature_name string, weight double")


@query()
def rank_head_grid(s, sf):
    """Rank heads of each stream over six penalties, fitted on its first part and judged on pairs of its last."""
    rows = S.chrono_split(guarded(s, sf)).where("guard = 0")
    fits = fit_cells(gap_differences(rows.where("part = 'train'"), GRID_GAP), ["dataset"], Z, "up", None, L.rank_cells(Z, list(RANK_C)), summed=True)
    fits["c"] = [RANK_C[k] for k in fits["cell"]]
    norm = np.abs(fits[Z].to_numpy()).sum(axis=1) + 1e-12
    fits[Z] = fits[Z].to_numpy() / norm[:, None]
    heads = s.createDataFrame(fits[["dataset", "c", *Z]].rename(columns={f: f"w_{f}" for f in Z}))
    keys = ["dataset", "c"]
    d = gap_differences(rows.where("part = 'validation'"), GRID_GAP).join(heads, "dataset")
    d = d.select(*keys, F.round(sum((F.col(f"w_{f}") * F.col(f) for f in Z), F.lit(0.0)), 9).alias("d"))
    got = E.pair_metrics(d, keys, "d").select(*keys, "pairs", "auc")
    best = got.groupBy("dataset").agg(F.max_by("c", F.struct(F.round("auc", 9), -F.col("c"))).alias("_c"))
    return heads.join(got, keys).join(best, "dataset").select(*keys, *[r6(f"w_{f}") for f in Z], "pairs", r6("auc"), (F.col("c") == F.col("_c")).cast("int").alias("selected"))


@query()
def rank_head_bootstrap(s, sf):
    """Spread and sign of the rank head's weights over 200 block-bootstrap replicates of each stream's first part."""
    rows = gap_differences(S.chrono_split(guarded(s, sf)).where("guard = 0 AND part = 'train'"))
    blocks = lambda at: F.floor(at / RANK_BLOCK).cast("long")
    rows = rows.withColumns({"near": blocks(F.col("window_index")), "far": blocks(F.col("window_index") + RANK_GAP)})
    every = np.arange(REPEATS)[None, :]

    def weights(pdf: pd.DataFrame) -> np.ndarray:
        """A pair counts as often as both its blocks were drawn."""
        times = [Q.draw(SEED, np.zeros((len(pdf), 1), np.int64), every, pdf[c].to_numpy()[:, None]) for c in ("near", "far")]
        return (times[0] * times[1]).astype(float)

    cells = L.rank_cells(Z, [1.0] * REPEATS)
    fits = fit_cells(rows, ["dataset"], Z, "up", None, cells, replicate_weights=weights, extra=("near", "far"), summed=True)
    fits[Z] = fits[Z].to_numpy() / (np.abs(fits[Z].to_numpy()).sum(axis=1) + 1e-12)[:, None]
    long = s.createDataFrame(fits.melt(["dataset", "cell"], Z, "feature_name", "weight"))
    names = ["median_weight", "weight_p05", "weight_p95", "sign_stability", "selection_frequency"]
    return Q.weight_summary(long, ["dataset", "feature_name"]).select("dataset", "feature_name", *[r6(c) for c in names])


# ------------------------------------------------------------------ offsets and redundancy


#: A shift is at most this large; shrinkage is n / (n + SHRINK); fewer rows or distinct source values disable it.
MOST_SHIFT, SHRINK, FEW_WINDOWS, FEW_VALUES = 1.0, 200.0, 30, 20


@query(
    ", nx AS (SELECT dataset, coalesce(lead(dataset) OVER (ORDER BY dataset), first(dataset) OVER (ORDER BY dataset ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS source FROM (SELECT DISTINCT dataset FROM sc)), "
    "so AS (SELECT dataset AS source, median(awr) AS sm, count(DISTINCT round(awr, 9)) AS sv FROM sc WHERE stage <= 2 GROUP BY 1), ca AS (SELECT dataset, median(awr) AS tm, count(*) AS n FROM sc WHERE baseline_window = 1 AND NOT start_cycle <= floor(end_cycle / 500) * 500 + 100 GROUP BY 1), "
    "of AS (SELECT nx.dataset, nx.source, mode, coalesce(n, 0) AS n, sm - tm AS raw, CASE WHEN mode = 'T0' THEN 'NO_CALIBRATION' WHEN coalesce(n, 0) < 30 THEN 'DISABLED_TOO_FEW_WINDOWS' WHEN sv < 20 THEN 'DISABLED_DEGENERATE_SOURCE_REFERENCE' ELSE 'APPLIED' END AS status "
    "FROM nx JOIN so USING (source) LEFT JOIN ca USING (dataset), (SELECT unnest(['T0', 'T1', 'T2']) AS mode)) "
    "SELECT dataset, source, mode, status, round(CASE WHEN status = 'APPLIED' THEN raw ELSE 0 END, 6) AS raw_shift, round(CASE WHEN status = 'APPLIED' THEN greatest(-1, least(1, raw)) * CASE mode WHEN 'T1' THEN 1 ELSE n / (n + 200.0) END ELSE 0 END, 6) AS applied_shift FROM of"
)
def target_offsets(s, sf):
    """Constant shifts of a target's scores to its source's early level: none, whole, and shrunk by the calibration rows."""
    sc = guarded(s, sf)
    source = sc.where("stage <= 2").groupBy(F.col("dataset").alias("source")).agg(M.med("awr").alias("sm"), F.count_distinct(F.round("awr", 9)).alias("sv"))
    own = sc.where("baseline_window = 1 AND guard = 0").groupBy("dataset").agg(M.med("awr").alias("tm"), F.count("*").alias("n"))
    rows = directions(sc).join(source, "source").join(own, "dataset", "left").fillna(0, ["n"]).withColumn("mode", F.explode(F.array(*map(F.lit, ("T0", "T1", "T2")))))
    few, poor = F.col("n") < FEW_WINDOWS, F.col("sv") < FEW_VALUES
    status = F.when(F.col("mode") == "T0", "NO_CALIBRATION").when(few, "DISABLED_TOO_FEW_WINDOWS").when(poor, "DISABLED_DEGENERATE_SOURCE_REFERENCE").otherwise("APPLIED")
    on = lambda x: F.when(F.col("status") == "APPLIED", x).otherwise(0.0)
    shrink = F.when(F.col("mode") == "T1", 1.0).otherwise(F.col("n") / (F.col("n") + SHRINK))
    raw = F.col("sm") - F.col("tm")
    return rows.withColumn("status", status).select("dataset", "source", "mode", "status", r6(on(raw), "raw_shift"), r6(on(A.clip(raw, -MOST_SHIFT, MOST_SHIFT) * shrink), "applied_shift"))


#: Correlations beyond the limit halve a feature's weight for each feature before it.
REDUNDANT, HALVED = 0.3, 0.5


def _redundancy_sql() -> str:
    pairs = [(a, b) for a in Z for b in Z if a != b]
    return (
        ", ef AS (" + " UNION ALL ".join(f"SELECT dataset, '{f}' AS feature_name, round(abs(median({f}) FILTER (stage = 5) - median({f}) FILTER (stage = 1)), 9) AS effect FROM sc GROUP BY 1" for f in Z) + "), "
        "co AS (" + " UNION ALL ".join(f"SELECT dataset, '{a}' AS feature_name, '{b}' AS other, round(abs(corr({a}, {b})), 9) AS r FROM sc GROUP BY 1" for a, b in pairs) + "), "
        "rk AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY effect DESC, feature_name) AS place FROM ef) "
        f"SELECT a.dataset, a.feature_name, a.place, power(0.5, count(b.place) FILTER (r > {REDUNDANT})) AS factor, coalesce(string_agg(b.feature_name, ';' ORDER BY b.place) FILTER (r > {REDUNDANT}), '') AS redundant_with "
        "FROM rk a LEFT JOIN rk b ON b.dataset = a.dataset AND b.place < a.place LEFT JOIN co ON co.dataset = a.dataset AND co.feature_name = a.feature_name AND co.other = b.feature_name GROUP BY ALL"
    )


@query(_redundancy_sql())
def redundancy_factors(s, sf):
    """Weight factor of each feature by falling effect: halved for each earlier one that it correlates with, and which."""
    sc = B.scores(s, sf)
    shift = lambda f: F.round(F.abs(M.med(F.when(F.col("stage") == 5, F.col(f))) - M.med(F.when(F.col("stage") == 1, F.col(f)))), 9)
    order = F.array_sort(F.array(*[F.struct((-F.col(f"e_{f}")).alias("e"), F.lit(f).alias("f")) for f in Z]))
    corr = {(a, b): F.round(F.abs(F.corr(a, b)), 9).alias(f"{a}|{b}") for a in Z for b in Z if a < b}
    wide = sc.groupBy("dataset").agg(*[shift(f).alias(f"e_{f}") for f in Z], *corr.values())
    linked = F.create_map(*[x for a, b in corr for k in (f"{a}|{b}", f"{b}|{a}") for x in (F.lit(k), F.col(f"`{a}|{b}`"))])
    rows = wide.select("dataset", order.alias("_o"), linked.alias("_r")).select("*", F.posexplode("_o").alias("_i", "_f"))
    before = F.transform(F.slice("_o", 1, F.col("_i")), lambda x: x["f"])
    same = F.filter(before, lambda g: F.element_at("_r", F.concat_ws("|", F.col("_f.f"), g)) > REDUNDANT)
    return rows.select("dataset", F.col("_f.f").alias("feature_name"), (F.col("_i") + 1).cast("long").alias("place"), F.pow(F.lit(HALVED), F.size(same)).alias("factor"), F.array_join(same, ";").alias("redundant_with"))


@query(
    "SELECT dataset, cycle_index, round(list_avg(fx), 5) AS fx_mean, round(sqrt(list_avg(list_transform(fx, lambda x: x * x))), 5) AS fx_rms, round(list_max(fx) - list_min(fx), 5) AS fx_p2p, len(fx) AS n "
    "FROM (SELECT dataset, vec_id AS cycle_index, s AS fx FROM sl)",
    SQL_WAVES,
)
def wide_csv_features(s, sf):
    """Features of the sensitive phase out of a wide CSV of all waves, which is written first and scanned by its slice's columns."""
    scratch = Scratch(s, "wide")
    waves = B.waves(s, sf)
    wide = waves.select("dataset", F.col("vec_id").alias("CycleIndex"), F.lit(1).alias("Stage1to5"), *[F.get("wave", i).alias(f"Fx_p{i + 1:04d}") for i in range(64)])
    parts = []
    for name in ("E0", "E1"):
        folder = scratch.path(name)
        wide.where(F.col("dataset") == name).drop("dataset").write.option("header", True).csv(folder)
        parts.append(T.wide_waveforms(s, folder, name, channels=("Fx",)))
    v = F.col("fx")
    rows = T.union_all(parts).select("dataset", F.col("cycle_index").cast("long").alias("cycle_index"), F.round(A.mean(v), 5).alias("fx_mean"), F.round(F.sqrt(A.mean(v, lambda x: x * x)), 5).alias("fx_rms"), F.round(F.array_max(v) - F.array_min(v), 5).alias("fx_p2p"), F.size(v).cast("long").alias("n"))
    result = scratch.settle(rows, "features")
    for k, name in enumerate(("E0", "E1"), 1):
        scratch.remove(f"{scratch.base}/{k:03d}-{name}")
    return result
