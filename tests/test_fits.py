"""Bounded fits against a second, dense solver; replicate weights and medians against plain resampling; running sums."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import bootstrap as Q
from strandline.operators import evaluation as E
from strandline.operators import metrics as M
from strandline.operators import models as L
from strandline.operators import rolling as R
from strandline.operators import streams as S
from strandline.operators.logistic import Cells, fit_cells
from strandline.operators.prefix import running_totals
from strandline.sources.shared import Scratch

# ------------------------------------------------------------------ fits


def loss(theta, x, y, w, l2, summed):
    z = theta[0] + x @ theta[1:]
    p = 1 / (1 + np.exp(-z))
    scale = 1.0 if summed else 1 / w.sum()
    value = scale * (w * (np.logaddexp(0, z) - y * z)).sum() + l2 * (theta[1:] ** 2).sum()
    r = scale * w * (p - y)
    return value, np.append(r.sum(), x.T @ r + 2 * l2 * theta[1:])


def dense(x, y, w, l2, lower, upper, summed=False):
    """Accelerated projected gradient steps, to the end: slow, and nothing like Newton."""
    scale = 1.0 if summed else 1 / w.sum()
    one = np.column_stack([np.ones(len(x)), x])
    size = 1 / (0.25 * scale * np.linalg.eigvalsh(one.T @ (one * w[:, None])).max() + 2 * l2)
    theta = previous = np.clip(np.zeros(x.shape[1] + 1), lower, upper)
    t = 1.0
    for _ in range(40_000):
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = theta + (t - 1) / t2 * (theta - previous)
        new = np.clip(ahead - size * loss(ahead, x, y, w, l2, summed)[1], lower, upper)
        if (new - theta) @ (ahead - new) > 0:
            t2 = 1.0
        if np.abs(new - theta).max() < 1e-12 and np.abs(ahead - theta).max() < 1e-12:
            break
        previous, theta, t = theta, new, t2
    return theta


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(7)
    frames = []
    for name, n in (("a", 300), ("b", 170)):
        x = rng.normal(size=(n, 3)) * [1.0, 0.5, 3.0]
        y = np.clip(1 / (1 + np.exp(-(x @ [1.5, -1.0, 0.4] - 0.3))) + rng.normal(size=n) * 0.2, 0, 1)
        frames.append(pd.DataFrame({"dataset": name, "f": x[:, 0], "g": x[:, 1], "h": x[:, 2], "y": y, "w": rng.integers(1, 5, n).astype(float), "row": np.arange(n)}))
    return pd.concat(frames, ignore_index=True)


FEATURES = ["f", "g", "h"]


@pytest.mark.parametrize("summed", [False, True])
def test_fits_equal_a_dense_solver(spark, sample, summed):
    sets, l2 = [["f"], ["f", "h"], FEATURES], [0.001, 0.1, 2.0]
    cap = np.array([0.8, 5.0, 0.2])
    fits = fit_cells(spark.createDataFrame(sample).repartition(5), ["dataset"], FEATURES, "y", "w", Cells.grid(FEATURES, sets, l2, cap), summed=summed)
    assert len(fits) == 18 and fits["success"].all()
    for r in fits.to_dict("records"):
        own = sample[sample["dataset"] == r["dataset"]]
        inside, lam = sets[r["cell"] // 3], l2[r["cell"] % 3]
        upper = np.append(10, [c if f in inside else 0.0 for f, c in zip(FEATURES, cap, strict=True)])
        want = dense(own[FEATURES].to_numpy(), own["y"].to_numpy(), own["w"].to_numpy(), lam, np.array([-10, 0, 0, 0]), upper, summed)
        got = np.array([r["intercept"], *(r[f] for f in FEATURES)])
        assert np.abs(got - want).max() < 1e-5
        assert (got[1:] >= 0).all() and (got[1:] <= upper[1:]).all()


def test_free_fit_and_replicate_weights(spark, sample):
    """Replicate weights of a cell are those rows, that often."""
    one = sample[sample["dataset"] == "a"].drop(columns="dataset")
    cells = Cells(np.full((3, 4), -np.inf), np.full((3, 4), np.inf), np.full(3, 0.05))
    weights = lambda pdf: np.stack([np.ones(len(pdf)), pdf["row"] % 3, pdf["row"] % 2 * 2.0], axis=1)
    fits = fit_cells(spark.createDataFrame(one).repartition(3), [], FEATURES, "y", "w", cells, replicate_weights=weights, extra=("row",))
    x, y, w, row = one[FEATURES].to_numpy(), one["y"].to_numpy(), one["w"].to_numpy(), one["row"].to_numpy()
    for k, times in enumerate((np.ones(len(x)), row % 3, row % 2 * 2.0)):
        want = dense(x, y, w * times, 0.05, np.full(4, -np.inf), np.full(4, np.inf))
        assert np.abs(fits.loc[k, ["intercept", *FEATURES]].to_numpy(float) - want).max() < 1e-5


def test_fits_of_hopeless_data(spark):
    rows = spark.createDataFrame([("s", 1.0, 1.0), ("s", 2.0, 1.0), ("s", None, 0.0)], "dataset string, f double, y double")
    (fit,) = fit_cells(rows, ["dataset"], ["f"], "y", None, Cells.grid(["f"], [["f"]], [0.01], 5.0)).to_dict("records")
    assert fit["success"] and fit["intercept"] == 10.0  # all rows of one class: the bounds hold
    assert fit_cells(rows.limit(0), ["dataset"], ["f"], "y", None, Cells.grid(["f"], [["f"]], [0.01])).empty


def test_narrow_feature_is_capped(spark):
    """A feature of tiny spread: its weight, unscaled, stays within the bound."""
    x, stage = np.linspace(0, 1e-5, 60), np.tile([1, 2, 3, 4, 5], 12)
    width = np.quantile(x, 0.75) - np.quantile(x, 0.25)
    rows = pd.DataFrame({"x": (x - np.median(x)) / width, "y": np.array([0, 0.15, 0.4, 0.7, 1.0])[stage - 1], "w": np.array([1, 1, 1, 2, 4.0])[stage - 1]})
    fit = fit_cells(spark.createDataFrame(rows), [], ["x"], "y", "w", Cells.grid(["x"], [["x"]], [0.05], min(3.0, 5.0 * width))).iloc[0]
    assert fit["x"] / width <= 5 + 1e-9


def test_rank_head_of_mirrored_pairs(spark, sample):
    d = sample[FEATURES].to_numpy()[:200] + [0.3, -0.1, 0.2]
    got = L.rank_head(spark.createDataFrame(pd.DataFrame(d, columns=FEATURES)), FEATURES, c=0.5)
    both, y = np.vstack([d, -d]), np.repeat([1.0, 0.0], 200)
    want = dense(both, y, np.ones(400), 1.0, np.array([0, -np.inf, -np.inf, -np.inf]), np.array([0, np.inf, np.inf, np.inf]), summed=True)[1:]
    assert np.abs(np.array([got[f] for f in FEATURES]) - want / np.abs(want).sum()).max() < 1e-5


# ------------------------------------------------------------------ bootstrap


def test_draws_are_of_mean_one():
    w = Q.draw(5, np.int64(1), np.arange(400)[None, :], np.arange(3000)[:, None]).astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    for a, b in ((w[1:], w[:-1]), (w[:, 1:], w[:, :-1]), (w, Q.draw(5, np.int64(5), np.arange(400)[None, :], np.arange(3000)[:, None])), (w, Q.draw(6, np.int64(1), np.arange(400)[None, :], np.arange(3000)[:, None]))):
        assert abs(np.corrcoef(a.ravel(), np.asarray(b, float).ravel())[0, 1]) < 0.01
    totals = w.sum(0)
    assert abs(totals.var() / 3000 - 1) < 0.25  # replicates differ as independent blocks make them


def test_replicate_medians_are_those_of_repeated_rows(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"dataset": "s", "stage": 1, "feature_name": rng.choice(["p", "q"], 20_000), "value": np.round(rng.normal(size=20_000), 2), "block": rng.integers(0, 40, 20_000)})
    rows.loc[rng.random(20_000) < 0.3, "value"] = 1.5  # a hot value
    rows.loc[:5, "value"] = None
    scratch = Scratch(spark, "test")
    typed = spark.createDataFrame(rows).select("dataset", F.col("stage").cast("int").alias("stage"), "feature_name", F.nanvl("value", F.lit(None)).alias("value"), "block")
    got = Q.replicate_medians(typed, 60, 9, scratch).toPandas()
    want = {}
    for name, g in rows.dropna().groupby("feature_name"):
        for r in range(60):
            times = Q.draw(9, np.int64(1), np.int64(r), g["block"].to_numpy())
            want[name, r] = float(np.median(np.repeat(g["value"].to_numpy(), times)))
    assert {(a, b): c for a, b, c in got[["feature_name", "replicate", "median"]].itertuples(index=False)} == want
    scratch.keep()


def test_direction_stability(spark):
    rng = np.random.default_rng(1)
    frames = []
    for stage, start in ((1, 0), (3, 2000), (5, 4000)):
        n = 2000
        frames.append(pd.DataFrame({"dataset": "s", "stage": stage, "window_index": start + np.arange(n), "sure": rng.normal(size=n) + stage, "flat": np.zeros(n), "close": np.repeat(rng.normal(size=n // 20), 20) + 0.02 * stage}))
    wide = spark.createDataFrame(pd.concat(frames))
    long = wide.select("dataset", "stage", "window_index", F.explode(F.array(*[F.struct(F.lit(f).alias("feature_name"), F.col(f).alias("v")) for f in ("sure", "flat", "close")])).alias("f")).select("dataset", "stage", "window_index", "f.*")
    got = {r["feature_name"]: r for r in Q.direction_stability(long, F.col("v"), 300).collect()}
    assert got["sure"]["stability"] == 1.0 and got["sure"]["direction_sign"] == 1
    assert got["flat"]["stability"] == 0.0 and got["flat"]["direction_sign"] == 0
    if got["close"]["direction_sign"]:
        assert 0.3 < got["close"]["stability"] < 1.0
    few = Q.direction_stability(long.where("window_index % 2000 < 4"), F.col("v"), 20).collect()
    assert {r["stability"] for r in few} == {0.0}


# ------------------------------------------------------------------ running sums


@pytest.fixture(scope="module")
def long_stream(spark):
    """A million distinct scores of one stream, and a short stream with ties."""
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double")
    one = spark.range(1_000_000).select(F.lit("long").alias("dataset"), F.col("id").alias("window_index"), h.alias("score"), (F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(5)) == 0).cast("int").alias("late"))
    two = spark.range(500).select(F.lit("short").alias("dataset"), F.col("id").alias("window_index"), (F.col("id") % 7).cast("double").alias("score"), (F.col("id") % 3 == 0).cast("int").alias("late"))
    return one.unionByName(two).withColumn("stage", (F.pmod(F.xxhash64(F.lit(4), "window_index"), F.lit(5)) + 1).cast("int")).persist()


def test_running_totals_of_a_long_stream(spark, long_stream):
    scratch = Scratch(spark, "test")
    got = running_totals(long_stream, ["dataset"], [F.col("score").desc(), F.col("window_index")], {"n": F.lit(1).cast("long"), "hits": F.col("late").cast("long")}, scratch, totals=True)
    pdf = got.toPandas().sort_values(["dataset", "score", "window_index"], ascending=[True, False, True])
    for _, g in pdf.groupby("dataset"):
        assert (g["n"].to_numpy() == np.arange(1, len(g) + 1)).all() and (g["hits"].to_numpy() == g["late"].cumsum().to_numpy()).all()
        assert (g["n_all"] == len(g)).all() and (g["hits_all"] == g["late"].sum()).all()
    scratch.keep()


def test_rank_metrics_of_a_long_stream(spark, long_stream):
    pdf = long_stream.toPandas()
    by = lambda df, c: {r["dataset"]: r[c] for r in df.collect()}
    area, ap = by(M.auroc(long_stream, ["dataset"], "score", "late"), "auroc"), by(M.average_precision(long_stream, ["dataset"], "score", "late", "window_index"), "average_precision")
    rho, tau = by(M.spearman(long_stream, ["dataset"], "score", "stage"), "spearman"), by(E.kendall(long_stream.where("dataset = 'short'"), ["dataset"], "score", "stage", [1, 2, 3, 4, 5]), "kendall")
    for name, g in pdf.groupby("dataset"):
        rank, pos = g["score"].rank(), g["late"] == 1
        assert abs(area[name] - (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())) < 1e-9
        hit = g.sort_values(["score", "window_index"], ascending=[False, True])["late"].to_numpy()
        assert abs(ap[name] - (np.cumsum(hit) / np.arange(1, len(hit) + 1))[hit == 1].mean()) < 1e-9
        assert abs(rho[name] - rank.corr(g["stage"].rank())) < 1e-9
    short = pdf[pdf["dataset"] == "short"]
    sign = lambda c: np.sign(short[c].to_numpy()[:, None] - short[c].to_numpy()[None, :])
    a, b = sign("score"), sign("stage")
    assert abs(tau["short"] - (a * b).sum() / np.sqrt((a != 0).sum() * (b != 0).sum())) < 1e-9
    pct = R.pct_rank(long_stream, "score").toPandas()
    want = pdf.groupby("dataset")["score"].rank(pct=True) * 100
    both = pct.merge(pdf.assign(want=want)[["dataset", "window_index", "want"]], on=["dataset", "window_index"])
    assert len(both) == len(pdf) and np.abs(both["pct"] - both["want"]).max() < 1e-9
    flat = M.spearman(long_stream.where("dataset = 'short'").withColumn("score", F.lit(1.0)), ["dataset"], "score", "stage").collect()
    assert flat[0]["spearman"] is None


def test_thresholds_and_splits_of_a_long_stream(spark, long_stream):
    got = L.threshold_candidates(long_stream, ["dataset"], "score", "late").where("dataset = 'short'").toPandas()
    g = long_stream.where("dataset = 'short'").toPandas()
    assert len(got) == 7
    for r in got.itertuples():
        high = g["score"] >= r.threshold
        assert abs(r.recall - g.loc[high, "late"].sum() / g["late"].sum()) < 1e-12 and abs(r.fpr - (1 - g.loc[high, "late"]).sum() / (1 - g["late"]).sum()) < 1e-12
    split = S.stage_split(long_stream).groupBy("dataset", "stage", "part").agg(F.count("*").alias("n")).toPandas().pivot_table(index=["dataset", "stage"], columns="part", values="n", fill_value=0)
    for r in split.itertuples():
        n = r.none + r.train + r.validation
        assert (r.train, r.validation) == (int(n * 0.7) - 20, n - int(n * 0.7) - 20)
