"""Fits: ridge by normal equations, baseline covariance, thresholds, rank heads, risk heads.

Sums over the data are Spark aggregates; what reaches the driver is a matrix whose size is that of the features.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import arrays as A
from strandline.functions.linear import precision
from strandline.operators.logistic import Cells, fit_cells
from strandline.operators.prefix import running_totals
from strandline.sources.shared import Scratch


def gram(df: DataFrame, keys: list[str], x: list[str], y: str | None = None) -> DataFrame:
    """Sums of products of the columns (and with y) for each key, over rows without nulls."""
    columns = [*x, *([y] if y else [])]
    full = df.dropna(subset=columns)
    pairs = [(a, b) for i, a in enumerate(x) for b in columns[i:]]
    return full.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs])


def ridge(df: DataFrame, keys: list[str], x: list[str], y: str, alpha: float = 1.0, least: int = 20) -> DataFrame:
    """Ridge without intercept by normal equations; keys with under ``least`` rows have no fit. One row a coefficient."""
    sums = gram(df, keys, x, y)
    schema = ", ".join([*(f"{k} {dict(df.dtypes)[k]}" for k in keys), "term string", "coefficient double", "n long"])

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                if r["n"] < least:
                    continue
                xx = np.array([[r.get(f"{a}__{b}", r.get(f"{b}__{a}")) for b in x] for a in x], float)
                beta = np.linalg.solve(xx + alpha * np.eye(len(x)), np.array([r[f"{a}__{y}"] for a in x], float))
                rows += [(*(r[k] for k in keys), a, float(b), int(r["n"])) for a, b in zip(x, beta, strict=True)]
            yield pd.DataFrame(rows, columns=[*keys, "term", "coefficient", "n"])

    return sums.mapInPandas(solve, schema)


def mahalanobis(df: DataFrame, features: list[str], least: int = 10) -> DataFrame:
    """``distance`` of each window to its stream's baseline median under the shrunk baseline covariance.

    Baselines are the windows within the first 500 cycles: about a hundred rows a stream, whatever its length.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[features].dropna().to_numpy(float)
        centre = np.median(x, axis=0) if len(x) else np.zeros(len(features))
        return pd.DataFrame({"dataset": [pdf["dataset"].iloc[0]], "_c": [centre.tolist()], "_p": [precision(x, least).ravel().tolist()]})

    model = df.where("baseline_window = 1").select("dataset", *features).groupBy("dataset").applyInPandas(fit, "dataset string, _c array<double>, _p array<double>")
    d = F.zip_with(F.array(*features), "_c", lambda a, b: a - b)
    n = len(features)
    quad = reduce(lambda a, b: a + b, [F.get(d, i) * F.get(d, j) * F.get("_p", i * n + j) for i in range(n) for j in range(n)])
    return df.join(model, "dataset").withColumn("distance", F.sqrt(A.positive(quad))).drop("_c", "_p")


def threshold_candidates(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Recall, false positive rate and precision at every distinct score, from counts of distinct scores."""
    per = df.groupBy(*keys, score).agg(F.sum(label).alias("p"), F.count("*").alias("c"))
    scratch = Scratch(df.sparkSession, "thresholds")
    tp, n, pos, rows = (F.col(c) for c in ("_tp", "_n", "_tp_all", "_n_all"))
    per = running_totals(per, keys, [F.col(score).desc()], {"_tp": F.col("p"), "_n": F.col("c")}, scratch, totals=True)
    return scratch.last(per.select(*keys, F.col(score).alias("threshold"), (tp / pos).alias("recall"), ((n - tp) / F.nullif(rows - pos, F.lit(0))).alias("fpr"), (tp / n).alias("precision")))


def choose_threshold(df: DataFrame, keys: list[str], score: str, label: str, recall: float = 0.85) -> DataFrame:
    """Among thresholds of enough recall the one of least fpr, then most recall, precision, least threshold; else by utility."""
    c = threshold_candidates(df, keys, score, label)
    good = F.col("recall") >= recall
    utility = 0.7 * F.col("recall") + 0.3 * F.col("precision") - 0.5 * F.col("fpr")
    order = F.struct(F.when(good, 0).otherwise(1).alias("a"), F.when(good, F.col("fpr")).otherwise(-utility).alias("b"), (-F.col("recall")).alias("c"), (-F.col("precision")).alias("d"), F.col("threshold").alias("e"))
    best = c.groupBy(*keys).agg(F.min_by(F.struct("threshold", "recall", "fpr", "precision", good.cast("int").alias("feasible")), order).alias("b"))
    return best.select(*keys, "b.*")


def rank_cells(features: list[str], c: list[float]) -> Cells:
    """Cells of rank heads, no intercept: a pair and its mirror image cost the same, so half of them and half the penalty do."""
    n, p = len(c), len(features) + 1
    free = np.column_stack([np.zeros(n), np.full((n, p - 1), np.inf)])
    return Cells(-free, free, 1 / (4 * np.asarray(c, float)))


def rank_head(pairs: DataFrame, features: list[str], c: float = 1.0) -> dict[str, float]:
    """L2 logistic without intercept on differences of mirrored pairs, normalised to unit L1 norm."""
    fit = fit_cells(pairs.withColumn("_up", F.lit(1.0)), [], features, "_up", None, rank_cells(features, [c]), summed=True)
    beta = fit[features].to_numpy(float)[0]
    return dict(zip(features, (beta / max(np.abs(beta).sum(), 1e-12)).tolist(), strict=True))


def risk_head(df: DataFrame, features: list[str], soft: str, weight: str, ridge: float = 0.01, high: float = 5.0):
    """Soft-label logistic with coefficients in [0, high] and intercept in [-10, 10], as (intercept, coefficients)."""
    fit = fit_cells(df, [], features, soft, weight, Cells.grid(features, [features], [ridge], high)).iloc[0]
    return float(fit["intercept"]), {f: float(fit[f]) for f in features}


def greedy_redundancy(corr: np.ndarray, order: list[int], limit: float = 0.95, factor: float = 0.5) -> list[float]:
    """Weight factor of each feature: halved for each kept predecessor that it correlates with beyond ``limit``."""
    out, kept = [1.0] * len(corr), []
    for i in order:
        for j in kept:
            if abs(corr[i, j]) > limit:
                out[i] *= factor
        kept.append(i)
    return out
