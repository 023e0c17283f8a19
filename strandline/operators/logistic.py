"""Many bounded logistic fits in one pass a round: projected Newton over sums that Spark aggregates.

A *cell* is one fit: a feature set (features outside it are bounded to 0), a ridge weight, bounds, and where wanted
replicate weights of its own. A round evaluates the loss, gradient and Hessian of all cells of all streams at once: every
task sums over its rows in numpy, Spark adds the sums up, and the driver takes one step for each cell. What reaches the
driver has the size of the cells' matrices, however many rows there are.

The loss of a cell is sum(w * logloss) / W + l2 * |beta|^2, the intercept unpenalised; ``summed`` leaves out the division.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.shared import Scratch


@dataclass
class Cells:
    """Bounds (cells x (1 + features), the intercept first) and ridge weights of the fits of one stream."""

    lower: np.ndarray
    upper: np.ndarray
    l2: np.ndarray
    start: np.ndarray | None = None

    @classmethod
    def grid(cls, features: list[str], sets: list[list[str]], l2: list[float], cap: np.ndarray | float = np.inf, floor: float = 0.0, intercept: tuple[float, float] = (-10.0, 10.0)) -> Cells:
        """Every set with every ridge weight, sets first; ``cap`` bounds the coefficients from above."""
        cap = np.broadcast_to(np.asarray(cap, float), (len(features),))
        inside = np.repeat(np.array([[f in s for f in features] for s in sets]), len(l2), axis=0)
        n = len(inside)
        lower = np.column_stack([np.full(n, intercept[0]), np.where(inside, floor, 0.0)])
        upper = np.column_stack([np.full(n, intercept[1]), np.where(inside, cap, 0.0)])
        return cls(lower, upper, np.tile(np.asarray(l2, float), len(sets)))


@dataclass
class _Search:
    """Projected Newton of one cell, fed with sums at its trial point."""

    lower: np.ndarray
    upper: np.ndarray
    l2: float
    theta: np.ndarray
    summed: bool = False
    tol: float = 1e-9
    trial: np.ndarray = field(init=False)
    value: float = np.inf
    step: float = 1.0
    done: bool = False
    success: bool = False

    def __post_init__(self):
        self.theta = self.trial = np.clip(self.theta, self.lower, self.upper)

    def feed(self, w: float, loss: float, grad: np.ndarray, hess: np.ndarray) -> None:
        scale = 1.0 if self.summed else 1.0 / max(w, 1e-300)
        ridge = np.append(0.0, np.full(len(self.trial) - 1, self.l2))
        value = loss * scale + float(ridge @ self.trial**2)
        if value > self.value + 1e-13 * max(1.0, abs(self.value)):
            self.step /= 2
            if self.step < 1e-10:  # no lower value within rounding
                self.done = self.success = True
            self._try()
            return
        self.theta, self.value, self.step = self.trial, value, 1.0
        self.grad = grad * scale + 2 * ridge * self.theta
        hess = hess * scale + np.diag(2 * ridge)
        moved = np.abs(self.theta - np.clip(self.theta - self.grad, self.lower, self.upper)).max()
        if w <= 0 or moved < self.tol * (max(1.0, w) if self.summed else 1.0):
            self.done, self.success = True, w > 0
            return
        free = ~(((self.theta <= self.lower) & (self.grad > 0)) | ((self.theta >= self.upper) & (self.grad < 0)))
        self.move = np.zeros(len(self.theta))
        h = hess[np.ix_(free, free)]
        self.move[free] = -np.linalg.lstsq(h + 1e-12 * np.trace(h) / max(1, len(h)) * np.eye(len(h)), self.grad[free], rcond=None)[0]
        self._try()

    def _try(self) -> None:
        self.trial = np.clip(self.theta + self.step * self.move, self.lower, self.upper)


def fit_cells(df: DataFrame, keys: list[str], features: list[str], label: str, weight: str | None, cells: Callable[[tuple], Cells] | Cells, *, replicate_weights: Callable[[pd.DataFrame], np.ndarray] | None = None, extra: tuple[str, ...] = (), summed: bool = False, rounds: int = 100) -> pd.DataFrame:
    """One row a key and cell: keys, cell, intercept, a column for each feature, objective, success.

    Rows without a feature or label take no part. ``replicate_weights`` maps a batch of rows, with the columns ``extra``, to
    weights (rows x cells). Keys are streams: few, and held by the driver.
    """
    scratch = Scratch(df.sparkSession, "logistic")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.dropna(subset=[*features, label]).select(*keys, *extra, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("_y"), w.alias("_w"))
    rows = scratch.settle(rows, "rows")
    names = sorted(tuple(r) for r in rows.select(*keys).distinct().collect()) if keys else [()]
    searches: dict[tuple, list[_Search]] = {}
    for name in names:
        own = cells(name) if callable(cells) else cells
        begin = own.start if own.start is not None else np.zeros_like(own.lower)
        searches[name] = [_Search(lo, hi, float(l2), b, summed) for lo, hi, l2, b in zip(own.lower, own.upper, own.l2, begin, strict=True)]
    p, x_names = len(features) + 1, [f"_x{i}" for i in range(len(features))]
    size = 2 + p + p * p

    def sums(at: dict[tuple, tuple[np.ndarray, np.ndarray]]):
        def run(batches):
            total = {name: np.zeros((len(index), size)) for name, (index, _) in at.items()}
            for pdf in batches:
                groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
                for name, g in groups:
                    if name not in at:
                        continue
                    index, theta = at[name]
                    x = np.column_stack([np.ones(len(g)), g[x_names].to_numpy(float)])
                    y, base = g["_y"].to_numpy(float)[:, None], g["_w"].to_numpy(float)[:, None]
                    weights = base * replicate_weights(g)[:, index] if replicate_weights else np.broadcast_to(base, (len(g), len(index)))
                    z = x @ theta.T
                    prob = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    out = total[name]
                    out[:, 0] += weights.sum(0)
                    out[:, 1] += (weights * (np.logaddexp(0, z) - y * z)).sum(0)
                    out[:, 2 : 2 + p] += (weights * (prob - y)).T @ x
                    curve = weights * prob * (1 - prob)
                    for k in range(len(index)):
                        out[k, 2 + p :] += ((x * curve[:, k : k + 1]).T @ x).ravel()
            for i, name in enumerate(at):
                for k, values in zip(at[name][0], total[name], strict=True):
                    yield pd.DataFrame({"key": i, "cell": int(k), "at": np.arange(size), "v": values})

        return run

    for _ in range(rounds):
        at = {}
        for name, own in searches.items():
            index = np.array([k for k, s in enumerate(own) if not s.done], int)
            if len(index):
                at[name] = index, np.array([own[k].trial for k in index])
        if not at:
            break
        got = rows.mapInPandas(sums(at), "key int, cell int, at int, v double").groupBy("key", "cell", "at").agg(F.sum("v").alias("v"))
        flat, order = got.toPandas().sort_values(["key", "cell", "at"]), list(at)
        for (i, k), v in flat.groupby(["key", "cell"])["v"]:
            v = v.to_numpy()
            searches[order[i]][k].feed(v[0], v[1], v[2 : 2 + p], v[2 + p :].reshape(p, p))
    scratch.keep()
    out = [(*name, k, *map(float, s.theta), float(s.value), bool(s.success)) for name, own in searches.items() for k, s in enumerate(own)]
    return pd.DataFrame(out, columns=[*keys, "cell", "intercept", *features, "objective", "success"])
