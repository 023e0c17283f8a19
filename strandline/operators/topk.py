"""Greedy selections without a whole stream in one group: spaced top-k, spaced takers, peaks and their prominence.

*Spaced top-k* needs few rows: a pick strikes rows of its own cell of one spacing and of the two beside it, so the first k
picks stand in the 3 k - 2 cells of the best rows. Only their rows are gathered.

*Spaced takers* without a k are found in dominance rounds. Chunks of many spacings, with a halo of one spacing on both
sides, decide rows in order of priority: a row that beats all undecided rows within the spacing is taken and strikes its
neighbours; what depends on an undecided row of the halo waits for the next round. A round settles at least the best
undecided row, and all rows but chains of falling priority that cross a chunk's end.

*Prominence* looks for the nearest higher row on both sides through a tree of maxima and minima, 64 children a node:
searches climb until a node holds a higher child and descend to it, each level one join by node.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.streams import framed, running_sum
from strandline.sources.shared import Scratch

FANOUT = 64
CHUNK_SPACINGS = 64


# ------------------------------------------------------------------ spaced top-k


def spaced_top(df: DataFrame, score: str, k: int = 20, spacing: float = 500.0, least: int = 0) -> DataFrame:
    """Rows by falling score (ties: earlier window), skipping those nearer than ``spacing`` to one already taken.

    A stream that gives fewer than ``least`` such rows is filled up to k with its best other rows; ``relaxed`` says so.
    Rows without a score take no part.
    """
    schema = "dataset string, window_index long, center_cycle double, score double, pick int, relaxed int"

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "window_index"], ascending=[False, True], ignore_index=True)
        centres, taken = pdf["center_cycle"].to_numpy(), []
        for i in range(len(pdf)):
            if len(taken) < k and (np.abs(centres[taken] - centres[i]) >= spacing).all():
                taken.append(i)
        relaxed = len(taken) < min(least, len(pdf))
        if relaxed:
            taken += [i for i in range(len(pdf)) if i not in set(taken)][: k - len(taken)]
        return pdf.iloc[taken].assign(pick=range(1, len(taken) + 1), relaxed=int(relaxed))

    rows = df.where(F.col(score).isNotNull()).select("dataset", "window_index", F.col("center_cycle").cast("double").alias("center_cycle"), F.col(score).cast("double").alias("score"))
    rows = rows.withColumn("_cell", F.floor(F.col("center_cycle") / spacing))
    best = F.max(F.struct("score", -F.col("window_index")))
    cells = rows.groupBy("dataset", "_cell").agg(best.alias("_best"))
    in_order = Window.partitionBy("dataset").orderBy(F.col("_best").desc())
    top = cells.withColumn("_n", F.row_number().over(in_order)).where(F.col("_n") <= 3 * k - 2)
    wanted = rows.join(top.select("dataset", "_cell"), ["dataset", "_cell"], "left_semi").drop("_cell")
    if least:
        by_score = Window.partitionBy("dataset").orderBy(F.col("score").desc(), "window_index")
        fill = rows.drop("_cell").withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") <= k).drop("_n")
        wanted = wanted.unionByName(fill).distinct()
    return wanted.groupBy("dataset").applyInPandas(greedy, schema)


# ------------------------------------------------------------------ dominance rounds


def _decide(spacing: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", ignore_index=True)
        at, own = pdf["at"].to_numpy(), pdf["_own"].to_numpy()
        first, last = np.searchsorted(at, at - spacing, "right"), np.searchsorted(at, at + spacing, "left")
        taken, struck, open_ = pdf["taken"].to_numpy().copy(), np.zeros(len(at), bool), np.zeros(len(at), bool)
        for i in np.lexsort((pdf["tie"].to_numpy(), -pdf["score"].to_numpy())).tolist():
            near = slice(first[i], last[i])
            if taken[i]:
                continue
            if taken[near].any():
                struck[i] = True
            elif own[i] and not open_[near].any():
                taken[i] = True
            else:
                open_[i] = True
        return pdf.assign(taken=taken)[own & ~struck].drop(columns=["_own", "_chunk"])

    return run


def spaced_takers(rows: DataFrame, spacing: float, scratch: Scratch) -> DataFrame:
    """The rows of (dataset, at, score, tie, ...) that a greedy pass by falling score, then rising tie, would take.

    ``dataset``, ``at`` and ``tie`` name a row; no two takers of a stream are nearer than ``spacing``.
    """
    width, at = CHUNK_SPACINGS * spacing, F.col("at")
    state, own = scratch.settle(rows.withColumn("taken", F.lit(False)), "undecided"), F.floor(at / width)
    copies = F.filter(F.array(own, F.when(at - own * width < spacing, own - 1), F.when((own + 1) * width - at < spacing, own + 1)), lambda c: c.isNotNull())
    while not state.where("not taken").isEmpty():
        dealt = state.withColumn("_chunk", F.explode(copies)).withColumn("_own", F.col("_chunk") == own)
        now = scratch.settle(dealt.groupBy("dataset", "_chunk").applyInPandas(_decide(spacing), state.schema), "undecided")
        scratch.drop(state)
        state = now
    return state.drop("taken")


# ------------------------------------------------------------------ peaks


def local_peaks(df: DataFrame, score: str, height: float = 0.0) -> DataFrame:
    """Strict local maxima of a stream at or above ``height``."""
    near = framed(df, ["dataset"], "_at", {"_l1": lambda w: F.lag(score, 1).over(w), "_l2": lambda w: F.lag(score, 2).over(w)}, 2)
    top = (F.col("_l1") > F.col("_l2")) & (F.col("_l1") > F.col(score)) & (F.col("_l1") >= height)
    return near.where(top).select("dataset", (F.col("window_index") - 1).alias("window_index"), F.col("_l1").alias("height"))


def numbered_scores(df: DataFrame, score: str) -> DataFrame:
    """dataset, window_index, x and the 1-based position p among the rows that have a score."""
    rows = df.where(F.col(score).isNotNull()).select("dataset", "window_index", F.col(score).cast("double").alias("x"))
    rows = rows.withColumns({"_at": F.col("window_index") + 1, "_one": F.lit(1).cast("long")})
    return running_sum(rows, ["dataset"], "_at", "_one", "p").drop("_at", "_one")


def flat_peaks(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """dataset, p, x of the middles of runs of equal values that are higher than the runs on both sides.

    Runs may be longer than any chunk: they are numbered by a running sum, and only their first rows are compared.
    """
    new = framed(rows, ["dataset"], "p", {"_new": lambda w: F.coalesce(F.lag("x").over(w) != F.col("x"), F.lit(True)).cast("long")}, 1)
    starts = scratch.settle(running_sum(new, ["dataset"], "p", "_new", "r").where("_new = 1").select("dataset", "r", "p", "x"), "runs")
    lag = lambda c, n: lambda w: F.lag(c, n).over(w)
    near = framed(starts, ["dataset"], "r", {"x1": lag("x", 1), "x2": lag("x", 2), "p1": lag("p", 1)}, 2)
    # a run from p1 to p - 1, at the middle counted from 0
    return near.where("x1 > x2 and x1 > x").select("dataset", (F.floor((F.col("p1") + F.col("p") - 3) / 2) + 1).alias("p"), F.col("x1").alias("x"))


def _levels(rows: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Nodes of each level above the rows: dataset, node, kids (position, maximum, minimum of each child, in order)."""
    below = rows.select("dataset", F.col("p").alias("i"), F.col("x").alias("mx"), F.col("x").alias("mn"))
    top, out = rows.agg(F.max("p")).first()[0] or 0, []
    while top > 0:
        kids = F.sort_array(F.collect_list(F.struct("i", "mx", "mn"))).alias("kids")
        nodes = scratch.settle(below.groupBy("dataset", F.floor(F.col("i") / FANOUT).alias("node")).agg(kids, F.max("mx").alias("mx"), F.min("mn").alias("mn")), "level")
        out.append(nodes.select("dataset", "node", "kids"))
        below, top = nodes.select("dataset", F.col("node").alias("i"), "mx", "mn"), top // FANOUT
    return out


def side_minima(rows: DataFrame, peaks: DataFrame, scratch: Scratch) -> DataFrame:
    """dataset, p, side (-1, 1), low: the least x between each peak and the nearest higher row on that side, or the end."""
    levels, side = _levels(rows, scratch), F.col("side")
    ask = peaks.select("dataset", "p", "x", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")).withColumns({"at": F.col("p"), "low": F.col("x"), "found": F.lit(-1)})
    ask = scratch.settle(ask, "searches")

    def search(ask: DataFrame, nodes: DataFrame, node: Column, past: bool, found: Column) -> DataFrame:
        """The nearest higher child of a node, only beyond ``at`` where the search comes from below."""
        j = ask.withColumn("node", node).join(nodes, ["dataset", "node"])
        beyond = F.filter("kids", lambda k: (k["i"] - F.col("at")) * side > 0) if past else F.col("kids")
        j = j.withColumn("kids", beyond)
        higher = F.filter("kids", lambda k: k["mx"] > F.col("x"))
        hit = F.when(side < 0, F.element_at(higher, -1)["i"]).otherwise(F.get(higher, 0)["i"])
        j = j.withColumn("hit", F.when(F.size(higher) > 0, hit))
        passed = F.filter("kids", lambda k: F.col("hit").isNull() | ((F.col("hit") - k["i"]) * side > 0))
        low = F.least("low", F.array_min(F.transform(passed, lambda k: k["mn"])))
        at = F.coalesce("hit", F.col("node")) if past else F.col("hit")
        return j.select("dataset", "p", "x", "side", at.alias("at"), low.alias("low"), found.alias("found"))

    for k, nodes in enumerate(levels):  # up: found holds the level of the child that was hit, -1 while there is none
        open_ = ask.where("found < 0")
        up = search(open_, nodes, F.floor(F.col("at") / FANOUT), True, F.when(F.col("hit").isNotNull(), F.lit(k)).otherwise(F.lit(-1)))
        now = scratch.settle(up.unionByName(ask.where("found >= 0")), "searches")
        scratch.drop(ask)
        ask = now
    for k in range(len(levels) - 1, 0, -1):  # down: from a node of level k to its child
        down = search(ask.where(F.col("found") == k), levels[k - 1], F.col("at"), False, F.lit(k - 1))
        now = scratch.settle(down.unionByName(ask.where(F.col("found") != k)), "searches")
        scratch.drop(ask)
        ask = now
    return ask.select("dataset", "p", "side", "low")


def prominent_peaks(df: DataFrame, score: str, height: float, distance: int, prominence: float) -> DataFrame:
    """Height, then distance in rows (higher peaks first, later ones among equals), then prominence.

    Flat peaks count at their middle; rows without a score are skipped over.
    """
    scratch = Scratch(df.sparkSession, "peaks")
    rows = scratch.settle(numbered_scores(df, score), "rows")
    high = flat_peaks(rows, scratch).where(F.col("x") >= height)
    kept = spaced_takers(high.select("dataset", F.col("p").cast("double").alias("at"), F.col("x").alias("score"), (-F.col("p")).alias("tie")), float(distance), scratch)
    kept = scratch.settle(kept.select("dataset", F.col("at").cast("long").alias("p"), F.col("score").alias("x")), "kept")
    floor = side_minima(rows, kept, scratch).groupBy("dataset", "p").agg(F.max("low").alias("floor"))
    found = kept.join(floor, ["dataset", "p"]).withColumn("prominence", F.col("x") - F.col("floor")).where(F.col("prominence") >= prominence)
    out = found.join(rows.select("dataset", "p", "window_index"), ["dataset", "p"]).select("dataset", "window_index", F.col("x").alias("height"), "prominence")
    result = scratch.settle(out, "result")
    scratch.keep(result)
    return result
