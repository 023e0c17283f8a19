"""Streams of repeated rows, and long ones: shifts that vanish, axes without length, joins planned anew, costs of a step."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import evaluation as E
from strandline.operators import joins as J
from strandline.plans import base as B
from strandline.plans import extra
from strandline.streaming import hosts as H
from strandline.streaming import machines as X


def test_weights_of_a_stream_without_a_shift(spark, monkeypatch):
    """Shares of nothing are NaN, as 0 / 0 is in SQL; a feature that lacks a stage has no share."""
    z = {"still": {"a": (1.0, 1.02), "b": (2.0, 2.0)}, "moved": {"a": (0.0, 3.0), "b": (0.0, -1.0), "c": (0.0, 0.01)}, "part": {"a": (0.0, 2.0), "b": (1.0, None)}}
    rows = [(d, f, k, x) for d, fs in z.items() for f, ends in fs.items() for k, x in zip((1, 5), ends, strict=True) if x is not None]
    monkeypatch.setattr(B, "z_long", lambda s, sf: s.createDataFrame(rows, "dataset string, feature_name string, stage int, z_value double"))
    got = {(r["dataset"], r["feature_name"]): r["weight"] for r in extra.feature_weights(spark, "").collect()}
    assert all(math.isnan(got["still", f]) for f in "ab")
    assert [got["moved", f] for f in "abc"] == [0.75, 0.25, 0.0]
    assert got["part", "a"] == 1.0 and got["part", "b"] is None


def test_branches_along_an_axis_without_length(spark):
    shifts = spark.createDataFrame([("a", 0.07, -0.03, 0.0), ("b", 0.06, 0.2, 0.0)], "feature_name string, d1 double, d2 double, axis double")
    got = E.branch_axis(shifts).collect()
    assert len(got) == 2 and all(math.isnan(r[c]) for r in got for c in ("residual1", "residual2", "weight"))


def test_streams_stay_whole_where_a_join_is_planned_anew(spark):
    """A join by stream that is planned by shuffles and run by a broadcast scatters its rows; the replay gathers them."""
    rows = spark.range(0, 3000, 1, 8).select((F.col("id") % 3).cast("string").alias("dataset"), F.floor(F.col("id") / 3).alias("window_index")).withColumn("x", F.xxhash64("dataset", "window_index") % 10)
    limits = rows.groupBy("dataset").agg(F.percentile("x", F.lit(0.3)).alias("limit"))
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10KB")  # less than the rows, more than the limits
        joined = rows.join(limits, "dataset").select("dataset", "window_index", (F.col("x") > F.col("limit")).alias("condition"), F.lit(0).alias("guard"))
        replayed = H.backfill(joined, ["dataset"], "window_index", lambda: X.Evidence(confirm=1e9), "dataset string, window_index long, success double, failure double, phase string", ["success", "failure", "phase"])
        got, fed = replayed.collect(), joined.collect()
        assert "REPARTITION_BY_NUM" in replayed._jdf.queryExecution().executedPlan().toString()  # the shuffle is not left out
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(got) == 3000
    want = {}
    for name in "012":
        machine = X.Evidence(confirm=1e9)
        for r in sorted((r for r in fed if r["dataset"] == name), key=lambda r: r["window_index"]):
            want[name, r["window_index"]] = machine.step(r.asDict())
    assert {(r["dataset"], r["window_index"]): {k: r[k] for k in ("success", "failure", "phase")} for r in got} == want


def test_due_rows_are_looked_for_in_a_bounded_frame(spark):
    """Against all later rows, with gaps; a frame without an end would cost the square of a chunk."""
    at = [k for k in range(400) if k % 7 and not 100 <= k < 110]
    rows = spark.createDataFrame([("s", k, 5.0 * k, float(k)) for k in at], "dataset string, window_index long, center_cycle double, x double")
    made = J.forward_asof(rows, 103, "x")
    assert "unboundedfollowing" not in made._jdf.queryExecution().executedPlan().toString().lower()
    want = {k: min((j for j in at if 5.0 * j >= 5.0 * k + 103), default=None) for k in at}
    assert {r["window_index"]: r["due_index"] for r in made.collect()} == want


@pytest.mark.parametrize("n", [1, 2, 3, 10, 49, 50, 300])
def test_medians_of_sorted_values(n):
    rng = np.random.default_rng(n)
    for x in (rng.normal(size=n), rng.integers(0, 4, size=n).astype(float), np.full(n, 0.1)):
        v = sorted(x.tolist())
        mid = X.sorted_middle(v)
        assert mid == float(np.median(x)) and X.sorted_deviation(v, mid) == float(np.median(np.abs(x - mid)))


def test_regimes_keep_their_rows_sorted():
    """Level and scale at each step are those of the rows that are kept, a missing level among them included."""
    rng, machine, stages = np.random.default_rng(5), X.RegimeDiscovery(least=5, dwell=20, memory=40), set()
    for i, x in enumerate((rng.normal(size=900) * 0.3 + np.repeat(np.arange(9) * 4, 100)).tolist()):
        x = math.nan if i == 150 else x
        mid, scale = X.middle(machine.rows), X.spread(machine.rows, 1e-3) if machine.rows else 1.0
        want = abs(x - mid) / scale if machine.rows else 0.0
        made = machine.step({"level": x, "guard": i % 10 == 0})
        assert made["score"] == want or (math.isnan(made["score"]) and math.isnan(want))
        stages.add(made["stage"])
    assert stages == {1, 2, 3, 4, 5} and machine.ordered == sorted(machine.rows)


def test_machines_side_by_side_share_the_work_of_tasks(spark):
    rows = spark.range(90).select(F.lit("s").alias("dataset"), F.col("id").alias("window_index"), (F.floor(F.col("id") / 45) * 8 + F.col("id") % 3).cast("double").alias("level"), F.lit(0).alias("guard"))
    makes = [lambda d=d: X.RegimeDiscovery(least=3, dwell=d) for d in (10, 20, 30, 40)]
    sets = [H.changes(rows, ["dataset"], "window_index", makes, "stage", width=w) for w in (1, 3, 4)]
    one, three, four = (sorted((r["cell"], r["window_index"], r["stage"]) for r in df.collect()) for df in sets)
    assert one == three == four and {c for c, _, s in one if s > 1} == {0, 1, 2, 3}
