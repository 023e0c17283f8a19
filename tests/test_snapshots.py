"""Snapshots of machines: kept by the backfill, read from a stream's state store, and resumed; machines side by side."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.streaming import hosts as H
from strandline.streaming import machines as X

SCHEMA = "dataset string, horizon double, window_index long, center_cycle double, guard int, value double, inputs array<double>, frozen array<double>"
OUT, COLUMNS, KEYS = "dataset string, horizon double, window_index long, online double, safe double, alpha double, mode string, settled int", ["online", "safe", "alpha", "mode", "settled"], ["dataset", "horizon"]


make = lambda: X.Forecaster(history=6, ring=12)


@pytest.fixture(scope="module")
def rows(spark):
    rng, frames = np.random.default_rng(3), []
    for name in ("a", "b"):
        x = rng.normal(size=(120, 2)).cumsum(axis=0) * 0.2
        frames.append(pd.DataFrame({"dataset": name, "horizon": 100.0, "window_index": range(120), "center_cycle": 50.0 * np.arange(120) + 10, "guard": (np.arange(120) % 10 == 0).astype(int), "value": x[:, 0], "inputs": x.tolist(), "frozen": [[0.0, 0.1, 0.0, 0.0, 0.2, 0.0, 0.1]] * 120}))
    return spark.createDataFrame(pd.concat(frames), SCHEMA).persist()


def sorted_rows(df):
    return df.toPandas().sort_values(["dataset", "window_index"], ignore_index=True)


def test_resumed_from_kept_states(spark, rows):
    whole = sorted_rows(H.backfill(rows, KEYS, "window_index", make, OUT, COLUMNS))
    for cut in (0, 17, 60, 118):
        kept = H.snapshots(rows.withColumn("mark", F.col("window_index") == cut), KEYS, "window_index", "mark", make)
        assert kept.count() == 2
        first = kept.select(*KEYS, (F.col("window_index") + 1).alias("window_index"), "body")
        again = rows.where(F.col("window_index") > cut).join(first, [*KEYS, "window_index"], "left")
        got = sorted_rows(H.backfill(again, KEYS, "window_index", make, OUT, COLUMNS, snapshot="body"))
        pd.testing.assert_frame_equal(got, whole[whole["window_index"] > cut].reset_index(drop=True))


def test_resumed_from_the_state_store(spark, rows, tmp_path):
    """Half of the rows go through a stream; the state data source reads its checkpoint, and a backfill goes on from there."""
    src, half = str(tmp_path / "in"), rows.where("window_index < 60")
    half.coalesce(1).write.parquet(f"{src}/0")
    out = H.streaming(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(src), KEYS, "window_index", make, OUT, COLUMNS)
    q = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: df.count()).trigger(availableNow=True).start()
    q.awaitTermination(240)
    state = spark.read.format("statestore").option("stateVarName", "machine").load(str(tmp_path / "cp"))
    first = state.select("key.dataset", "key.horizon", F.lit(60).cast("long").alias("window_index"), F.col("value.body").alias("body"))
    assert {json.loads(r["body"])["mode"] for r in first.collect()} <= {"PROBATION", "ACTIVE", "FROZEN"}
    again = rows.where("window_index >= 60").join(first, [*KEYS, "window_index"], "left")
    got = sorted_rows(H.backfill(again, KEYS, "window_index", make, OUT, COLUMNS, snapshot="body"))
    whole = sorted_rows(H.backfill(rows, KEYS, "window_index", make, OUT, COLUMNS))
    pd.testing.assert_frame_equal(got, whole[whole["window_index"] >= 60].reset_index(drop=True))


def test_machines_side_by_side(spark):
    rng = np.random.default_rng(5)
    level = rng.normal(0, 0.1, 600) + np.where(np.arange(600) > 250, 2.0, 0) + np.where(np.arange(600) > 420, 2.0, 0)
    df = spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(level)], "dataset string, window_index long, level double")
    grid = [(t, least, dwell) for t in (2.0, 4.0) for least in (10, 30) for dwell in (20, 60)]
    got = H.changes(df, ["dataset"], "window_index", [lambda p=p: X.RegimeDiscovery(threshold=p[0], least=p[1], dwell=p[2]) for p in grid], "stage").collect()
    made = {}
    for r in sorted(got, key=lambda r: r["window_index"]):
        made.setdefault(r["cell"], []).append((r["window_index"], r["stage"]))
    for i, p in enumerate(grid):
        m, want = X.RegimeDiscovery(threshold=p[0], least=p[1], dwell=p[2]), []
        for k, v in enumerate(level):
            stage = m.step({"level": float(v)})["stage"]
            if not want or want[-1][1] != stage:
                want.append((k, stage))
        assert made[i] == want
    assert max(s for cell in made.values() for _, s in cell) >= 3
