"""Forecasters against an offline replay by positions, and their hosts against each other."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.streaming import hosts as H
from strandline.streaming import machines as X

HISTORY, RING = 6, 12


def series(n=260, seed=4, gaps=True):
    rng = np.random.default_rng(seed)
    at = np.cumsum(np.where(rng.random(n) < 0.1, 100.0, 50.0))
    x = np.column_stack([rng.normal(size=n).cumsum() * 0.1 + 0.01 * np.arange(n), rng.normal(size=n)])
    guard = rng.random(n) < 0.15
    y = x[:, 0] + np.where(np.arange(n) > n // 2, 3 * np.sin(np.arange(n) / 4), 0)
    x, y = x.astype(object), y.astype(object)
    if gaps:
        y[[3, 40, 41, n // 2 + 20]] = None
        x[n // 3, 1] = None
    return at, x, y, guard


def rows_of(at, x, y, guard, horizon, frozen):
    return [{"center_cycle": float(a), "inputs": list(v), "value": w, "guard": int(g), "horizon": horizon, "frozen": frozen} for a, v, w, g in zip(at, x, y, guard, strict=True)]


def features(x):
    out = []
    for t in range(len(x)):
        h = np.array([[np.nan if v is None else v for v in r] for r in x[max(0, t - HISTORY + 1) : t + 1]], float)
        out.append(np.concatenate([[1.0], h.mean(0), h.std(0), h[-1] - h[0]]) if len(h) == HISTORY and np.isfinite(h).all() else None)
    return out


def replay(at, x, y, guard, horizon, frozen, freeze=500.0):
    """By positions: a forecast of row t is judged at the first row with a value whose cycle is at least at[t] + horizon."""
    n, xs, w0 = len(at), features(x), np.array(frozen)
    seen = [t for t in range(n) if y[t] is not None]
    judge = {t: next((s for s in seen if at[s] >= at[t] + horizon and s > t), None) for t in seen if xs[t] is not None}
    theta, p = w0.copy(), 100.0 * np.eye(len(w0))
    scores, mode, alpha, thaw, episode, made, out = [], "PROBATION", 0.0, -np.inf, 0, {}, []
    level, cov, last = None, None, None
    for t in range(n):
        if mode == "FROZEN" and at[t] >= thaw:
            mode, alpha, scores = "PROBATION", 0.0, []
        due = sorted(k for k, s in judge.items() if s == t)
        for k in due:
            change = y[t] - y[k]
            scores = [*scores, (abs(made[k][0] - change), abs(made[k][1] - change))][-RING:]
            if mode != "FROZEN" and not guard[k] and not guard[t]:
                errors = np.array(scores)[:, 1]
                limit = 3 * max(1.4826 * np.median(np.abs(errors - np.median(errors))), 1e-9)
                gain = p @ xs[k] / (0.999 + xs[k] @ p @ xs[k])
                gain *= min(1.0, 0.1 / np.linalg.norm(gain))
                theta = theta + gain * np.clip(change - xs[k] @ theta, -limit, limit)
                p = (p - np.outer(gain, xs[k]) @ p) / 0.999
            if len(scores) == RING and mode != "FROZEN":
                (f, o), (f2, o2) = np.abs(scores).mean(0), np.sqrt((np.array(scores) ** 2).mean(0))
                if o > 1.1 * f or o2 > 1.2 * f2:
                    mode, alpha, thaw, episode, theta, p = "FROZEN", 0.0, at[t] + freeze, episode + 1, w0.copy(), 100.0 * np.eye(len(w0))
                elif mode == "PROBATION":
                    mode = "ACTIVE"
                elif o <= 0.95 * f and o2 <= 1.05 * f2:
                    alpha = min(1.0, alpha + 0.05)
        o = {"alpha": alpha, "mode": mode, "episode": episode, "settled": len(due), "safe": None}
        if y[t] is not None:
            if level is None:
                level, cov = np.array([y[t], 0.0]), np.eye(2)
            else:
                dt = max(at[t] - last, 1.0)
                step = np.array([[1, dt], [0, 1]])
                cov = step @ cov @ step.T + np.diag([1e-4 * dt * dt, 1e-7 * dt])
                level = step @ level
                g = cov[:, 0] / (cov[0, 0] + 1e-3)
                level = level + g * (y[t] - level[0])
                cov = (np.eye(2) - np.outer(g, [1, 0])) @ cov
            last = at[t]
            if xs[t] is not None:
                made[t] = (xs[t] @ w0, xs[t] @ theta)
                calm = [s for s in seen if s <= t and not guard[s]][-10:]
                slope = np.median([(y[b] - y[a]) / (at[b] - at[a]) for a, b in zip(calm, calm[1:], strict=False)]) if len(calm) >= 3 else 0.0
                o |= {"zero": y[t], "linear": y[t] + horizon * slope, "kalman": y[t] + horizon * level[1], "frozen": y[t] + made[t][0], "online": y[t] + made[t][1], "safe": y[t] + (1 - alpha) * made[t][0] + alpha * made[t][1]}
        out.append(o)
    return out


@pytest.mark.parametrize(("horizon", "seed"), [(50.0, 4), (100.0, 5), (200.0, 6), (500.0, 7)])
def test_forecaster_equals_the_replay(horizon, seed):
    at, x, y, guard = series(seed=seed)
    frozen = [0.05, -0.1, 0.0, 0.2, 0.0, 0.3, 0.0]
    m = X.Forecaster(history=HISTORY, ring=RING)
    got = [m.step(r) for r in rows_of(at, x, y, guard, horizon, frozen)]
    want = replay(at, x, y, guard, horizon, frozen)
    assert {w["mode"] for w in want} == {"PROBATION", "ACTIVE", "FROZEN"} or horizon > 200
    for g, w in zip(got, want, strict=True):
        assert (g["mode"], g["episode"], g["settled"]) == (w["mode"], w["episode"], w["settled"]) and g["alpha"] == pytest.approx(w["alpha"])
        assert (g["safe"] is None) == (w["safe"] is None)
        for k in ("zero", "linear", "kalman", "frozen", "online", "safe"):
            if w["safe"] is not None:
                assert g[k] == pytest.approx(w[k], rel=1e-7, abs=1e-7), k


def test_reset_restores_the_frozen_weights_and_a_freeze_is_not_prolonged():
    at, x, y, guard = series(gaps=False)
    m, frozen = X.Forecaster(history=HISTORY, ring=RING, freeze=500.0), [0.0] * 7
    began, thaws = None, []
    for r in rows_of(at, x, y, guard, 100.0, frozen):
        before = m.mode
        m.step(r)
        if m.mode == "FROZEN" and before != "FROZEN":
            assert m.online.theta == frozen and m.alpha == 0.0
            began = m.thaw
        if m.mode == "FROZEN":
            assert m.thaw == began and m.online.theta == frozen
        elif before == "FROZEN":
            thaws.append(r["center_cycle"] >= began)
    assert m.episode >= 1 and all(thaws)


def test_without_weights_nothing_is_forecast():
    at, x, y, guard = series(60)
    m = X.Forecaster(history=HISTORY)
    assert all(m.step(r)["safe"] is None for r in rows_of(at, x, y, guard, 50.0, None))


def test_shared_forecaster_equals_the_replay():
    at, x, _, _ = series(120, gaps=False)
    x[50, 1] = None
    w0 = np.array([[0.1, 0, 0, 0.2, 0, 0, 0.1], [0, 0.1, 0, 0, 0.3, 0, 0]])
    m = X.SharedForecaster(HISTORY)
    got = [m.step({"center_cycle": float(a), "inputs": list(v), "values": list(v), "horizon": 100.0, "frozen": w0.tolist()}) for a, v in zip(at, x, strict=True)]
    theta, p, xs = w0.T.copy(), 100.0 * np.eye(7), features(x)
    whole = [t for t in range(len(x)) if all(v is not None for v in x[t])]
    judge = {t: next((s for s in whole if at[s] >= at[t] + 100.0), None) for t in whole if xs[t] is not None}
    for t in range(len(x)):
        for k in sorted(k for k, s in judge.items() if s == t):
            gain = p @ xs[k] / (0.995 + xs[k] @ p @ xs[k])
            theta = theta + np.outer(gain, (x[t] - x[k]).astype(float) - xs[k] @ theta)
            p = (p - np.outer(gain, xs[k]) @ p) / 0.995
        if t in judge:
            assert np.allclose(got[t]["online"], x[t].astype(float) + xs[t] @ theta, rtol=1e-6) and np.allclose(got[t]["frozen"], x[t].astype(float) + xs[t] @ w0.T)
        else:
            assert got[t]["online"] is None


def test_snapshots_replay_to_the_same_result():
    rows = rows_of(*series(160), 100.0, [0.0, 0.1, 0.0, 0.0, 0.2, 0.0, 0.1])
    m = X.Forecaster(history=HISTORY, ring=RING)
    for r in rows[:80]:
        m.step(r)
    saved = m.state()
    tail = [m.step(r) for r in rows[80:]]
    m.restore(saved)
    assert [m.step(r) for r in rows[80:]] == tail and sum(o["settled"] for o in tail) > 40


def test_timed_host_agrees_with_the_backfill(spark, tmp_path):
    """Rows in files of any order: the event-time timers step them as the sorted backfill does."""
    frames = []
    for k, name in enumerate(("a", "b")):
        at, x, y, guard = series(90, seed=k)
        frames.append(pd.DataFrame({"dataset": name, "horizon": 100.0, "window_index": range(90), "center_cycle": at, "guard": guard.astype(int), "value": y.astype(float), "inputs": [[None if v is None else float(v) for v in r] for r in x], "frozen": [[0.0, 0.1, 0.0, 0.0, 0.2, 0.0, 0.1]] * 90}))
    schema = "dataset string, horizon double, window_index long, center_cycle double, guard int, value double, inputs array<double>, frozen array<double>"
    rows = spark.createDataFrame(pd.concat(frames), schema).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    rows = rows.withColumn("ts", F.timestamp_seconds(F.col("window_index") * 60 + 1_700_000_000))
    out_schema = "dataset string, horizon double, window_index long, online double, safe double, alpha double, mode string, settled int"
    columns, keys = ["online", "safe", "alpha", "mode", "settled"], ["dataset", "horizon"]
    make = lambda: X.Forecaster(history=6, ring=12)
    batch = H.backfill(rows.drop("ts"), keys, "window_index", make, out_schema, columns).toPandas().sort_values(["dataset", "window_index"], ignore_index=True)
    src = str(tmp_path / "in")
    parts = [rows.where(f"pmod(window_index * 7, 30) >= {10 * k} AND pmod(window_index * 7, 30) < {10 * k + 10} AND window_index < 60") for k in range(3)] + [rows.where("window_index >= 60")]
    closing = rows.where("window_index = 0").withColumn("ts", F.timestamp_seconds(F.lit(1_800_000_000))).withColumn("window_index", F.lit(10_000).cast("long"))
    for k, part in enumerate([*parts, closing, closing.withColumn("window_index", F.lit(10_001).cast("long"))]):
        part.coalesce(1).write.parquet(f"{src}/{k}")
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(src)
    got = []
    out = H.streaming_timed(stream, keys, "window_index", "ts", "3 hours", make, out_schema, columns)
    q = out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: got.append(df.toPandas())).trigger(availableNow=True).start()
    q.awaitTermination(400)
    online = pd.concat(got).query("window_index < 90").sort_values(["dataset", "window_index"], ignore_index=True)
    assert len(online) == len(batch) == 180
    for c in columns:
        assert online[c].astype(object).where(online[c].notna(), None).tolist() == batch[c].astype(object).where(batch[c].notna(), None).tolist(), c
