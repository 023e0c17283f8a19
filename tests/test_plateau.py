"""Plateau, exit and severe direction on streams that are made to go through them, against rules stated apart."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.operators import rolling as R
from strandline.operators import streams as S
from strandline.plans import catalog as C
from strandline.streaming import hosts as H
from strandline.streaming import machines as X

PRIOR = {"d95": 1.0, "v50": 0.5, "v100": 0.5, "vol": 1.0}


def velocity(x, t, k):
    return np.median(x[t - k // 2 + 1 : t + 1], axis=0) - np.median(x[t - k + 1 : t - k // 2 + 1], axis=0) if t + 1 >= k else np.zeros(x.shape[1])


def stream(n=1000, rise=220, leave=620, seed=2, guards=True):
    """A baseline, a plateau away from it, and a steady drift out of the plateau along one direction."""
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    x = rng.normal(size=(n, 3)) * 0.05
    x += np.where(t > rise, np.minimum((t - rise) / 20, 3.0), 0.0)[:, None] * [1.0, 0.5, 0.0]
    x += np.where(t > leave, (t - leave) * 0.03, 0.0)[:, None] * [0.6, 0.0, 0.8]
    centre = 5.0 * t + 10.5
    guard = (centre % 500 <= 100).astype(int) if guards else np.zeros(n, int)
    rows = []
    for k in range(n):
        vol = np.linalg.norm(x[max(0, k - 49) : k + 1] - np.median(x[max(0, k - 49) : k + 1], axis=0), axis=1)
        rows.append({"center_cycle": float(centre[k]), "guard": int(guard[k]), "r": x[k].tolist(), "d": float(np.linalg.norm(x[k])), "v20": velocity(x, k, 20).tolist(), "v50": velocity(x, k, 50).tolist(), "v100": velocity(x, k, 100).tolist(), "vol": float(np.median(np.abs(vol - np.median(vol)))), "oos": 0.0, "prior": PRIOR})
    return rows


def run(rows, **options):
    m = X.PlateauEngine(600.0, **options)
    return m, [m.step(r) for r in rows]


def test_lock_crosses_guards_and_its_reference_never_changes():
    rows = stream()
    m, out = run(rows)
    lock = next(k for k, o in enumerate(out) if o["locked_at"] is not None)
    ok = [not r["guard"] and r["center_cycle"] >= 600 and r["d"] > 1 and np.linalg.norm(r["v50"]) < 0.5 and np.linalg.norm(r["v100"]) < 0.5 and r["vol"] < 1 for r in rows]
    first = next(k for k in range(260, len(rows)) if ok[k])  # what qualified while the stream rose is long forgotten
    assert out[lock]["locked_at"] == rows[lock]["center_cycle"] and sum(ok[first : lock + 1]) == 100  # 500 valid cycles
    assert sum(1 for k in range(first, lock) if rows[k]["guard"] and not rows[k - 1]["guard"]) >= 1
    used = np.array([rows[k]["r"] for k in range(lock + 1) if ok[k]][-100:])
    assert np.allclose(m.reference["centre"], np.median(used, axis=0))
    _, again = run(rows[: lock + 200])
    assert [o["distance"] for o in again] == [o["distance"] for o in out[: lock + 200]]


def test_instability_and_exit():
    rows = stream()
    m, out = run(rows)
    lock = next(k for k, o in enumerate(out) if o["locked_at"] is not None)
    f, a20 = m.reference, []
    for k, r in enumerate(rows):
        n20, n100 = np.linalg.norm(r["v20"]), np.linalg.norm(r["v100"])
        a20.append(n20 - n100)
        if k >= lock:
            d = np.array(r["r"]) - f["centre"]
            away = np.sqrt(d @ np.array(f["inverse"]) @ d)
            cosine = np.dot(r["v20"], r["v100"]) / max(n20 * n100, 1e-9)
            z = lambda key, v: (v - f[key][0]) / f[key][1]
            want = 0.35 * z("d", away) + 0.25 * z("v", np.linalg.norm(r["v50"])) + 0.2 * z("a", max(np.median(a20[-20:]), 0)) + 0.2 * max(cosine, 0)
            assert out[k]["instability"] == pytest.approx(want, rel=1e-9)
        else:
            assert out[k]["instability"] is None
    leave = next(k for k, o in enumerate(out) if o["exit_at"] is not None)
    assert leave > 620 and all(o["exit"] != "confirmed" for o in out[:leave])


def test_direction_is_learned_after_the_exit_only():
    rows = stream()
    m, out = run(rows)
    leave = next(k for k, o in enumerate(out) if o["exit_at"] is not None)
    assert all(o["event"] == "" and o["direction"] is None and o["severe_score"] is None for o in out[:leave])
    events = {o["event"] for o in out[leave:]}
    assert "UPDATED" in events and "RESTART_GUARD" in events
    assert all(o["event"] == "RESTART_GUARD" for r, o in zip(rows[leave:], out[leave:], strict=True) if r["guard"])
    assert np.dot(out[-1]["direction"], [0.6, 0.0, 0.8]) > 0.95 and np.linalg.norm(out[-1]["direction"]) == pytest.approx(1.0)
    assert out[-1]["severe"] == "confirmed" and out[-1]["severe_at"] >= out[-1]["exit_at"] and out[-1]["severe_50"] > 2
    before = None
    for k in range(leave, len(rows)):  # the moving average, replayed from the rows
        if out[k]["event"] == "UPDATED":
            free = np.array([r["r"] for r in rows[: k + 1] if not r["guard"]][-100:])
            new = np.median(free, axis=0) - m.reference["centre"]
            new = new / np.linalg.norm(new)
            mixed = new if before is None else 0.99 * before + 0.01 * new
            before = mixed / np.linalg.norm(mixed)
        assert before is None or np.allclose(out[k]["direction"], before)


@pytest.mark.parametrize(("change", "reason"), [({"oos": 0.9}, "UNSUPPORTED"), ({"v20": [-1.0, 0.0, 0.0]}, "INCONSISTENT"), ({"v50": [0.0, 0.0, 0.0]}, "SLOW")])
def test_reasons_against_learning(change, reason):
    rows = stream(guards=False)
    leave = next(k for k, o in enumerate(run(rows)[1]) if o["exit_at"] is not None)
    m, out = run(rows[: leave + 1])
    assert m.step({**rows[leave + 1], **change})["event"] == reason
    turned = X.PlateauEngine(600.0)
    turned.restore(m.state())
    turned.direction = [-x for x in m.direction or [0.6, 0.0, 0.8]]
    assert turned.step(rows[leave + 1])["event"] == "TURNED"


def test_source_direction_counts_from_the_lock_on():
    rows = [{**r, "severe": [0.6, 0.0, 0.8]} for r in stream()]
    _, out = run(rows)
    lock = next(k for k, o in enumerate(out) if o["locked_at"] is not None)
    assert all(o["severe_score"] is None for o in out[:lock]) and all(o["severe_score"] is not None for o in out[lock:])


def test_elapsed_cycles_break_at_guards():
    _, paused = run(stream())
    _, broken = run(stream(), elapsed=True)
    _, free = run(stream(guards=False), elapsed=True)
    assert paused[-1]["locked_at"] is not None and broken[-1]["locked_at"] is None and free[-1]["locked_at"] is not None


def test_snapshots_replay(spark):
    rows = stream()
    m, out = run(rows[:700])
    saved = m.state()
    tail = [m.step(r) for r in rows[700:]]
    m.restore(saved)
    assert [m.step(r) for r in rows[700:]] == tail


def test_rolling_volatility(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([("s", k + 1, float(a), float(b)) for k, (a, b) in enumerate(x)], "dataset string, _at long, a double, b double")
    got = S.framed(df, ["dataset"], "_at", {"vol": R.rolling_volatility(["a", "b"], 30)}, 29, rows=64).orderBy("_at").toPandas()["vol"]
    for t in range(300):
        p = x[max(0, t - 29) : t + 1]
        r = np.linalg.norm(p - np.median(p, axis=0), axis=1)
        assert got[t] == pytest.approx(np.median(np.abs(r - np.median(r))), abs=1e-12)


def test_priors_come_from_the_source_and_never_from_labels(spark):
    """Two streams: limits are the source's, and a target's result is the same whatever its labels say."""
    frames = []
    for name, seed in (("a", 2), ("b", 3)):
        for k, r in enumerate(stream(seed=seed)):
            frames.append((name, k, r["center_cycle"], int(r["center_cycle"] < 500), r["guard"], r["r"], r["d"], r["v20"], r["v50"], r["v100"], r["vol"]))
    rows = spark.createDataFrame(frames, "dataset string, window_index long, center_cycle double, baseline_window int, guard int, r array<double>, d double, v20 array<double>, v50 array<double>, v100 array<double>, vol double")
    table = C.priors(rows)
    prior = {r["dataset"]: r for r in table.collect()}
    for name, seed in (("a", 2), ("b", 3)):
        own = stream(seed=seed)
        late = [r for r in own if not r["guard"] and r["center_cycle"] >= 600]
        assert prior[name]["v50"] == pytest.approx(np.quantile([np.linalg.norm(r["v50"]) for r in late], 0.75)) and prior[name]["vol"] == pytest.approx(np.quantile([r["vol"] for r in late], 0.75))
        assert prior[name]["d95"] == pytest.approx(np.quantile([r["d"] for r in own if r["center_cycle"] < 500], 0.95))
    given = {r["dataset"]: r["v50"] for r in C.handed_on(rows, table).collect()}
    assert given == {"a": prior["b"]["v50"], "b": prior["a"]["v50"]}
    got = {(r["dataset"], r["window_index"]): r for r in C.plateau_run(rows, C.handed_on(rows, table)).collect()}
    for name, seed, source in (("a", 2, "b"), ("b", 3, "a")):
        limits = {k: prior[source][k] for k in ("d95", "v50", "v100", "vol")}
        m = X.PlateauEngine(C.PLATEAU_CYCLE)
        low, high = np.array(prior[source]["low"]), np.array(prior[source]["high"])
        for k, r in enumerate(stream(seed=seed)):
            v = np.array(r["r"])
            o = m.step({**r, "prior": limits, "oos": float(((v < low) | (v > high)).mean())})
            assert (got[name, k]["plateau"], got[name, k]["exit"], got[name, k]["event"]) == (o["plateau"], o["exit"], o["event"])
    shuffled = rows.withColumn("stage", (F.pmod(F.xxhash64("window_index"), F.lit(5)) + 1).cast("int"))
    with pytest.raises(ValueError, match="label"):
        S.forbid_columns(shuffled)
    again = {(r["dataset"], r["window_index"]): r["event"] for r in C.plateau_run(S.drop_labels(shuffled), C.handed_on(rows, C.priors(shuffled))).collect()}
    assert again == {k: r["event"] for k, r in got.items()}


def test_vector_moves_are_those_of_the_window_functions(spark):
    """All frames of a chunk at once give the very values of a window function for each, missing values included."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 2)).round(2)
    df = spark.createDataFrame([(s, k + 1, float(a), None if s == "b" and k % 37 < 12 else float(b)) for s in "ab" for k, (a, b) in enumerate(x[: 400 if s == "a" else 150])], "dataset string, _at long, a double, b double")
    columns = {f"v{n}_{c}": R.half_difference(c, n) for n in (20, 50, 100) for c in "ab"} | {"vol": R.rolling_volatility(["a", "b"], 50)}
    want = S.framed(df, ["dataset"], "_at", columns, 99, rows=128).orderBy("dataset", "_at").collect()
    got = R.vector_moves(df, ["dataset"], "_at", ["a", "b"], (20, 50, 100), 50, rows=128).orderBy("dataset", "_at").collect()
    assert len(got) == len(want) == 550
    for g, w in zip(got, want, strict=True):
        assert [g["dataset"], g["_at"], g["v20"], g["v50"], g["v100"], g["vol"]] == [w["dataset"], w["_at"], *([w[f"v{n}_{c}"] for c in "ab"] for n in (20, 50, 100)), w["vol"]]


def test_a_step_of_the_plateau_sorts_no_arrays(monkeypatch):
    """A step is a few sums and short sorted lists; arrays are made once, when the plateau locks."""
    calls = []
    for name in ("array", "median"):
        monkeypatch.setattr(np, name, lambda *a, _f=getattr(np, name), **k: calls.append(1) or _f(*a, **k))
    rows = stream()
    calls.clear()
    _, out = run(rows)
    assert out[-1]["exit_at"] is not None and len(calls) < 50


def test_rows_reach_a_machine_as_plain_values(spark):
    """Whole columns at a time give what a row at a time gave: NaN is None but in structs, missing lists and structs stay missing."""
    schema = pa.schema([("k", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("x", pa.float64()), ("v", pa.list_(pa.float64())), ("s", pa.struct([("p", pa.list_(pa.list_(pa.float64()))), ("q", pa.float64())]))])
    nan = float("nan")
    rows = [
        {"k": "a", "at": 1, "n": None, "x": nan, "v": [1.0, nan, None], "s": {"p": [[1.0], [2.0, None]], "q": 0.5}},
        {"k": None, "at": 2, "n": 3, "x": 1.0, "v": None, "s": None},
        {"k": "b", "at": 3, "n": 4, "x": None, "v": [], "s": {"p": None, "q": None}},
        {"k": "b", "at": 4, "n": 5, "x": 2.0, "v": [4.0], "s": {"p": [], "q": 1.5}},
    ]
    batch = pa.RecordBatch.from_pylist(rows, schema=schema)
    for part in (batch, batch.slice(1), batch.slice(3), batch.slice(1, 2)):
        assert list(H._records(part, ["k", "at"])) == [{k: H._plain(v) for k, v in r.items()} for r in part.to_pylist()]
