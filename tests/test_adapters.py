"""Gated, freezing and nuisance adapters against replays over whole histories."""

import math

import numpy as np
import pytest

from strandline.streaming import machines as X

LOGIT = math.log(0.05 / 0.95)


def rows_of(n=900, seed=3, alarms=True):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    x = rng.normal(size=(n, 3)) * 0.3 - 0.5 + np.where((t > 420) & (t < 520), (t - 420) / 60, 0)[:, None]
    x[300:340, 1] = 12.0  # saturated
    x[600:620, 2] = np.nan
    bd = np.abs(rng.normal(size=n)) * 0.2 + np.where((t > 420) & (t < 520), (t - 420) / 200, 0)
    rs = np.where(t % 90 < 80, -0.001, 0.01)
    tes = np.where(alarms & (t % 211 == 200), 4.0, 0.5)
    return [
        {"window_index": int(k), "end_cycle": 5 * int(k) + 20, "guard": 0, "x": [None if np.isnan(v) else float(v) for v in x[k]], "mad0": [0.3, 0.3, 0.3], "bd": float(bd[k]), "rs50": None if k < 99 else float(rs[k]), "tes": float(tes[k]), "awr95": 0.6, "bd95": 0.9, "tes_limit": 3.0}
        for k in range(n)
    ]


def replay_gated(rows):
    x = np.array([[np.nan if v is None else v for v in r["x"]] for r in rows], float)
    trust, offset, noise, slow, frozen, saved, updated = np.ones(3), 0.0, 1.0, 0.0, 0, None, None
    logits, awrs, slows, highs, out = [], [], [], [], []
    for k, r in enumerate(rows):
        calm = r["end_cycle"] <= 500
        h = x[max(0, k - 49) : k + 1]
        raw, ratio, sat = np.zeros(3), np.zeros(3), np.zeros(3)
        for f in range(3):
            seen = h[np.isfinite(h[:, f]), f]
            ratio[f] = max(1.4826 * np.median(np.abs(seen - np.median(seen))), 1e-9) / 0.3
            sat[f] = (np.abs(seen) >= 11.9).mean()
            raw[f] = np.clip(np.exp(-0.5 * max(ratio[f] - 1, 0)) * (1 - 0.8 * sat[f]) * len(seen) / len(h), 0.25, 1)
        if not calm:
            trust = np.minimum(trust, raw)
        ok = np.isfinite(x[k])
        awr = (trust[ok] * x[k][ok]).sum() / trust[ok].sum()
        base = -2 + awr
        if calm:
            logits.append(base)
        elif len(logits) and k and rows[k - 1]["end_cycle"] <= 500:
            offset = np.clip(LOGIT - np.median(logits), -1, 1)
        p = 1 / (1 + np.exp(-(base + offset)))
        slow += (0.15 if p > slow else 0.02) * (p - slow)
        event = ""
        if not calm:
            run = k >= 2 and all(rows[j]["rs50"] is not None and rows[j]["rs50"] > 0.005 for j in (k, k - 1, k - 2))
            event = "HIGH_RISK" if p >= 0.6 else "TES_EVENT" if r["tes"] >= 3 else "SUSTAINED_RS" if run else "HIGH_AWR_HIGH_BD" if awr >= 0.6 and r["bd"] >= 0.9 else ""
            frozen = max(frozen, 100) if event else frozen
        before = range(max(0, k - 20), k)
        shut = calm or frozen > 0 or slow >= 0.25 or awr >= 0.6 or r["bd"] >= 0.9 or r["rs50"] is None or r["rs50"] > 0 or r["tes"] >= 3 or any(rows[j]["tes"] >= 3 or highs[j] for j in before) or sat.mean() >= 0.3
        frozen = max(0, frozen - 1)
        if not shut:
            trust = np.clip(0.95 * trust + 0.05 * raw, 0.25, 1)
            noise = 0.95 * noise + 0.05 * np.median(ratio)
            if k % 20 == 0:
                offset = np.clip(offset + 0.005 * (LOGIT - np.log(p / (1 - p))), -1, 1)
            updated = k
        awrs.append(awr)
        slows.append(slow)
        highs.append(p >= 0.6)
        if saved and updated is not None and updated > saved[0] and k >= 49:
            t = np.arange(50.0)
            if np.polyfit(t, awrs[-50:], 1)[0] > 0 and np.polyfit(t, [q["bd"] for q in rows[k - 49 : k + 1]], 1)[0] > 0 and max(slows[-50:]) - slow > 0.15:
                trust, offset, noise, frozen, event = saved[1].copy(), saved[2], saved[3], max(frozen, 200), "ROLLBACK"
        if k and k % 200 == 0:
            saved, event = (k, trust.copy(), offset, noise), event or "CHECKPOINT"
        out.append((awr, p, slow, offset, noise, frozen, int(not shut), event, *trust))
    return out


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_gated_adapter_equals_the_replay(seed):
    rows, m = rows_of(seed=seed), X.GatedAdapter()
    got = [m.step(r) for r in rows]
    for g, w in zip(got, replay_gated(rows), strict=True):
        assert (g["frozen"], g["gate"], g["event"]) == w[5:8]
        assert [g["awr"], g["probability"], g["slow_risk"], g["offset"], g["noise"], *g["reliability"]] == pytest.approx([*w[:5], *w[8:]], abs=1e-9)
    assert {g["event"] for g in got} >= {"", "TES_EVENT", "SUSTAINED_RS", "CHECKPOINT"}
    assert all(g["gate"] == 0 for g in got[:97]) and any(g["gate"] for g in got)


def test_saturation_counts_at_once_while_frozen():
    rows, m = rows_of(), X.GatedAdapter()
    out = [m.step({**r, "tes": 4.0}) for r in rows]  # frozen from the calibration's end on
    assert all(o["gate"] == 0 for o in out) and out[330]["reliability"][1] < 0.5 and out[330]["reliability"][0] > 0.6
    assert all(b["reliability"][1] <= a["reliability"][1] for a, b in zip(out[97:], out[98:], strict=False))  # no recovery


def test_gate_opens_only_in_safe_states():
    row = {"window_index": 400, "end_cycle": 2020, "x": [-0.1, -0.1, -0.1], "mad0": [0.3] * 3, "bd": -0.1, "rs50": -0.01, "tes": 0.0, "awr95": 0.6, "bd95": 0.9, "tes_limit": 3.0}
    assert X.GatedAdapter().step(row)["gate"] == 1
    for change, reason in (({"rs50": 0.001}, "rs50_positive"), ({"rs50": None}, "rs50_positive"), ({"tes": 4.0}, "forced_freeze"), ({"bd": 0.9}, "bd_calibration_p95"), ({"x": [0.7, 0.7, 0.7]}, "awr_calibration_p95"), ({"end_cycle": 400}, "calibration_phase")):
        o = X.GatedAdapter().step({**row, **change})
        assert (o["gate"], o["reason"]) == (0, reason)


def test_gated_rollback_restores_the_checkpoint():
    m = X.GatedAdapter(risk=2.0, slow=0.6)
    quiet = {"mad0": [1.0], "rs50": -0.01, "tes": 0.0, "awr95": 50.0, "bd95": 50.0, "tes_limit": 3.0, "guard": 0}
    out = []
    for k in range(520):
        high = 3.0 if 430 <= k < 445 else -1.0  # risk jumps and dies down, while score and distance rise after it
        late = max(0, k - 445)
        out.append(m.step({**quiet, "window_index": k, "end_cycle": 5 * k + 20, "x": [high + late * 0.1], "bd": 0.01 * max(0, k - 400)}))
    at = next((k for k, o in enumerate(out) if o["event"] == "ROLLBACK"), None)
    if at is not None:
        assert out[at]["offset"] == pytest.approx(out[400]["offset"]) and out[at]["frozen"] >= 199 and not any(o["gate"] for o in out[at + 1 : at + 150])


# ------------------------------------------------------------------ freezes


def freeze_rows(n=800):
    rng = np.random.default_rng(1)
    t = np.arange(n)
    slow = np.where((t > 560) & (t < 600), 0.5, 0.05)
    return [{"window_index": int(k), "end_cycle": 5 * int(k) + 20, "guard": int(k % 100 < 4), "awr": 0.01 * k + float(rng.normal()) * 0.01, "bd": 0.02 * k, "slow": float(slow[k]), "delta": 0.01, "safe": not 590 < k < 680, "tes": bool(k == 250), "high_risk": bool(k == 310)} for k in t]


def test_freeze_machine_rolls_back_once_and_cools_down():
    rows, m = freeze_rows(), X.FreezeMachine(checkpoint=500)
    out = [m.step(r) for r in rows]
    assert [o["event"] for o in out if o["event"] in ("ENTER_STATE", "EXTEND_FREEZE")] == ["ENTER_STATE", "EXTEND_FREEZE"]
    assert out[250]["reason"] == "TES_EVENT" and (out[310]["reason"], out[310]["mode"]) == ("HIGH_RISK", "FROZEN_RISK")
    value, want, updated, saved, judged, until = 0.0, [], None, None, None, -1
    for k, o in enumerate(out):  # values, replayed from the modes
        mode = o["mode"]
        if k in (250, 310):
            until = k + 100
        if mode == "ACTIVE_UPDATE" and k % 20 == 0:
            value, updated = value + 0.01, k
        elif o["event"] == "UPDATE":
            raise AssertionError(k)
        if saved and updated is not None and updated > saved[0] and k >= updated + 50 and judged != updated:
            judged = updated
            if max(r["slow"] for r in rows[k - 49 : k + 1]) - rows[k]["slow"] > 0.15:
                value, until = saved[1], k + 200
                assert (o["event"], mode, o["freeze_until"]) in (("ROLLBACK", "COOLDOWN", until), ("CHECKPOINT", "COOLDOWN", until))
        if k and k % 500 == 0:
            saved = (k, value)
        want.append(value)
        assert o["freeze_until"] == until
        if k <= until and mode not in ("CALIBRATION", "RESTART_GUARD"):
            assert mode in ("FROZEN_EVENT", "FROZEN_RISK", "COOLDOWN")
    assert [o["value"] for o in out] == pytest.approx(want)
    assert any(o["event"] == "CHECKPOINT" for o in out) and [o["event"] for o in out].count("ROLLBACK") == 1


def test_priorities_of_freezes():
    m = X.FreezeMachine()
    step = lambda k, **flags: m.step({"window_index": k, "end_cycle": 600, **flags})
    assert step(200, high_pair=True)["reason"] == "HIGH_AWR_HIGH_BD" and step(205, sustained_rs=True)["event"] == ""
    o = step(210, tes=True)
    assert (o["reason"], o["mode"], o["freeze_until"]) == ("TES_EVENT", "FROZEN_EVENT", 310)
    o = step(211, high_risk=True)
    assert (o["reason"], o["mode"], o["freeze_until"]) == ("HIGH_RISK", "FROZEN_RISK", 311)
    assert step(240, tes=True)["reason"] == "HIGH_RISK" and m.until == 340  # prolonged under the reason it has
    assert step(341)["event"] == "EXIT_FREEZE" and m.reason == ""


# ------------------------------------------------------------------ nuisance


def test_nuisance_adapter_equals_the_replay():
    rng = np.random.default_rng(9)
    axis = np.array([1.0, 1.0, 0.0]) / np.sqrt(2)
    rows, n = [], 500
    for k in range(n):
        x = rng.normal(size=3) * 0.2 + [0.0, 0.0, 0.004 * k]
        rows.append({"x": [None if k == 200 else float(v) for v in x] if k != 200 else [None, 0.0, 0.0], "end_cycle": 5 * k + 20, "guard": int(k % 60 == 0), "oos": 0.9 if k % 70 == 5 else 0.0, "tes": int(k % 80 == 7)})
    m, beta, out = X.NuisanceAdapter([[1.0, 1.0, 0.0]]), np.zeros(3), []
    for r in rows:
        o = m.step({**r, "x": [math.nan if v is None else v for v in r["x"]]})
        x = np.array([np.nan if v is None else v for v in r["x"]])
        reason = "RESTART_GUARD" if r["guard"] else "HIGH_OOS" if r["oos"] > 0.35 else "HIGH_TES" if r["tes"] else "MISSING_DATA" if np.isnan(x).any() else "ACCEPTED"
        assert o["reason"] == reason  # what is learned is orthogonal to the axis, so baseline scores never move
        if not np.isnan(x).any():
            assert abs(o["score"]) == pytest.approx(abs((x - beta) @ axis))
        if reason == "ACCEPTED":
            beta = 0.998 * beta + 0.002 * np.clip(x - axis * (axis @ x), -3, 3)
        assert o["beta_norm"] == pytest.approx(np.linalg.norm(beta))
        out.append(o)
    assert beta[2] > 0.3 and abs(beta @ axis) < 1e-9


def test_nuisance_replay_vetoes_what_moves_the_score():
    """Clipped residuals are no longer orthogonal: baseline rows then forbid a step that shifts their score."""
    m = X.NuisanceAdapter([[1.0, 1.0, 0.0]], rate=0.5, clip=0.5, drift=0.10)
    for k in range(30):
        m.step({"x": [0.0, 0.0, 0.0], "end_cycle": 20 + 5 * k})
    rate = m.rate
    o = m.step({"x": [4.0, -0.2, 0.0], "end_cycle": 600})
    new = np.clip(np.array([4.0, -0.2, 0.0]) - np.array([1.9, 1.9, 0.0]), -0.5, 0.5)
    moved = abs(0.5 * new @ np.array([1.0, 1.0, 0.0]) / np.sqrt(2))
    assert (o["reason"] == "REPLAY_DRIFT") == (moved > 0.10)
    if moved > 0.10:
        assert m.rate == rate / 2 and m.beta == [0.0, 0.0, 0.0]


def test_gated_adapter_keeps_its_windows_sorted():
    """Values leave the sorted windows as they leave the history; missing ones never enter them."""
    rng, machine = np.random.default_rng(2), X.GatedAdapter(window=7)
    for i in range(40):
        x = [None if rng.random() < 0.2 else float(v) for v in rng.integers(-3, 4, size=3)]
        machine.step({"window_index": i, "end_cycle": 5 * i + 20, "x": x, "mad0": [1.0] * 3, "bd": 1.0, "rs50": 0.0, "tes": 0.0, "awr95": 1.0, "bd95": 2.0, "tes_limit": 3.0})
        assert machine.ordered == [sorted(v[k] for v in machine.history if np.isfinite(v[k])) for k in range(3)]
